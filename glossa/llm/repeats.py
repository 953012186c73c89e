"""Which windows of W symbols occur elsewhere: prefix doubling over sampled positions, for byte strings and word sequences.

Ranking every position of a text shuffles many times its bytes, so the positions that are ranked are sampled, in such a way
that each window of W symbols owns one and equal windows own equal positions:

1. Every window owns its leftmost smallest gram of K symbols; about two of W positions are owned at all. The gram is a
   position's first rank. Positions whose rank is unique drop out. In periodic text, down to one symbol again and again, a
   position is owned every period; neighbours whose windows are the same are one row, the first with how many ``times`` it comes.
2. Copies are told first: where the span of all the windows that own a position (up to 2W - K symbols) is that of another,
   all its windows repeat, and one position of such a class goes on as what others may match. Ranks that only one position
   still has drop out.
3. Prefix doubling: around each position lies a grid of steps of ``block`` symbols. All strings of one step on it are ranked;
   then pairs (rank at m, rank at m + 1), (rank at m, rank at m + 2), ... are sorted into classes and ranked anew, the length
   doubling each time; unique ones drop out, until the ranked string (the core) is as long as what ``block`` neighbouring
   windows have in common.
4. The windows of a block share its core, with at most ``block`` symbols more at its ends. Windows pair the core's rank with
   the rest: first the whole block, which tells for all its windows where it repeats, then, at the edges of repeats, one by one.

A rank is the number of a class, so equal ranks mean equal strings (not the order of different ones, which nothing here
asks for). A class is found by its key, of ranks already given and at most two 61-bit prints, so a wrong match needs a print
to collide within one class. Each step moves ranks, a row key and a few small numbers a position; texts are written once,
bucketed by row key, and meet their positions without moving again. Classes are aggregated map-side before they are joined
back, both sides of a join are exchanges, so adaptive execution can split a class that holds a large share of all rows, and
no step collects a class. Intermediate tables are deleted when the spans are written.

"earlier" decides what counts as elsewhere: a row with a smaller doc_id, or any other place.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import textbuf as tb

#: Symbols of a batch: bytes or 64-bit values, and the offset of each document's first.
Symbols = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Search:
    symbols: Symbols
    window: int
    gram: int
    earlier: bool

    @property
    def rounds(self) -> int:
        """Doublings of a grid string until it is a core."""
        return 3 if self.window >= 8 else 0

    @property
    def block(self) -> int:
        # the core's 2**rounds steps fit into what so many windows have in common
        return max(1, (self.window + 1) // ((1 << self.rounds) + 1))


def _owners(values: np.ndarray, off: np.ndarray, s: Search) -> dict[str, np.ndarray]:
    """The positions that windows own: gram, document, place in it, distances from the last and the first of its windows.

    A position whose neighbours own the same windows stands for them too: ``times`` of them, d1 - d0 + 1 symbols apart.
    """
    counts = np.maximum(np.diff(off) - s.window + 1, 0)
    if not counts.sum():
        return {k: np.zeros(0, np.int64) for k in ("h", "doc", "a", "d0", "d1", "times")}
    grams = tb.grams(values, s.gram)
    starts = tb.expand(off[:-1], counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    owner = tb.sliding_argmin(grams, s.window - s.gram + 1)[starts]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner)) - 1
    at = owner[first]
    doc, h, d0, d1 = doc[first], grams[at], at - starts[last], at - starts[first]
    fresh = np.ones(len(at), bool)
    # windows follow each other, so equal distances are also the distance of the two positions
    near = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1]) & (d0[1:] == d0[:-1]) & (d1[1:] == d1[:-1])) + 1
    if len(near):
        prints = tb.Prints(values)
        span = lambda i: prints.of(at[i] - d1[i], at[i] - d0[i] + s.window, 1)
        fresh[near] = span(near) != span(near - 1)
    run = np.flatnonzero(fresh)
    times = np.diff(np.append(run, len(at)))
    return {"h": tb.signed(h[run]), "doc": doc[run], "a": (at - off[doc])[run], "d0": d0[run], "d1": d1[run], "times": times}


_PLACE = ("h", "a", "d0", "d1", "times")
_BLOCK = ("core", "a", "b0", "b1", "step", "times")


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def _keys(part: pa.RecordBatch, doc: np.ndarray) -> dict[str, pa.Array]:
    at = pa.array(doc)
    return {"k1": part.column("k1").take(at), "k2": part.column("k2").take(at)}


def _listed(part: pa.RecordBatch, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """The structs of the column ``found``: the document of each and their fields."""
    column = part.column("found")
    flat, sizes = column.flatten(), np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(part)), sizes), [flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]


def _sampled(s: Search):
    def run(batches):
        for batch in batches:
            for part in tb.chunks(batch):
                got = _owners(*s.symbols(part.column("text")), s)
                yield _batch({"h": got["h"], **_keys(part, got["doc"]), **{k: pa.array(got[k], pa.int32()) for k in ("a", "d0", "d1", "times")}})

    return run


def _spans(s: Search):
    def run(batches):
        for batch in batches:
            for part in tb.chunks(batch):
                values, off = s.symbols(part.column("text"))
                doc, (h, a, d0, d1, times) = _listed(part, *_PLACE)
                at = off[doc] + a
                span = tb.Prints(values).of(at - d1, at - d0 + s.window, 1)
                yield _batch({"h": h, "span": tb.signed(span), **_keys(part, doc), **{k: pa.array(v, pa.int32()) for k, v in (("a", a), ("d0", d0), ("d1", d1), ("times", times))}})

    return run


def _grid(s: Search):
    """Of each position: prints of the steps of its grid from ``m0`` on, and of its whole blocks."""

    def run(batches):
        for batch in batches:
            for part in tb.chunks(batch):
                values, off = s.symbols(part.column("text"))
                prints = tb.Prints(values)
                doc, (h, a, d0, d1, times) = _listed(part, *_PLACE)
                at = off[doc] + a
                j0, j1 = d0 // s.block, d1 // s.block
                n = j1 - j0 + (1 << s.rounds)
                begin = at[np.repeat(np.arange(len(a)), n)] + tb.expand(-j1, n) * s.block
                steps = tb.list_column(tb.signed(prints.of(begin, begin + s.block, 2)), np.concatenate([[0], np.cumsum(n)]), pa.int64())
                n = j1 - j0 + 1
                row = np.repeat(np.arange(len(a)), n)
                j = tb.expand(j0, n)
                low, high = np.maximum(d0[row], j * s.block), np.minimum(d1[row], j * s.block + s.block - 1)
                whole = prints.of(at[row] - high, at[row] - low + s.window, 3)
                blocks = pa.StructArray.from_arrays([pa.array(j, pa.int32()), pa.array(tb.signed(whole)), pa.array(low, pa.int32()), pa.array(high, pa.int32())], ["j", "whole", "b0", "b1"])
                blocks = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), blocks)
                yield _batch({"h": h, **_keys(part, doc), "a": pa.array(a, pa.int32()), "step": pa.array(d1 - d0 + 1, pa.int32()), "times": pa.array(times, pa.int32()), "m0": pa.array(-j1, pa.int32()), "steps": steps, "blocks": blocks})

    return run


def _windows(s: Search):
    def run(batches):
        for batch in batches:
            for part in tb.chunks(batch):
                values, off = s.symbols(part.column("text"))
                doc, (core, a, b0, b1, step, times) = _listed(part, *_BLOCK)
                n = b1 - b0 + 1
                row, d = np.repeat(np.arange(len(a)), n), tb.expand(b0, n)
                begin = (off[doc] + a)[row] - d
                yield _batch({"core": core[row], "d": pa.array(d, pa.int32()), "w": tb.signed(tb.Prints(values).of(begin, begin + s.window, 4)), **_keys(part, doc[row]), **{k: pa.array(v[row], pa.int32()) for k, v in (("a", a), ("step", step), ("times", times))}})

    return run


def _count(rows: DataFrame) -> Column:
    return F.sum(F.col("times").cast("long")) if "times" in rows.columns else F.count("*")


def _classes(rows: DataFrame, keys: list[str], s: Search, name: str) -> DataFrame:
    """Of each class of equal keys that can repeat: its first place."""
    found = rows.groupBy(*keys).agg(F.min(F.struct("k1", "k2", "a")).alias("src"), F.max("k1").alias("last"), _count(rows).alias("n"))
    return scratch.saved(found.where(F.col("last") > F.col("src.k1") if s.earlier else F.col("n") > 1).drop("last", "n"), name)


def _against(rows: DataFrame, classes: DataFrame, keys: list[str], s: Search) -> DataFrame:
    """Rows with src (null: alone in their class), hit (they repeat) and onward (others may still match them, or they others)."""
    joined = rows.join(classes, keys, "left")
    first = (F.col("src.k1") == F.col("k1")) if s.earlier else (F.col("src") == F.struct("k1", "k2", "a"))
    alone = F.col("src").isNull()
    hit = ~alone & (F.col("src.k1") < F.col("k1")) if s.earlier else ~alone
    return joined.withColumns({"hit": hit, "onward": alone | first})


def _collected(rows: DataFrame, *fields: str) -> DataFrame:
    return rows.groupBy("k1", "k2").agg(F.collect_set(F.struct(*fields)).alias("found"))


def _meeting(base: DataFrame, listed: DataFrame) -> DataFrame:
    # the base is bucketed by these keys: only the short rows of positions move, and they are the side that is hashed
    return base.join(listed.hint("shuffle_hash"), ["k1", "k2"]).select("text", "k1", "k2", "found")


def _live(rows: DataFrame, keys: list[str], s: Search) -> DataFrame:
    """The classes of equal keys that can repeat."""
    found = rows.groupBy(*keys).agg(F.min("k1").alias("low"), F.max("k1").alias("high"), _count(rows).alias("n"))
    return found.where("low < high" if s.earlier else "n > 1").drop("low", "high", "n")


def _doubled(grid: DataFrame, s: Search) -> DataFrame:
    """position, m and ``rank`` of the cores that repeat: ranks of pairs of ranks at offsets of 1, 2, 4, ... steps."""
    rows = grid.select("h", "k1", "position", "m0", F.posexplode("steps").alias("m", "r")).select("h", "k1", "position", (F.col("m") + F.col("m0")).alias("m"), "r")
    keys = ["h", "m", "r"]
    for k in range(s.rounds + 1):
        # the classes are written, so that the number of each is settled before it is used
        classes = scratch.saved(_live(rows, keys, s).withColumn("rank", F.monotonically_increasing_id()), f"ranks-{s.block << k}")
        ranked = rows.join(classes, keys).select("k1", "position", "m", "rank")
        if k < s.rounds:
            # a position has at most some dozen steps
            at = ranked.groupBy("position", "k1").agg(F.map_from_entries(F.collect_list(F.struct("m", "rank"))).alias("at"))
            at = at.withColumn("step", F.lit(1 << k))
            pairs = F.transform(F.map_entries("at"), lambda x: F.struct(x["key"].alias("m"), x["value"].alias("r"), F.try_element_at(F.col("at"), x["key"] + F.col("step")).alias("next")))
            rows = scratch.saved(at.select("position", "k1", F.inline(F.filter(pairs, lambda x: x["next"].isNotNull()))), f"pairs-{s.block << k}")
            keys = ["r", "next"]
    return ranked


def repeated(base: DataFrame, s: Search) -> DataFrame:
    """Spans of the texts of ``base`` (a bucketed table of scratch.keyed rows) that consist of windows that occur elsewhere.

    Rows: k1, k2, s, e (in symbols), and where the first such occurrence is: src_k1, src_k2, src_s; the same again ``times`` times
    in all, each ``step`` symbols on.
    """
    with scratch.scope():
        return scratch.saved(_repeated(base, s), "repeats", keep=True)


def _repeated(base: DataFrame, s: Search) -> DataFrame:
    place = "h long, k1 long, k2 long, a int, d0 int, d1 int, times int"
    sampled = scratch.saved(base.select("k1", "k2", "text").mapInArrow(_sampled(s), place), "sampled")
    listed = _collected(sampled.join(scratch.saved(_live(sampled, ["h"], s), "grams"), "h"), *_PLACE)
    spans = scratch.saved(_meeting(base, listed).mapInArrow(_spans(s), "h long, span long, k1 long, k2 long, a int, d0 int, d1 int, times int"), "spans")
    keys = ["h", "span", "d0", "d1"]
    by_span = scratch.saved(_against(spans, _classes(spans, keys, s, "span-classes"), keys, s), "by-span")
    left = by_span.where("onward")
    left = _collected(left.join(scratch.saved(_live(left, ["h"], s), "grams-left"), "h"), *_PLACE)
    grid = _meeting(base, left).mapInArrow(_grid(s), "h long, k1 long, k2 long, a int, step int, times int, m0 int, steps array<long>, blocks array<struct<j:int,whole:long,b0:int,b1:int>>")
    grid = scratch.saved(grid.withColumn("position", F.monotonically_increasing_id()), "grid")
    cores = _doubled(grid, s).select("position", (-F.col("m")).alias("j"), F.col("rank").alias("core"))
    blocks = scratch.saved(grid.select("position", "k1", "k2", "a", "step", "times", F.inline("blocks")).join(cores, ["position", "j"]), "blocks")
    keys = ["core", "whole", "b0", "b1"]
    by_block = scratch.saved(_against(blocks, _classes(blocks, keys, s, "block-classes"), keys, s), "by-block")
    left = by_block.where("onward")
    left = _collected(left.join(_live(left, ["core"], s), "core"), *_BLOCK)
    windows = scratch.saved(_meeting(base, left).mapInArrow(_windows(s), "core long, d int, w long, k1 long, k2 long, a int, step int, times int"), "windows")
    keys = ["core", "d", "w"]
    by_window = _against(windows, _classes(windows, keys, s, "window-classes"), keys, s)

    def hits(df: DataFrame, low: str, high: str) -> DataFrame:
        start, end = F.col("a") - F.col(high), F.col("a") - F.col(low) + s.window
        if not s.earlier:  # only what is covered counts: windows of a period are one span
            df = df.withColumns({"on": (F.col("times") - 1) * F.col("step"), "times": F.lit(1)})
            end = end + F.col("on")
        return df.where("hit").select("k1", "k2", start.alias("s"), end.alias("e"), F.col("src.k1").alias("src_k1"), F.col("src.k2").alias("src_k2"), (F.col("src.a") - F.col(high)).alias("src_s"), "step", "times")

    by_span = by_span.withColumn("step", F.col("d1") - F.col("d0") + 1)
    return hits(by_span, "d0", "d1").unionByName(hits(by_block, "b0", "b1")).unionByName(hits(by_window, "d", "d"))


def with_spans(base: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows of ``base`` with the array ``found`` of their spans (null: none)."""
    return base.join(_collected(spans, "s", "e", "src_k1", "src_k2", "src_s", "step", "times").hint("shuffle_hash"), ["k1", "k2"], "left")


def runs(part: pa.RecordBatch, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """The spans of with_spans() as they are: the document of each, s, e, step, times and further fields."""
    if not len(part):
        return np.zeros(0, np.int64), [np.zeros(0, np.int64) for _ in ("s", "e", "step", "times", *names)]
    return _listed(part, "s", "e", "step", "times", *names)


def listed(part: pa.RecordBatch, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """The spans of with_spans(), each as often as it comes: its document, s, e and further fields."""
    doc, (s, e, step, times, *rest) = runs(part, *names)
    row = np.repeat(np.arange(len(s)), times)
    on = tb.expand(np.zeros(len(s), np.int64), times) * step[row]
    return doc[row], [s[row] + on, e[row] + on, *(x[row] for x in rest)]
