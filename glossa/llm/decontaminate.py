"""Benchmark decontamination by Wu-Manber search over words.

Text is lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A pattern is a window of ten
consecutive words of an item; an item of fewer words, but not none, is one pattern. Patterns of one length are searched
together: a shift table over blocks of two words says how far every cursor may skip, a shift of zero leads to the bucket
of the patterns that end in that block, and their words are compared. Cursors of all documents of a batch move in lockstep.

Items are compiled into blocks of bounded size, files in the shared folder that tasks read one at a time, so neither the
driver nor a task ever holds the whole benchmark. Documents aren't shuffled.

Null and empty texts have no words; empty items match nothing; a null item_id is named "null"; repeated rows are judged alike;
items that hold the same window all count, so ties need no order; a very long text is searched whole, by many cursors at once;
empty tables give no rows, or no hits; other columns, whatever their names, are passed on or ignored.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from . import textbuf as tb
from .tokens import _open

WINDOW = 10
#: Bytes of item texts compiled into one block.
BLOCK_BYTES = 8 << 20
#: Bytes of documents that one load of a block serves, where there are several.
GROUP_BYTES = 32 << 20
#: Window starts that one cursor walks through.
STRIDE = 256


class Text:
    """The words of a batch of documents."""

    def __init__(self, column: pa.Array):
        buf, self.doc_off = tb.parts(column)
        self.buf = tb.LOWER[buf]
        self.start, self.end, self.off = tb.words(self.buf, self.doc_off, tb.ALNUM)
        self.values = tb.word_values(self.buf, self.start, self.end)

    def window(self, i: int, m: int) -> bytes:
        return b" ".join(self.buf[a:b].tobytes() for a, b in zip(self.start[i : i + m], self.end[i : i + m], strict=True))


def _block_hash(values: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    h = values[end - 1]
    return tb.mix(h + values[end - 2] * tb.U(0x9E3779B97F4A7C15)) if size == 2 else h.copy()


class WuManber:
    """Patterns of one length in words."""

    def __init__(self, length: int, patterns: dict[bytes, set[str]]):
        self.m, self.size = length, min(2, length)
        keys = sorted(patterns)
        text = Text(pa.array([k.decode() for k in keys]))
        assert (np.diff(text.off) == length).all()
        ends = text.off[1:]
        suffix = _block_hash(text.values, ends, self.size)
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.ends = suffix[order], ends[order]
        self.words = [keys[i] for i in order]
        self.items = [sorted(patterns[keys[i]]) for i in order]
        bits = min(24, max(12, math.ceil(math.log2(len(keys) * length * 16))))
        self.mask = tb.U((1 << bits) - 1)
        self.shift = np.full(1 << bits, length - self.size + 1, np.int16)
        for j in range(self.size, length + 1):
            at = (_block_hash(text.values, text.off[:-1] + j, self.size) & self.mask).astype(np.int64)
            np.minimum.at(self.shift, at, np.int16(length - j))
        self.last = text.values[self.ends - 1]
        self.first = text.values[self.ends - length]

    def search(self, text: Text) -> tuple[np.ndarray, np.ndarray]:
        """Word positions where a pattern begins, and which pattern."""
        counts = np.maximum(np.diff(text.off) - self.m + 1, 0)
        strides = -(-counts // STRIDE)
        doc = np.repeat(np.arange(len(counts)), strides)
        nth = tb.expand(np.zeros(len(counts), np.int64), strides)
        begin = text.off[doc] + nth * STRIDE
        cur = begin + self.m
        stop = np.minimum(begin + STRIDE, text.off[doc] + counts[doc]) + self.m
        found = []
        while len(cur):
            h = _block_hash(text.values, cur, self.size)
            step = self.shift[(h & self.mask).astype(np.int64)]
            zero = step == 0
            if zero.any():
                found.append((cur[zero], h[zero]))
            cur = cur + np.maximum(step, 1)
            live = cur < stop
            cur, stop = cur[live], stop[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends, h = (np.concatenate(x) for x in zip(*found, strict=True))
        low, high = np.searchsorted(self.suffix, h), np.searchsorted(self.suffix, h, "right")
        pattern = tb.expand(low, high - low)
        begin = np.repeat(ends - self.m, high - low)
        same = text.values[begin] == self.first[pattern]
        pattern, begin = pattern[same], begin[same]
        sure = np.fromiter((text.window(b, self.m) == self.words[p] for b, p in zip(begin.tolist(), pattern.tolist(), strict=True)), bool, len(begin))
        return begin[sure], pattern[sure]


def compile_items(ids: list, column: pa.Array, window: int = WINDOW) -> list[WuManber]:
    text, by_length = Text(column), defaultdict(lambda: defaultdict(set))
    for item, a, b in zip(ids, text.off[:-1].tolist(), text.off[1:].tolist(), strict=True):
        m = min(window, b - a)
        for i in range(a, b - m + 1) if m else ():
            by_length[m][text.window(i, m)].add("null" if item is None else str(item))
    return [WuManber(m, p) for m, p in sorted(by_length.items())]


def compiled(items: DataFrame, window: int = WINDOW) -> list[str]:
    """Compiles the items, in blocks of BLOCK_BYTES, into files; their paths."""
    spark = items.sparkSession
    scratch.small_batches(spark)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, folder = max(1, -(-size // BLOCK_BYTES)), scratch.path(spark, "patterns")

    def build(batches):
        batches = list(batches)  # one block
        ids = [x for b in batches for x in b.column("item_id").to_pylist()]
        if ids:
            made = compile_items(ids, pa.concat_arrays([b.column("text") for b in batches]), window)
            system, base = _open(folder)
            where = f"block-{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}.bin"
            system.create_dir(base, recursive=True)
            with system.open_output_stream(f"{base}/{where}", compression=None) as out:
                out.write(pickle.dumps(made))
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{where}"]})

    spread = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).repartition(blocks, F.xxhash64("item_id", "text"))
    return sorted(r["path"] for r in spread.mapInArrow(build, "path string").collect())


_loaded: dict[str, list[WuManber]] = {}


def _load(where: str) -> list[WuManber]:
    """The patterns of one block; the last one stays loaded."""
    if where not in _loaded:
        system, local = _open(where)
        with system.open_input_file(local) as f:
            found = pickle.loads(f.read())
        _loaded.clear()
        _loaded[where] = found
    return _loaded[where]


def groups(batches: Iterator[pa.RecordBatch], blocks: list[str]) -> Iterator[list[pa.RecordBatch]]:
    """Slices of documents that are searched together: with several blocks many, so that each load of a block serves them all."""
    held, size = [], 0
    for batch in batches:
        for part in tb.chunks(batch):
            held.append(part)
            size += tb.parts(part.column("text"))[1][-1]
            if len(blocks) == 1 or size >= GROUP_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def search(parts: list[pa.RecordBatch], blocks: list[str]) -> list[tuple[np.ndarray, np.ndarray, list[list[str]]]]:
    """Of each document of each slice: number of words, of words that are hit, and the items found."""
    texts = [Text(part.column("text")) for part in parts]
    depths, items = [np.zeros(len(t.values) + 1, np.int64) for t in texts], [defaultdict(set) for _ in texts]
    for where in blocks:
        for patterns in _load(where):
            for text, depth, named in zip(texts, depths, items, strict=True):
                begin, which = patterns.search(text)
                np.add.at(depth, begin, 1)
                np.add.at(depth, begin + patterns.m, -1)
                for d, p in set(zip((np.searchsorted(text.off, begin, "right") - 1).tolist(), which.tolist(), strict=True)):
                    named[d].update(patterns.items[p])
    out = []
    for text, depth, named in zip(texts, depths, items, strict=True):
        hits = np.concatenate([[0], np.cumsum(np.cumsum(depth[:-1]) > 0)])[text.off]
        out.append((np.diff(text.off), np.diff(hits), [sorted(named[d]) if d in named else [] for d in range(len(text.off) - 1)]))
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (the ids found, as sorted strings)."""
    blocks = compiled(items, window)

    def scan(batches: Iterator[pa.RecordBatch]):
        for parts in groups(batches, blocks):
            for part, (n, hit, found) in zip(parts, search(parts, blocks), strict=True):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(hit), pa.array(found, pa.list_(pa.string()))], ["doc_id", "n_words", "n_hit", "items"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(scan, "doc_id long, n_words long, n_hit long, items array<string>")


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, with all their columns, in which no window of an item occurs."""
    blocks = compiled(items, window)

    def scan(batches):
        for parts in groups(batches, blocks):
            for part, (_, hit, _) in zip(parts, search(parts, blocks), strict=True):
                yield part.filter(pa.array(hit == 0))

    return scratch.kept(docs, scan)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP3_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, m, array_to_string(w[p:p + m - 1], ' ') AS pat
      FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, m, p, array_to_string(w[p:p + m - 1], ' ') AS pat
      FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS p FROM w, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
h AS (SELECT d.doc_id, d.p, d.m, p.item_id FROM d JOIN p USING (m, pat)),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + m - 1)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.s, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
