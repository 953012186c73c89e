"""Vector best-fit packing of documents into training sequences.

A bin (sequence) has three capacities: tokens, documents, and attention cost (the sum of squared piece lengths, for
attention that stays within a document). Every item's vector follows from its length, so the whole corpus is its histogram
of lengths, at most ``tokens`` classes however many documents there are. The driver packs that histogram: longest class
first, each class into the group of equal bins that the score selects, a whole group at a step. What it hands back is a
table of rank intervals (length, ranks -> consecutive bins, offset) of bounded size; documents find their place by their
rank among those of equal length. So this is one global best-fit-decreasing, without a global sort.

Only documents longer than a sequence are cut: whole sequences from their end, the rest, if any, is the first piece.
Null texts are empty (a document of the end id alone); repeated rows are packed as often as they occur; a very long text is cut
into as many sequences as it fills; bins that tie are taken by fewer free tokens, then fewer free documents; an empty table gives
no rows; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch
from .tokens import END_ID, crc32, default_tokenizer, encoded


@dataclass(frozen=True)
class Bin:
    """Capacities (None: bounded by the tokens alone), the weights of the dimensions, and how a bin is selected:
    "norm" takes the one whose weighted residual is smallest after the item is in, "dot" the one whose weighted
    dot product of item and residual is largest."""

    tokens: int = 1024
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.0, 0.0)
    select: str = "norm"

    def __post_init__(self):
        if self.select not in ("norm", "dot"):
            raise ValueError("select is norm or dot")

    @property
    def capacity(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.int64)


#: What the query and the pipeline pack into. At most 32 documents share a sequence; all three residuals choose it. A sequence
#: must be able to hold a full piece, so its attention capacity is 1024**2 and, unlike the other two, can't bind before the tokens do.
SEQUENCE = Bin(documents=32, attention=1024**2, weights=(1.0, 0.25, 0.25))


@dataclass
class _Bins:
    """Groups of bins with equal residuals; each group is a list of ranges of bin numbers."""

    residual: np.ndarray = field(default_factory=lambda: np.zeros((0, 3), np.int64))
    ranges: list[list[tuple[int, int]]] = field(default_factory=list)
    by_state: dict[tuple, int] = field(default_factory=dict)
    free: list[int] = field(default_factory=list)

    def add(self, state: np.ndarray, ranges: list[tuple[int, int]]) -> None:
        key = tuple(state.tolist())
        if key in self.by_state:
            self.ranges[self.by_state[key]] += ranges
            return
        if not self.free:
            n = len(self.residual)
            self.residual = np.concatenate([self.residual, np.full((max(64, n), 3), -1, np.int64)])
            self.ranges += [[] for _ in range(max(64, n))]
            self.free = list(range(n, len(self.residual)))
        i = self.free.pop()
        self.residual[i], self.ranges[i], self.by_state[key] = state, ranges, i

    def take(self, i: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
        state, ranges = self.residual[i].copy(), self.ranges[i]
        del self.by_state[tuple(state.tolist())]
        self.residual[i], self.ranges[i] = -1, []
        self.free.append(i)
        return state, ranges


def fit(histogram: dict[int, int], bins: Bin) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, first rank, end rank, first bin, offset) for the items of each length, and the number of bins."""
    capacity, open_bins, rows, used = bins.capacity, _Bins(), [], 0
    weights = np.array(bins.weights) / np.maximum(capacity, 1).astype(float) ** 2
    for length in sorted(histogram, reverse=True):
        item = np.array([length, 1, length * length], np.int64)
        if length < 1 or (item > capacity).any():
            raise ValueError(f"no sequence can hold a piece of {length} tokens")
        rank, total = 0, histogram[length]
        while rank < total:
            fits = np.flatnonzero((open_bins.residual >= item).all(1))
            if len(fits):
                left = open_bins.residual[fits]
                score = (((left - item) ** 2) * weights).sum(1) if bins.select == "norm" else -(left * item * weights).sum(1)
                state, ranges = open_bins.take(int(fits[np.lexsort((left[:, 1], left[:, 0], score))[0]]))
            else:
                count = -(-(total - rank) // max(1, int((capacity // item).min())))
                state, ranges, used = capacity, [(used, used + count)], used + count
            offset, filled = int(capacity[0] - state[0]), []
            while ranges and rank < total:
                a, b = ranges.pop()
                n = min(b - a, total - rank)
                rows.append((length, rank, rank + n, a, offset))
                filled.append((a, a + n))
                rank += n
                if a + n < b:
                    ranges.append((a + n, b))
            if ranges:
                open_bins.add(state, ranges)
            open_bins.add(state - item, filled)
    return rows, used


def pieces(docs: DataFrame, tokenizer: str, tokens: int, end_id: int = END_ID) -> DataFrame:
    """Per document: doc_id, n_tokens, rest (length of a first piece shorter than a sequence, else 0), crcs of its pieces, slot."""
    spark = docs.sparkSession
    scratch.small_batches(spark)
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches):
        slot = (TaskContext.get().partitionId() * 7919) % slots
        for part, ids, off in encoded(batches, tokenizer):
            n = np.diff(off)
            rest = n % tokens
            crcs = []
            for a, b, r in zip(off[:-1].tolist(), off[1:].tolist(), rest.tolist(), strict=True):
                edges = ([a] if r else []) + list(range(a + r, b, tokens)) + [b]
                crcs.append([crc32(ids[x:y]) for x, y in zip(edges[:-1], edges[1:], strict=True)])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n), pa.array(rest.astype(np.int32)), pa.array(crcs, pa.list_(pa.int64())), pa.array(((slot + np.arange(len(part))) % slots).astype(np.int32))], ["doc_id", "n_tokens", "rest", "crcs", "slot"]
            )
            slot += len(part)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(cut, "doc_id long, n_tokens long, rest int, crcs array<long>, slot int")


def pack(docs: DataFrame, tokenizer: str | None = None, bins: Bin = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The texts are read and encoded once; what is shuffled afterwards is one short row per document. Full pieces are
    sequences of their own with negative numbers; the others are numbered from 0.
    """
    spark = docs.sparkSession
    if (bins.capacity < np.array([bins.tokens, 1, bins.tokens**2])).any():
        raise ValueError(f"a full piece of {bins.tokens} tokens exceeds the capacities {bins.capacity.tolist()}")
    made = scratch.saved(pieces(docs, tokenizer or default_tokenizer(), bins.tokens, end_id), "pieces")
    counts = scratch.saved(made.where("rest > 0").groupBy("rest", "slot").agg(F.count("*").alias("n")), "lengths")
    # at most bins.tokens - 1 rows, however large the corpus
    histogram = {r["rest"]: r["n"] for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    rows, _ = fit(histogram, bins)
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    names = ["rest", "rank0", "rank1", "bin0", "at"]
    places = spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in columns], names)).withColumn("rest", F.col("rest").cast("int"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("rest").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("rest", "slot", before.alias("before"))
    ranked = made.where("rest > 0").withColumn("nth", F.row_number().over(Window.partitionBy("rest", "slot").orderBy("doc_id", "n_tokens", "crcs")) - 1)
    ranked = ranked.join(bases, ["rest", "slot"]).withColumn("rank", F.col("before") + F.col("nth"))
    # places has a few rows per open range of bins and length: its size depends on bins.tokens alone
    placed = ranked.join(F.broadcast(places), (ranked["rest"] == places["rest"]) & (F.col("rank") >= F.col("rank0")) & (F.col("rank") < F.col("rank1"))).select(
        "doc_id", "n_tokens", ranked["rest"], "crcs", (F.col("bin0") + F.col("rank") - F.col("rank0")).alias("bin"), "at"
    )
    whole = made.where("rest = 0").select("doc_id", "n_tokens", "rest", "crcs", F.lit(None).cast("long").alias("bin"), F.lit(0).cast("long").alias("at"))
    own = -(F.monotonically_increasing_id() + 1)
    first = (F.col("piece") == 0) & (F.col("rest") > 0)
    t = bins.tokens
    return (
        placed.unionByName(whole)
        .select("doc_id", "n_tokens", "rest", "bin", "at", F.posexplode("crcs").alias("piece", "ids_crc32"))
        .select(
            "doc_id",
            "piece",
            F.when(F.col("rest") > 0, F.greatest(F.lit(0).cast("long"), F.col("rest") + (F.col("piece") - 1).cast("long") * t)).otherwise(F.col("piece").cast("long") * t).alias("start"),
            F.when(first, F.col("rest").cast("long")).otherwise(F.lit(t).cast("long")).alias("length"),
            "ids_crc32",
            F.when(first, F.col("bin")).otherwise(own).alias("sequence_id"),
            F.when(first, F.col("at")).otherwise(F.lit(0).cast("long")).alias("offset"),
        )
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
