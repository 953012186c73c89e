"""Tokens of letters counted within each text: one Arrow pass, of which only counts leave Python."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on together, and rows that leave together.
CHUNK_BYTES, CHUNK_ROWS = 4 << 20, 1 << 16


#: Rows, and bytes of text, of one Arrow batch between the JVM and Python.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once, whatever the length and number of a file's rows; what is bounded more tightly stays so."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        found = spark.conf.get(key).removesuffix("b")
        if not (found.isdigit() and 0 < int(found) <= most):
            spark.conf.set(key, str(most))


@cache
def _letter() -> np.ndarray:
    """By code point, whether it is of text.LETTERS."""
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], np.uint32)
    chars = pa.StringArray.from_buffers(len(points), *_utf8(points))
    table = np.zeros(0x110000, bool)
    table[points] = pc.match_substring_regex(chars, r"^[\p{L}\p{Nl}\p{No}]").to_numpy(zero_copy_only=False)
    return table


def _utf8(points: np.ndarray) -> tuple[pa.Buffer, pa.Buffer]:
    parts = [chr(c).encode() for c in points.tolist()]
    return pa.py_buffer(np.cumsum([0, *map(len, parts)], dtype=np.int32)), pa.py_buffer(b"".join(parts))


def chunks(batch: pa.RecordBatch, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` bytes of the last column, a text, or of one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(batch):
        j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + limit, "right")))
        yield batch.slice(i, j - i)
        i = j


def raw(text: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts without nulls, and where each begins."""
    off = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, text.offset * 4)
    return np.frombuffer(text.buffers()[2] or b"", np.uint8)[off[0] : off[-1]], off.astype(np.int64) - off[0]


def letters(text: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """The lower-cased tokens of all texts, and how many each has (null: none)."""
    tokens, start, off = cased_letters(pc.utf8_lower(pc.fill_null(text, "")))
    return tokens, np.diff(np.searchsorted(start, off))


def cased_letters(text: pa.Array) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """The tokens of all texts (without nulls), the bytes at which they start, and those at which texts do."""
    buf, off = raw(text)
    table = _letter()
    inside = table[:256][buf]
    wide = np.flatnonzero(buf >= 0xC0)
    inside[buf >= 0x80] = False
    lead = buf[wide].astype(np.uint32)
    size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    point = lead & (0x7F >> size)
    for k in range(1, 4):
        more = size > k
        point[more] = point[more] << 6 | buf[wide[more] + k] & 0x3F
    good = table[np.minimum(point, 0x10FFFF)]
    for k in range(4):
        inside[wide[good & (size > k)] + k] = True
    before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = off[:-1] < off[1:]
    before[off[:-1][full]] = after[off[1:][full] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    at = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(buf[inside].tobytes()))
    return tokens, start, off


class Counts:
    """(text, term) pairs of one chunk, by text: ``doc``, its place in the chunk, ``code`` in ``words``, ``tf``; ``doc_len`` of each text."""

    def __init__(self, text: pa.Array):
        tokens, self.doc_len = letters(text)
        coded = tokens.dictionary_encode()
        self.words, n = coded.dictionary, max(len(coded.dictionary), 1)
        doc = np.repeat(np.arange(len(self.doc_len)), self.doc_len)
        pairs, self.tf = np.unique(doc * n + coded.indices.to_numpy().astype(np.int64), return_counts=True)
        self.doc, self.code = pairs // n, pairs % n


def out(columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(columns, names)
    for i in range(0, len(whole), CHUNK_ROWS):
        yield whole.slice(i, CHUNK_ROWS)


def frequencies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf, doc_len of each row's own terms."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                c = Counts(part.column(1))
                columns = [part.column(0).take(pa.array(c.doc)), c.words.take(pa.array(c.code)), pa.array(c.tf, pa.int64()), pa.array(c.doc_len[c.doc], pa.int64())]
                yield from out(columns, [key, "term", "tf", "doc_len"])

    rows = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, term string, tf long, doc_len long")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, df, ttf: in how many rows, and how often, each term occurs. Chunks are summed before anything is shuffled."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                c = Counts(part.column(0))
                n = len(c.words)
                columns = [c.words, pa.array(np.bincount(c.code, minlength=n), pa.int64()), pa.array(np.bincount(c.code, c.tf, n).astype(np.int64))]
                yield from out(columns, ["term", "df", "ttf"])

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "term string, df long, ttf long")
    return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("ttf").alias("ttf"))


def _places(words: pa.Array, terms: pa.Array) -> np.ndarray:
    """Where in terms each word stands; -1: nowhere."""
    return pc.fill_null(pc.index_in(words, terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def listed_frequency(docs: DataFrame, terms: pa.Array, text: str = "text") -> np.ndarray:
    """In how many rows each of a list of terms occurs; what is sent to the driver is as long as the list."""

    def run(batches):
        df = np.zeros(len(terms), np.int64)
        for batch in batches:
            for part in chunks(batch):
                c = Counts(part.column(0))
                at = _places(c.words, terms)[c.code]
                df += np.bincount(at[at >= 0], minlength=len(terms))
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(df[found])], ["at", "df"])

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(len(terms), np.int64)
    out[rows["at"].to_numpy()] = rows["df"].to_numpy()
    return out


#: Cells of documents by queries that are summed together.
CELLS = 1 << 22


def best(docs: DataFrame, terms: pa.Array, weight: np.ndarray, query: np.ndarray, term: np.ndarray, asked: np.ndarray, n: int, margin: float) -> DataFrame:
    """query (its number), doc_id, s, matched: the sum of sqrt(tf) * weight / sqrt(doc_len) over the query's terms (pairs
    query, term) in the document, and how many these are. Of each chunk, only rows that ``n`` others of the query don't
    beat by more than ``margin``, s taken times the matched share."""
    order = np.argsort(term, kind="stable")
    listed, first = query[order], np.searchsorted(term[order], np.arange(len(terms) + 1))
    size = len(asked)

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                c = Counts(part.column(1))
                at = _places(c.words, terms)[c.code]
                doc, tf, at = c.doc[at >= 0], c.tf[at >= 0], at[at >= 0]
                value = np.sqrt(tf) * weight[at] / np.sqrt(c.doc_len[doc])
                step = max(1, CELLS // max(size, 1))
                for d in range(0, len(part), step):
                    i, j = np.searchsorted(doc, (d, d + step))
                    if i == j:
                        continue
                    own, k = at[i:j], min(step, len(part) - d)
                    times = first[own + 1] - first[own]
                    ends = np.cumsum(times)
                    q = listed[np.arange(ends[-1]) - np.repeat(ends - times, times) + np.repeat(first[own], times)]
                    cell = np.repeat(doc[i:j] - d, times) * size + q
                    s = np.bincount(cell, np.repeat(value[i:j], times), k * size).reshape(k, size)
                    matched = np.bincount(cell, minlength=k * size).reshape(k, size)
                    score = np.where(matched > 0, s * matched / asked, -np.inf)
                    least = np.partition(score, k - n, 0)[k - n] if k > n else np.full(size, -np.inf)
                    row, col = np.nonzero((score >= least - margin) & (matched > 0))
                    yield from out([pa.array(col), part.column(0).take(pa.array(row + d)), pa.array(s[row, col]), pa.array(matched[row, col])], ["query", "doc_id", "s", "matched"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"query long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, s double, matched long")
