"""Quality rules: lexical counts, and repetition found with a suffix array of the document's words.

Words are ``[^\\x20\\x09-\\x0D]+``, whole texts are judged, each document by itself: nothing is shuffled.

A document fails its base rule with fewer than 20 words, or if more than 30 % of them lie in 8-word windows found twice.
The method's verdict then comes from the suffix array (prefix doubling on the document's words) and its
longest-common-prefix table: an interval of the table is a maximal repeated substring; the spans of all those of at
least ``min_repeat`` words are united, and a document is rejected if they cover more than ``max_fraction`` of its words
or if the longest repeat exceeds ``max_repeat`` words. Only documents with a repeated 8-word window can have such a repeat,
so only they get a suffix array.

Null and empty texts have no words and fail; repeated rows are judged alike and an empty table gives no rows; bounds are
inclusive where a count ties with one; a very long text is judged whole, in the memory of one task (some 100 bytes a byte, more
for a suffix array); other columns, whatever their names, are passed on or ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from . import textbuf as tb

NGRAM = 8
SYMBOLS = tb.byte_set(b"#*$%&|<>")


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    max_repeat_percent: int = 30
    min_repeat: int = 10
    max_fraction: float = 0.25
    max_repeat: int = 100


def suffix_array(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of a sequence and, for each two neighbours in it, the length of their common prefix."""
    n = len(values)
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    levels, size = [rank], 1
    while size < n and rank.max() < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - size] = rank[size:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        levels.append(rank)
        size *= 2
    order = np.argsort(rank, kind="stable")
    a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, np.int64)
    for j in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = inside & (levels[j][np.minimum(a, n - 1)] == levels[j][np.minimum(b, n - 1)])
        # equal ranks of a length that reaches past the end would be equal suffixes: there are none
        common[same] += 1 << j
        a[same] += 1 << j
        b[same] += 1 << j
    return order, common


def repeats(values: np.ndarray, min_repeat: int) -> tuple[int, int]:
    """Positions covered by repeated substrings of at least ``min_repeat``, and the length of the longest repeat."""
    if len(values) < 2:
        return 0, 0
    order, common = suffix_array(values)
    longest = np.zeros(len(values), np.int64)
    longest[order[:-1]] = common
    longest[order[1:]] = np.maximum(longest[order[1:]], common)
    start = np.flatnonzero(longest >= min_repeat)
    return int(tb.covered(start, start + longest[start], len(values)).sum()), int(common.max())


def measure(part: pa.RecordBatch, rules: Rules) -> dict[str, np.ndarray]:
    buf, doc_off = tb.parts(part.column("text"))
    docs = len(part)
    start, end, off = tb.words(buf, doc_off, tb.SPACED)
    prints = tb.Prints(buf)
    values = prints.of(start, end)
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    chars = np.concatenate([[0], np.cumsum(points[end] - points[start])])
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[buf])])
    n_words = np.diff(off)

    feed = np.flatnonzero(buf == 10)
    begins = np.unique(np.concatenate([doc_off[:-1], feed + 1]))
    begins = begins[begins < len(buf)]
    of = np.searchsorted(doc_off, begins, "right") - 1
    ends = np.minimum(np.append(begins[1:], len(buf)), doc_off[of + 1])
    ends = ends - (buf[np.maximum(ends - 1, 0)] == 10) * (ends > begins)
    busy = np.searchsorted(start, ends) > np.searchsorted(start, begins)
    line, of = prints.of(begins[busy], ends[busy]), of[busy]
    order = np.lexsort((line, of))
    again = (line[order][1:] == line[order][:-1]) & (of[order][1:] == of[order][:-1])
    dup_lines = np.bincount(of[order][1:][again], minlength=docs)

    grams = tb.grams(values, NGRAM)
    word_doc = np.repeat(np.arange(docs), n_words)
    at = np.flatnonzero(word_doc[: len(grams)] == word_doc[NGRAM - 1 :][: len(grams)]) if len(grams) else np.zeros(0, np.int64)
    key = grams[at] + tb.mix(word_doc[at].astype(tb.U) + tb.U(1))
    order = np.argsort(key)
    same = (key[order][1:] == key[order][:-1]) & (word_doc[at[order][1:]] == word_doc[at[order][:-1]])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = tb.covered(at[twice], at[twice] + NGRAM, len(values))
    repeat_words = np.diff(np.concatenate([[0], np.cumsum(hit)])[off])

    covered, longest = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    for d in np.flatnonzero(repeat_words).tolist():
        covered[d], longest[d] = repeats(values[off[d] : off[d + 1]], rules.min_repeat)
    failed = (n_words < rules.min_words) | (100 * repeat_words > rules.max_repeat_percent * n_words)
    kept = ~failed & (covered <= rules.max_fraction * n_words) & (longest <= rules.max_repeat)
    return {
        "n_words": n_words, "word_chars": np.diff(chars[off]), "n_symbols": np.diff(symbols[doc_off]), "n_dup_lines": dup_lines, "n_repeat_words": repeat_words,
        "base_failed": failed, "kept": kept, "n_covered": covered, "longest_repeat": longest,
    }


_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_covered long, longest_repeat long"


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """Per document: its counts, base_failed, kept, the words that repeats cover and the longest repeat (in words)."""
    scratch.small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in tb.chunks(batch):
                found = measure(part, rules)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(v) if v.dtype == bool else pa.array(v, pa.int64()) for v in found.values())], ["doc_id", *found])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, _SCHEMA)


def passing(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """The documents that are kept, with all their columns."""
    scratch.small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in tb.chunks(batch):
                yield part.filter(pa.array(measure(part, rules)["kept"]))

    return scratch.kept(docs, run)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("longest_repeat")


def _windows(n: int) -> str:
    return f"""SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS times FROM (
    SELECT doc_id, p, array_to_string(w[p:p + {n - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {n - 1})) AS p FROM w WHERE len(w) >= {n}))"""


def _covered(name: str, n: int) -> str:
    return f"{name} AS (SELECT doc_id, count(DISTINCT q) AS {name} FROM (SELECT doc_id, unnest(generate_series(p, p + {n - 1})) AS q FROM ({_windows(n)}) WHERE times > 1) GROUP BY doc_id)"


OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
{_covered("r8", 8)}, {_covered("r10", 10)}, {_covered("r101", 101)},
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(r8, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(r10, 0) AS BIGINT) AS n_covered, coalesce(r101, 0) AS far
      FROM w LEFT JOIN r8 USING (doc_id) LEFT JOIN r10 USING (doc_id) LEFT JOIN r101 USING (doc_id) LEFT JOIN l USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 4 * n_covered <= n_words AND far = 0 AS kept, n_covered FROM f
"""
