"""Counts of one Arrow pass against SQL, and queries that are built on them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from glossa.functions import counts
from glossa.operators import terms, topics
from glossa.plans import registry

ODD = ["Ære ære, x½ ②Ⅷ 9a", "", None, "İstanbul ΑΣ ας ß ẞ", "日本語 𝒳𝒴 a\U00020000b", "é́ a­b", "-", "a" * 70_000, "x y " * 30_000, "ü", "ö\tä\nå", " lead", "trail "]


def sql(rows, name):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    for row in rows:
        con.execute("insert into documents values (?, ?)", row)
    return sorted(con.execute(registry.ORACLE_SQL[name]).fetchall(), key=repr)


@pytest.mark.parametrize("rows", [list(enumerate(ODD)), [(i % 5, t) for i, t in enumerate(ODD)], [(1, "a b"), (1, "a b"), (None, "c"), (None, "c d")], []], ids=["plain", "repeated", "null", "empty"])
def test_counts_as_sql(spark, rows, monkeypatch):
    monkeypatch.setattr(counts, "CHUNK_ROWS", 7)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = terms.term_frequencies(docs).select("doc_id", "term", "tf", "doc_len")
    assert sorted(map(tuple, got.collect()), key=repr) == sql(rows, "term_frequencies")
    total = terms.relative_frequency(terms.term_counts(docs), min_count=2).select("term", F.round("weight", 9))
    assert sorted(map(tuple, total.collect()), key=repr) == sql(rows, "token_counts")


def test_counts_are_not_shuffled(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    assert "Exchange" not in terms.term_frequencies(docs)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("cells", [1, 8, 1 << 22])
def test_hits_held_as_joined(spark, cells, monkeypatch):
    """Ties, more hits than asked for, queries without a hit, repeated terms: held queries give what the join gives."""
    words = "a b c d e f g".split()
    docs = spark.createDataFrame([(i, " ".join(words[(i * k) % 7] for k in range(1, 2 + i % 6))) for i in range(60)] + [(60, None), (61, "")], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([("q1", "a"), ("q1", "a"), ("q1", "c"), ("q2", "g"), ("q3", "none"), ("q4", "b"), ("q4", "none"), ("q4", None)], "query string, term string").where("term is not null")
    monkeypatch.setattr(counts, "CELLS", cells)
    held = topics.hits(asked, docs, n=3)
    assert "MapInArrow" not in held._jdf.queryExecution().executedPlan().toString()  # what follows repeats none of it
    monkeypatch.setattr(topics, "MOST_ASKED", 0)
    joined = topics.hits(asked, docs, n=3)
    assert held.schema["doc_id"].dataType == joined.schema["doc_id"].dataType
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, joined.collect()))


def test_batches_are_bounded(spark, tmp_path, monkeypatch):
    """A worker's memory doesn't follow the number of rows of a file."""
    from glossa.plans import formats

    keys = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    old = [spark.conf.get(k) for k in keys]
    monkeypatch.setattr(counts, "BATCH_ROWS", 50)
    spark.range(300).selectExpr("id as doc_id", "'a' as text", "'x' as source", "'en' as lang", "1l as n_chars").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(b)])], ["n"])

    try:
        for read in (registry._docs, registry._docs_all, formats._all):
            spark.conf.set(keys[0], "10000")
            assert read(spark, str(tmp_path)).select("doc_id").mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] <= 50
        spark.conf.set(keys[0], "7")
        counts.small_batches(spark)
        assert spark.conf.get(keys[0]) == "7"
    finally:
        for k, v in zip(keys, old, strict=True):
            spark.conf.set(k, v)
