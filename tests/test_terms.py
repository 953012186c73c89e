"""Term counts, providers, significant terms and supervised weights, on hand-computed cases."""

import math

import pytest
from pyspark.sql import functions as F

from glossa.functions import text as tx
from glossa.operators import supervised, terms, weights

COUNTS = [("ba", 2), ("foo", 1), ("ba", 1), ("knark", 1), ("knirk", 1), ("ba", 1), ("knark", 1)]
DOCS = ["foo", "knark", "ba", "knirk", "ba", "ba", "knark", "ba"]


def table(df):
    return {r["term"]: r["weight"] for r in df.collect()}


@pytest.fixture(scope="module")
def counts(spark):
    return spark.createDataFrame(COUNTS, "term string, count long")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(DOCS)), "doc_id int, text string")


def test_relative_frequency(spark):
    c = spark.createDataFrame([("foo", 2), ("ba", 1), ("knark", 4), ("knirk", 1)], "term string, count long")
    assert table(terms.relative_frequency(c)) == {"ba": 0.125, "foo": 0.25, "knark": 0.5, "knirk": 0.125}
    assert table(terms.relative_frequency(c, 4)) == {"knark": 0.5}
    assert table(terms.relative_frequency(spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "term string, count long"), 2)) == {"b": 0.5}


TRANSFORMS = [({}, (0.5, 0.25, 0.125)), ({"inverse": True}, (2, 4, 8)), ({"sublinear": True}, tuple(map(math.log, (0.5, 0.25, 0.125)))), ({"inverse": True, "sublinear": True}, tuple(map(math.log, (2, 4, 8))))]


@pytest.mark.parametrize("options,want", TRANSFORMS)
@pytest.mark.parametrize("kind", ["counts", "documents"])
def test_providers(spark, counts, docs, options, want, kind):
    p = weights.CountWeights(counts, **options) if kind == "counts" else weights.DocumentRatioWeights(docs, **options)
    got = dict(p[["ba", "knark", "knirk", "foo"]])
    assert [got[t] for t in ("ba", "knark", "knirk")] == pytest.approx(want) and got["foo"] == pytest.approx(want[2])
    assert p["ba"] == ("ba", pytest.approx(want[0]))


def test_missing(spark, counts):
    with pytest.raises(Exception, match="no weight for term"):
        weights.CountWeights(counts)["notfound"]
    for policy in ("ignore", "anything", 0):
        p = weights.CountWeights(counts, missing=policy)
        assert p["notfound"] is None and p[["notfound", "ba", "ba"]] == [("ba", 0.5), ("ba", 0.5)]
    assert weights.CountWeights(counts, missing=0.25, inverse=True)["notfound"] == ("notfound", 4.0)
    with pytest.raises(ValueError):
        weights.CountWeights(counts, missing=[])


def test_idf_and_stored(spark, docs, tmp_path):
    assert dict(weights.IdfWeights(docs)[["ba", "knark", "knirk", "foo"]]) == {"ba": 1, "knark": 2, "knirk": 3, "foo": 3}
    initial = spark.createDataFrame([("ba", 1.0), ("knark", 2.0)], "term string, weight double")
    p = weights.StoredWeights(spark, str(tmp_path / "weights"), initial)
    p.add(spark.createDataFrame([("ba", 7.0)], "term string, weight double"))
    assert p[["knark", "ba"]] == [("knark", 2.0), ("ba", 7.0)]


def test_significant_terms(spark):
    d = spark.createDataFrame([(1, "foo ba knark foo knirk knark foo"), (2, "ba ba knirk"), (3, None)], "doc_id int, text string")
    assert {r["term"]: r["tf"] for r in terms.term_frequencies(d).where("doc_id = 1").collect()} == {"foo": 3, "knark": 2, "ba": 1, "knirk": 1}
    got = [(r["doc_id"], r["term"], round(r["score"], 6)) for r in terms.lift(d).orderBy("doc_id", "rank").collect()]
    assert got == [(1, "foo", 1.428571), (1, "knark", 1.428571), (1, "knirk", 0.714286), (1, "ba", 0.47619), (2, "ba", 2.222222), (2, "knirk", 1.666667)]
    assert terms.lift(d, doc_id=99).count() == 0
    assert [r["term"] for r in terms.weighted(d, n=1).orderBy("doc_id").collect()] == ["foo", "ba"]


def test_vocabulary_and_tfidf(spark, docs):
    assert [(r["id"], r["term"], r["df"]) for r in terms.vocabulary(docs, 2, 0.5).orderBy("id").collect()] == [(0, "ba", 4), (1, "knark", 2)]
    assert terms.vocabulary(docs, 1, 1.0, keep=2).count() == 2
    for d, n in terms.tfidf(docs).groupBy("doc_id").agg(F.sum(F.col("weight") ** 2)).collect():
        assert n == pytest.approx(1)


X = [(0, 1, 1), (1, 0, 1), (2, 0, 1), (2, 1, 1)]
Y = [(0, 1), (1, 0), (2, 0)]
WANT = {"mi": (-0.37489, -0.605939), "pmi": (0.117783, 0.117783), "npmi": (0.1699, 0.0850), "ppmi": (0.117783, 0.117783), "ppmi_exp": (1.185216, 1.088677), "pmi_k": (-0.415037, -0.457519), "cp_raw": (0.75, 0.375), "cp_ratio": (1.125, 1.125)}


@pytest.fixture(scope="module")
def matrix(spark):
    return spark.createDataFrame(X, "doc_id int, term int, cnt int"), spark.createDataFrame(Y, "doc_id int, class int")


@pytest.mark.parametrize("method", WANT)
def test_supervised(matrix, method):
    assert table(supervised.term_weights(*matrix, method)) == {0: pytest.approx(WANT[method][0], abs=1e-4), 1: pytest.approx(WANT[method][1], abs=1e-4)}


def test_joint_tables(matrix):
    t = supervised.tables(*matrix)
    assert {(r["term"], r["class"]): round(r["j"], 4) for r in supervised.point_joint(t).collect()} == {(0, 0): 0.5, (0, 1): 0.0, (1, 0): 0.25, (1, 1): 0.25}
    got = {(r["term"], r["class"]): [round(r[q], 4) for q in ("q11", "q10", "q01", "q00")] for r in supervised.full_joint(t).collect()}
    assert got == {(0, 0): [0.1667, 0, 0, 0.0833], (0, 1): [0, 0.1667, 0.0833, 0], (1, 0): [0.0833, 0.0833, 0.0833, 0], (1, 1): [0.0833, 0.0833, 0, 0.0833]}


def test_weighting(matrix):
    x, y = matrix
    got = {(r["doc_id"], r["term"]): round(r["weight"], 5) for r in supervised.TermWeighting("mi").fit(x, y).transform(x).collect()}
    assert got == {(0, 1): -0.60594, (1, 0): -0.37489, (2, 0): -0.37489, (2, 1): -0.60594}
    with pytest.raises(ValueError):
        supervised.term_weights(x, y, "other")


def test_text_functions(spark):
    d = spark.createDataFrame([("Dette er vårt hus. Bananer-kake", "&#65;&#x42;&amp;&nix;", "http://x.no/a/b.tar.gz?y")], "t string, e string, u string")
    r = d.select(tx.unicode_words("t").alias("w"), tx.keyword_tokens(F.col("t")).alias("k"), tx.sentences(F.col("t")).alias("s"), tx.unescape("e").alias("e"), tx.url_file_name(F.col("u")).alias("f"), tx.upper_first(F.lit("åb")).alias("u"), tx.match_or_null(F.col("t"), "(hus)").alias("m"), tx.match_or_null(F.col("t"), "(nix)").alias("n"), tx.nfc(F.lit("å")).alias("c"), tx.normal_title(F.lit("mal:_foo  bar"), {"mal": "Mal"}).alias("nt"), tx.compatible_tokens(F.lit("ﬁN x")).alias("ct"), tx.numeric_entity(F.lit("65")).alias("ne"), tx.one_line(F.lit("a\nb")).alias("ol"), tx.lower_first(F.lit("AB")).alias("lf")).first()
    assert r["w"][:5] == ["Dette", "er", "vårt", "hus", "."] and r["k"] == ["dette", "er", "vårt", "hus", "bananer", "kake"]
    assert r["s"] == ["Dette er vårt hus.", "Bananer-kake"] and r["e"] == "AB&&nix;" and r["f"] == "b.tar.gz" and r["u"] == "Åb"
    assert (r["m"], r["n"], r["c"], r["nt"], r["ct"], r["ne"], r["ol"], r["lf"]) == ("hus", None, "å", "Mal:Foo bar", ["fin", "x"], "A", "a b", "aB")


def test_first_letters_of_one_character(spark):
    """Full case mappings make two characters of some; SQL's mapping makes one."""
    import duckdb

    later = (0x19B, 0x264)  # Unicode 16 has capitals of these, DuckDB's tables don't
    texts = [chr(c) + "x" for c in (*range(1, 0x250), *range(0x370, 0x590), *range(0x1E00, 0x2000), *range(0xFB00, 0xFB18)) if c not in later] + ["", "ß", "ẞheit"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.upper_first(F.col("t")), tx.lower_first(F.col("t"))).collect()
    want = duckdb.sql("select t, upper(t[1]) || t[2:], lower(t[1]) || t[2:] from (select unnest($texts) as t)", params={"texts": texts}).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_bag_of_words_whole_vocabulary(spark, tmp_path):
    """Its SQL has no limit, so more terms than the operator keeps by default all have an id."""
    from glossa.plans import registry

    text = " ".join("".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(100_001))
    spark.createDataFrame([(i, text if i < 5 else "x") for i in range(11)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.bag_of_words(spark, str(tmp_path)).agg(F.count("*"), F.count_distinct("id"), F.max("id")).first()
    assert tuple(got) == (500_005, 100_001, 100_000)
