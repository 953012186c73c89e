"""Supervised term weights from a document-term matrix X(doc_id, term, cnt) and classes y(doc_id, class).

Everything follows from four counts: documents with the term, documents of the class, both, and all documents. Tables of
absent terms or other classes are differences of these; the matrices never meet row by row. Presence counts are unsmoothed;
joint cells that are zero become 1e-12 before they are normalised; logarithms of what isn't positive are null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-12
METHODS = ("mi", "pmi", "npmi", "ppmi_exp", "pmi_k", "ppmi", "cp_raw", "cp_ratio")


def smoothed(c: Column) -> Column:
    return F.when(c == 0, F.lit(EPS)).otherwise(c.cast("double"))


def marginal(X: DataFrame, docs: int | Column, key: str = "term") -> DataFrame:
    """key, p: the share of documents where it is positive."""
    return X.where("cnt > 0").groupBy(key).agg((F.count_distinct("doc_id") / F.lit(docs)).alias("p"))


def tables(X: DataFrame, y: DataFrame) -> DataFrame:
    """Every term with every class: n11 (documents), n1 (term), m1 (class), n (all), and x, the summed counts of both."""
    y = y.select("doc_id", "class").distinct()
    docs = y.agg(F.count_distinct("doc_id").alias("n"))
    X = X.join(y.select("doc_id").distinct(), "doc_id", "left_semi")
    both = X.join(y, "doc_id").groupBy("term", "class").agg(F.sum(F.when(F.col("cnt") > 0, 1).otherwise(0)).alias("n11"), F.sum("cnt").alias("x"))
    term = X.groupBy("term").agg(F.sum(F.when(F.col("cnt") > 0, 1).otherwise(0)).alias("n1"))
    cls = y.groupBy("class").agg(F.count("*").alias("m1"))
    every = term.crossJoin(F.broadcast(cls.crossJoin(docs)))  # terms by classes, of which there are few; documents aren't in it
    return every.join(both, ["term", "class"], "left").fillna(0, ["n11", "x"])


def point_joint(t: DataFrame) -> DataFrame:
    """Adds j: the smoothed share of the term and class in all counts."""
    total = t.agg(F.sum(smoothed(F.col("x"))).alias("total"))
    return t.crossJoin(F.broadcast(total)).withColumn("j", smoothed(F.col("x")) / F.col("total"))  # one row


def full_joint(t: DataFrame) -> DataFrame:
    """Adds q11, q10, q01, q00: (term, class), (term, other), (no term, class), (neither), as shares of the sum of all cells."""
    cells = {"q11": F.col("n11"), "q10": F.col("n1") - F.col("n11"), "q01": F.col("m1") - F.col("n11"), "q00": F.col("n") - F.col("n1") - F.col("m1") + F.col("n11")}
    t = t.withColumns({k: smoothed(v) for k, v in cells.items()})
    total = t.agg(F.sum(F.col("q11") + F.col("q10") + F.col("q01") + F.col("q00")).alias("total"))
    return t.crossJoin(F.broadcast(total)).withColumns({k: F.col(k) / F.col("total") for k in cells})  # one row


def _ln(c: Column) -> Column:
    return F.when(c > 0, F.ln(c))


def mutual_information(t: DataFrame) -> DataFrame:
    """term, weight: summed over classes and cells; cells are shares of all cells, marginals of documents."""
    pt, pc = F.col("n1") / F.col("n"), F.col("m1") / F.col("n")
    part = lambda q, a, b: F.when(a * b > 0, F.col(q) * _ln(F.col(q) / F.when(a * b > 0, a * b)))
    sums = part("q11", pt, pc) + part("q10", pt, 1 - pc) + part("q01", 1 - pt, pc) + part("q00", 1 - pt, 1 - pc)
    return full_joint(t).groupBy("term").agg(F.sum(sums).alias("weight"))


def pointwise(t: DataFrame, normalise: bool = False, k: float | None = None, positive: str | None = None) -> DataFrame:
    """term, weight: the largest ln(j / (p_t p_c)) over classes. k: j to the k-th power first; normalise: divided by -ln j;
    positive: "cutoff" makes negatives 0, "exp" takes e to the power."""
    j = F.col("j") if k is None else F.pow("j", F.lit(k))
    m = _ln(j / (F.col("n1") / F.col("n") * (F.col("m1") / F.col("n"))))
    if normalise:
        m = m / (-_ln(j))
    if positive == "cutoff":
        m = F.greatest(m, F.lit(0.0))
    elif positive == "exp":
        m = F.exp(m)
    return point_joint(t).groupBy("term").agg(F.max(m).alias("weight"))


def conditional(t: DataFrame, ratio: bool = False) -> DataFrame:
    """term, weight: the largest P(class | term) over classes, or its ratio to P(class)."""
    p = F.col("j") / (F.col("n1") / F.col("n"))
    return point_joint(t).groupBy("term").agg(F.max(p / (F.col("m1") / F.col("n")) if ratio else p).alias("weight"))


def term_weights(X: DataFrame, y: DataFrame, method: str = "mi", pmi_k: float = 2) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"method is one of {', '.join(METHODS)}")
    t = tables(X, y)
    return {
        "mi": lambda: mutual_information(t),
        "pmi": lambda: pointwise(t),
        "npmi": lambda: pointwise(t, normalise=True),
        "ppmi_exp": lambda: pointwise(t, normalise=True, positive="exp"),
        "pmi_k": lambda: pointwise(t, normalise=True, k=pmi_k),
        "ppmi": lambda: pointwise(t, positive="cutoff"),
        "cp_raw": lambda: conditional(t),
        "cp_ratio": lambda: conditional(t, ratio=True),
    }[method]()


@dataclass
class TermWeighting:
    """fit() learns the weights, transform() scales the terms' counts by them."""

    method: str = "mi"
    pmi_k: float = 2
    weights: DataFrame | None = None

    def fit(self, X: DataFrame, y: DataFrame) -> TermWeighting:
        self.weights = term_weights(X, y, self.method, self.pmi_k)
        return self

    def transform(self, X: DataFrame) -> DataFrame:
        return X.join(self.weights, "term").select("doc_id", "term", (F.col("cnt") * F.col("weight")).alias("weight"))
