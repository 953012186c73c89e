"""Term-weight providers: a weight table, what to do about missing terms, and transforms."""

from __future__ import annotations

from numbers import Number

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import terms


class TermWeights:
    """Weights of requested terms. missing: "error" raises, "ignore" (and any other word, and 0) drops the term, a number
    stands in for it and is transformed like a weight. inverse: 1 / x. sublinear: ln x, after the inverse."""

    def __init__(self, missing="error", inverse: bool = False, sublinear: bool = False):
        if not isinstance(missing, (str, Number)):
            raise ValueError("missing is error, ignore or a number")
        self.missing, self.inverse, self.sublinear = missing, inverse, sublinear

    def table(self, requests: DataFrame) -> DataFrame:
        """term, weight of the requested terms; subclasses provide it."""
        raise NotImplementedError

    def weights(self, requests: DataFrame) -> DataFrame:
        """requests: term and any other columns, kept in full; adds weight."""
        found = requests.join(self.table(requests), "term", "left")
        weight = F.col("weight").cast("double")
        if self.missing == "error":
            weight = F.coalesce(weight, F.raise_error(F.concat(F.lit("no weight for term: "), F.coalesce("term", F.lit("null")))).cast("double"))
        elif isinstance(self.missing, Number) and self.missing:
            weight = F.coalesce(weight, F.lit(float(self.missing)))
        else:
            found = found.where(F.col("weight").isNotNull())
        if self.inverse:
            weight = F.lit(1.0) / weight
        if self.sublinear:
            weight = F.ln(weight)
        return found.withColumn("weight", weight)

    def __getitem__(self, request):
        """One pair for a string (None if it has no weight); a list of pairs in request order for a list or tuple."""
        many = isinstance(request, (list, tuple))
        asked = list(request) if many else [request]
        spark = SparkSession.active()
        rows = self.weights(spark.createDataFrame(list(enumerate(asked)), "pos long, term string")).orderBy("pos").collect()  # as many as were asked for
        pairs = [(r["term"], r["weight"]) for r in rows]
        return pairs if many else pairs[0] if pairs else None


class CountWeights(TermWeights):
    """Relative frequency, from rows (term, count)."""

    def __init__(self, counts: DataFrame, min_count: int = 1, **kw):
        super().__init__(**kw)
        self._weights = terms.relative_frequency(counts, min_count)

    def table(self, requests):
        return self._weights


class DocumentRatioWeights(TermWeights):
    """The share of documents that hold the term; only requested terms are counted."""

    def __init__(self, docs: DataFrame, **kw):
        super().__init__(**kw)
        self._weights = terms.document_ratio(docs)

    def table(self, requests):
        return self._weights.join(requests.select("term").distinct(), "term", "left_semi")


class IdfWeights(TermWeights):
    """How often the term is requested, times log2(documents / document frequency); a weight of zero counts as missing."""

    def __init__(self, docs: DataFrame, **kw):
        super().__init__(**kw)
        self._weights = terms.idf_log2(docs)

    def table(self, requests):
        asked = requests.groupBy("term").agg(F.count("*").alias("times"))
        return self._weights.join(asked, "term").select("term", (F.col("weight") * F.col("times")).alias("weight")).where("weight <> 0")


class StoredWeights(TermWeights):
    """Weights kept in a table; what is added later wins."""

    def __init__(self, spark: SparkSession, path: str, initial: DataFrame | None = None, **kw):
        super().__init__(**kw)
        self.spark, self.path = spark, path
        if initial is not None:
            self.add(initial)

    def add(self, weights: DataFrame) -> None:
        # a number after the last one stored, so that two additions within one tick of a clock keep their order
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)
        last = (self._rows().agg(F.max("at")).first()[0] or 0) if there else 0
        weights.select("term", F.col("weight").cast("double").alias("weight"), F.lit(last + 1).cast("long").alias("at")).write.mode("append").parquet(self.path)

    def _rows(self) -> DataFrame:
        return self.spark.read.schema("term string, weight double, at long").parquet(self.path)

    def table(self, requests):
        return self._rows().groupBy("term").agg(F.max_by("weight", F.struct("at", "weight")).alias("weight"))
