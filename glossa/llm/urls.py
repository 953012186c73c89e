"""URL filter: rules for hosts and paths, and gradient-boosted trees on lexical features for what no rule covers.

Host: what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to
``?``, ``#`` or the end; both empty for a null url or one without ``://``. A rule fits its host and all its subdomains if
the path starts with the rule's; the longest wins.

The labelled urls are those that a rule covers, with its verdict, or those of a column of labels that is named. Features: lengths, depth, digit ratio, character
entropy, counts of parameters, subdomains, hyphens and
dots, the first digit of the path, and statistics of the host's suffix and of the path's first
part: how often they occur in the whole table, and the share of blocked urls among the labelled ones of other folds, smoothed. The trees
are trained on at most ``train_rows`` labelled urls, chosen by a hash of the url; one in five of the labelled urls is held
out from training and from the shares, for held_out(). If the labels name one verdict only, or none, the rest is allowed.

Everything runs in the JVM; what is joined is aggregated first, and suffixes that hold a large share of rows are left to
adaptive execution, which can split them. Null and empty urls have empty hosts and are judged by the trees; very long urls are
read whole; repeated rows are judged alike; of rules of equal length that both fit the later one wins; other columns, whatever
their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["length", "host_length", "path_length", "depth", "digits", "entropy", "params", "labels", "hyphens", "dots", "secure", "lead", "suffix_n", "suffix_rate", "part_n", "part_rate", "pair_rate"]
#: One in HELD labelled urls is held out.
HELD = 5
#: Folds of the training urls, for shares that leave out a url's own label.
FOLDS = 5
SMOOTH = 10.0


@dataclass(frozen=True)
class Training:
    train_rows: int = 50_000
    trees: int = 12
    depth: int = 4
    seed: int = 7


def split_url(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules: tuple[Rule, ...] = RULES, labels: str | None = None) -> DataFrame:
    """page_id, url, host, path, rule (null: none fits), the rule's verdict, and the label: that, or what the column says."""
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"), (F.col(labels) if labels else F.lit(None)).cast("string").alias("told"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rows.select("*", rule.alias("rule"), verdict.alias("ruled")).withColumn("told", F.coalesce("told", "ruled"))


def lexical(rows: DataFrame) -> DataFrame:
    text, n = F.coalesce("url", F.lit("")), F.greatest(F.length(F.coalesce("url", F.lit(""))), F.lit(1))
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    return rows.withColumns(
        {
            "length": n.cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": F.size(parts).cast("double"),
            "digits": count("[0-9]") / n,
            "entropy": F.aggregate(F.transform(F.array_distinct(F.split(text, "")), share), F.lit(0.0), lambda a, p: F.when(p > 0, a - p * F.log2(p)).otherwise(a)),
            "params": count("[?&;][^=&;#?]+="),
            "labels": (F.size(F.split("host", r"\.")) - 1).cast("double"),
            "hyphens": count("-"),
            "dots": count(r"\."),
            "secure": text.startswith("https:").cast("double"),
            "lead": F.coalesce(F.try_to_number(F.regexp_extract("path", "[0-9]", 0), F.lit("9")).cast("double"), F.lit(-1.0)),
            "suffix": F.element_at(F.split("host", r"\."), -1),
            "part": F.coalesce(F.get(parts, F.lit(0)), F.lit("")),
            "held": F.pmod(F.xxhash64(text, F.lit(1)), F.lit(HELD)) == 0,
            "label": F.when(F.col("told") == "block", 1.0).when(F.col("told") == "allow", 0.0),
        }
    )


def featured(pages: DataFrame, rules: tuple[Rule, ...] = RULES, labels: str | None = None) -> DataFrame:
    """All urls with their features; the statistics are counted over the whole table.

    A url's shares of blocked ones never count its own label: those of a training url are of the other folds.
    """
    rows = lexical(ruled(pages, rules, labels)).withColumn("fold", F.pmod(F.xxhash64("url", F.lit(3)), F.lit(FOLDS)).cast("int"))
    rows = scratch.saved(rows, "urls")
    known = F.when(~F.col("held"), F.col("label"))
    of = lambda f, x: F.when(F.col("fold") == f, x)
    by_fold = lambda x: F.array(*(F.coalesce(F.sum(of(f, x)), F.lit(0.0)) for f in range(FOLDS)))
    pair = rows.groupBy("suffix", "part").agg(F.count("*").alias("n"), by_fold(known.isNotNull().cast("double")).alias("k"), by_fold(known).alias("b"))
    pair = scratch.saved(pair, "url-pairs")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    # the share over all folds, then without each
    rates = lambda b, k: F.concat(F.array(rate(total(b), total(k))), F.transform(F.arrays_zip(b.alias("b"), k.alias("k")), lambda x: rate(total(b) - x["b"], total(k) - x["k"])))
    rate = lambda b, k: (b + SMOOTH / 2) / (k + SMOOTH)

    def one(c: str) -> DataFrame:
        sums = pair.groupBy(c).agg(F.log1p(F.sum("n")).alias(f"{c}_n"), *(F.array(*(F.sum(F.col(x)[f]) for f in range(FOLDS))).alias(x) for x in ("b", "k")))
        return sums.select(c, f"{c}_n", rates(F.col("b"), F.col("k")).alias(f"{c}_rates"))

    stats = pair.select("suffix", "part", rates(F.col("b"), F.col("k")).alias("pair_rates")).join(one("suffix"), "suffix").join(one("part"), "part")
    found = rows.join(scratch.saved(stats, "url-statistics"), ["suffix", "part"])
    which = F.when(known.isNotNull(), F.col("fold") + 1).otherwise(0)
    return found.withColumns({f"{c}_rate": F.get(f"{c}_rates", which) for c in ("suffix", "part", "pair")})


def trained(rows: DataFrame, training: Training = Training()) -> Model | None:  # noqa: B008
    labelled = rows.where("label is not null and not held")
    n, low, high = labelled.agg(F.count("*"), F.min("label"), F.max("label")).first()
    if low == high:
        return None
    share = min(1.0, training.train_rows / n)
    chosen = labelled.where(F.pmod(F.xxhash64("url", F.lit(2)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    sample = scratch.saved(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(chosen).select("features", "label"), "url-sample")
    return GBTClassifier(maxIter=training.trees, maxDepth=training.depth, seed=training.seed, featureSubsetStrategy="all").fit(sample.repartition(max(1, -(-int(n * share) // 20_000))))


def judged(rows: DataFrame, model: Model | None) -> DataFrame:
    """``said``: the trees' verdict on every url."""
    if model is None:
        return rows.withColumn("said", F.lit("allow"))
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
    return scored.withColumn("said", F.when(F.col("prediction") == 1.0, "block").otherwise("allow"))


def filtered(pages: DataFrame, rules: tuple[Rule, ...] = RULES, training: Training = Training(), labels: str | None = None) -> DataFrame:  # noqa: B008
    """page_id, host, path, rule, verdict."""
    rows = featured(pages, rules, labels)
    return judged(rows, trained(rows, training)).select("page_id", "host", "path", "rule", F.coalesce("ruled", "said").alias("verdict"))


def held_out(pages: DataFrame, rules: tuple[Rule, ...] = RULES, training: Training = Training(), labels: str | None = None) -> float:  # noqa: B008
    """The share of held-out labelled urls that the trees judge as their label says."""
    rows = featured(pages, rules, labels)
    return judged(rows, trained(rows, training)).where("held and label is not null").agg(F.avg((F.col("said") == F.col("told")).cast("double"))).first()[0]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark.read.parquet(f"{sf_dir}/pages.parquet"))
