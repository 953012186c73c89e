"""Concepts that connect terms: eigenvector centrality over their hypernyms."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _shared(df: DataFrame) -> DataFrame:
    """Cuts lineage with a checkpoint in the folder that the session names; a new folder only where none is, in local mode."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir() and not df.sparkSession.conf.get("spark.checkpoint.dir", None):
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="glossa-"))
    return df.checkpoint()


def paths(terms: DataFrame, senses: DataFrame, hypernyms: DataFrame) -> DataFrame:
    """term, nodes: array of (node, w), from the term (w: its score) up through its first sense's hypernyms by distance.

    terms (term, score); senses (term, synset, sense_rank); hypernyms (synset, hypernym, distance). Terms without a sense go;
    a name ends at its first dot.
    """
    first = senses.groupBy("term").agg(F.min_by("synset", "sense_rank").alias("synset"))
    ups = hypernyms.groupBy("synset").agg(F.array_sort(F.collect_list(F.struct("distance", "hypernym"))).alias("ups"))
    rows = terms.join(first, "term").join(ups, "synset", "left")
    above = F.transform(F.coalesce("ups", F.array().cast("array<struct<distance:int,hypernym:string>>")), lambda u: F.struct(F.substring_index(u["hypernym"], ".", 1).alias("node"), F.lit(1.0).alias("w")))
    return rows.select("term", F.concat(F.array(F.struct(F.col("term").alias("node"), F.col("score").cast("double").alias("w"))), above).alias("nodes"))


def common_root(found: DataFrame) -> str | None:
    """The lowest node that all paths share from the top down."""
    tops = found.select("term", F.posexplode(F.reverse("nodes")).alias("level", "n")).groupBy("level").agg(F.count_distinct("n.node").alias("k"), F.count("*").alias("c"), F.min("n.node").alias("node"))
    total = found.count()
    agreed = tops.where((F.col("k") == 1) & (F.col("c") == total))
    broken = tops.where((F.col("k") > 1) | (F.col("c") < total)).agg(F.min("level").alias("at"))
    row = agreed.crossJoin(F.broadcast(broken)).where(F.col("at").isNull() | (F.col("level") < F.col("at"))).orderBy(F.desc("level")).select("node").first()  # one row
    return row[0] if row else None


def edges(found: DataFrame, root: str | None) -> DataFrame:
    """src, dst, w: undirected, each once, consecutive nodes of the paths up to the root; the weight of the lower node, of
    the last term (in order of terms) where paths disagree."""
    upto = F.when(F.lit(root).isNull() | ~F.exists("nodes", lambda n: n["node"] == root), F.size("nodes")).otherwise(F.array_position(F.transform("nodes", lambda n: n["node"]), F.lit(root)).cast("int"))
    rows = found.select("term", F.slice("nodes", F.lit(1), upto).alias("nodes"))
    pairs = F.transform(F.slice("nodes", F.lit(1), F.size("nodes") - 1), lambda n, i: F.struct(n["node"].alias("a"), F.element_at("nodes", (i + 2).cast("int"))["node"].alias("b"), n["w"].alias("w"), i.alias("i")))
    flat = rows.where(F.size("nodes") > 1).select("term", F.inline(pairs)).where("a <> b")
    return flat.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.max_by("w", F.struct("term", "i")).alias("w"))


def centrality(graph: DataFrame, rounds: int = 40, tolerance: float = 1e-6) -> DataFrame:
    """node, score: the leading eigenvector of the weighted graph, of unit length and positive, by power iteration with a
    shift (each node keeps its own score, so bipartite graphs converge too). A round is two steps and one checkpoint, so
    plans never grow; only the norm and the largest change, two numbers, come to the driver."""
    both = _shared(graph.select("src", "dst", "w").unionByName(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")))
    scores = both.select(F.col("src").alias("node")).distinct().withColumn("score", F.lit(1.0))
    norm = 1.0
    for _ in range(rounds):
        new = scores
        for _ in range(2):
            sums = both.join(new, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), (F.col("w") * F.col("score")).alias("score"))
            new = sums.unionByName(new.select("node", "score")).groupBy("node").agg(F.sum("score").alias("score"))
        new = _shared(new.select("node", (F.col("score") / norm).alias("score")))
        last, norm = norm, new.agg(F.sqrt(F.sum(F.col("score") * F.col("score")))).first()[0]
        if norm is None:
            return new
        step = new.join(scores.withColumnRenamed("score", "old"), "node").agg(F.max(F.abs(F.col("score") / norm - F.col("old") / last))).first()[0]
        scores = new
        if step < tolerance:
            break
    return scores.select("node", (F.col("score") / norm).alias("score"))


def concepts(terms: DataFrame, senses: DataFrame, hypernyms: DataFrame) -> DataFrame:
    """node, score, the most central first."""
    found = _shared(paths(terms, senses, hypernyms))
    return centrality(edges(found, common_root(found))).orderBy(F.desc("score"), "node")
