"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch between the JVM and Python; rows of long texts then travel in small batches.
ARROW_BATCH_BYTES = 8 << 20
#: Rows of one Arrow batch.
ARROW_BATCH_ROWS = 2000
NULL_ID = -(2**63)


def root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir`` as a full URI; a new one only where it is unset and the session is local.

    A path without a scheme is of the cluster's default file system; on a cluster that may not be a machine's own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not found:
        try:
            found = sc.getCheckpointDir()
        except Exception:
            found = None
    local = sc.master.startswith("local")
    if not found:
        if not local:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="glossa-"))
        found = sc.getCheckpointDir()
    plain = ":" not in found.split("/")[0]
    p = spark._jvm.org.apache.hadoop.fs.Path(found)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")
    if plain and full.startswith("file:") and not local:
        raise ValueError(f"spark.checkpoint.dir is {found}, which names a folder of each machine; give a URI of one that all share")
    return full


def path(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, so that a Python worker's memory doesn't follow the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


#: Paths written within the scopes that are open, the innermost last.
_scopes: list[list[tuple[SparkSession, str]]] = []
#: Bytes of input that one bucket or shard holds, where that needs more of them than spark.sql.shuffle.partitions.
PART_BYTES = 512 << 20


@contextmanager
def scope() -> Iterator[None]:
    """What saved() writes in here is deleted at the end, unless it was written with ``keep``; kept tables pass to the scope around."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, where in _scopes.pop():
            p = spark._jvm.org.apache.hadoop.fs.Path(where)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def saved(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: lineage ends here and a lost executor costs nothing."""
    spark = df.sparkSession
    where = path(spark, name)
    df.write.option("compression", "zstd").parquet(where)
    for own in _scopes[-2:-1] if keep else _scopes[-1:]:
        own.append((spark, where))
    return spark.read.schema(df.schema).parquet(where)


def parts(df: DataFrame) -> int:
    """Into how many parts a table is divided: spark.sql.shuffle.partitions, more where its files are large."""
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # of rows whose size it doesn't know Spark assumes about 2**63 bytes
    return max(least, min(most, -(-size // PART_BYTES))) if size < 1 << 55 else least


def bucketed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """As saved(), hash-bucketed by the keys: later joins on them move only the other side, never the texts again.

    The catalogue's entry goes as soon as the table has been resolved; its files stay as long as the shared folder's do.
    """
    spark = df.sparkSession
    n = parts(df)
    table = f"{name}_{uuid.uuid4().hex}"
    (df.repartition(n, *keys).write.format("parquet").option("compression", "zstd").option("path", path(spark, name)).bucketBy(n, *keys).saveAsTable(table))
    found = spark.table(table)
    found.schema  # noqa: B018
    spark.sql(f"DROP TABLE {table}")
    return found


def keyed(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, text and a row key (k1, k2) without nulls: repeated ids with other texts stay apart; a null id counts as the smallest.

    carry: also ``rest``, a struct of all columns but the text, whatever their names.
    """
    columns = [
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("k1"),
        F.xxhash64(F.col("text"), F.col("doc_id").isNull()).alias("k2"),
    ]
    if carry:
        quoted = (c.replace("`", "``") for c in docs.columns if c != "text")
        columns.append(F.struct(*(F.col(f"`{c}`") for c in quoted)).alias("rest"))
    return docs.select(*columns)


def kept(docs: DataFrame, run: Callable) -> DataFrame:
    """mapInArrow of a function that only drops rows. Spark takes names there as paths, so further columns go by number meanwhile."""
    plain = docs.toDF(*(c if c in ("doc_id", "text") else f"_{i}" for i, c in enumerate(docs.columns)))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
