"""Token counts: totals by source, language and tokenizer version, maintained by signed deltas.

A ledger is a folder. A batch turns inserts (+), deletes (-) and revised counts (- old, + new) into one delta row per group,
pre-aggregated before it is shuffled, and writes them to a folder of its own. It is committed by a marker that bears the
batch's id and names that folder: the marker is moved into place in one step that fails if there is one, so of two writers
of one id one counts, and a retried or replayed batch changes nothing; data that no marker names don't count. Totals are the
sum of the deltas of committed batches. compact() replaces the deltas of all batches by their sum; their markers stay, so
their ids stay committed.

Nulls in source, language or version are a group of their own; null and empty texts count no tokens, and documents still
count; very long texts are counted whole; repeated rows count as often as they occur, so ties need no order; groups whose
documents and tokens all cancel are dropped; an empty batch commits no rows, an empty ledger has no totals; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from . import textbuf as tb
from .tokens import ENCODE_BYTES, Encoder, versioned

GROUP = ["source", "lang", "tokenizer"]
_SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"

#: Tokenizer versions of the query, old and new: byte-level BPE files of 50,000 merges, for English and for many languages.
OLD, NEW = "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"


def sized(docs: DataFrame, *tokenizers: str) -> DataFrame:
    """doc_id, source, lang and ``sizes``: each text's number of ids under each tokenizer. Texts are read once and don't move."""
    scratch.small_batches(docs.sparkSession)
    files = [versioned(t) for t in tokenizers]

    def run(batches):
        for batch in batches:
            for part in tb.chunks(batch, limit=ENCODE_BYTES):
                buf, off = tb.parts(part.column("text"))
                sizes = np.stack([np.diff(Encoder.of(f).encode(buf, off, None)[1]) for f in files], 1)
                column = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * len(files)), pa.array(sizes.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), part.column("lang"), column], ["doc_id", "source", "lang", "sizes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    return rows.mapInArrow(run, "doc_id long, source string, lang string, sizes array<long>")


def counted(docs: DataFrame, version: str, tokens: Column) -> DataFrame:
    """Rows of a batch: the groups' columns and a token count."""
    return docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(version).alias("tokenizer"), F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"))


class Ledger:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *names: str):
        return self._hadoop.Path("/".join([self.folder, *names]))

    def _names(self, kind: str) -> list[str]:
        p = self._path(kind)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _publish(self, kind: str, name: str, said: dict) -> bool:
        """Puts a marker into place in one step; False if there is one."""
        new, at = self._path("pending", uuid.uuid4().hex), self._path(kind, name)
        local = self._fs.getScheme() == "file"
        # a local file's checksum is a file of its own, which could be another writer's: such markers have none
        fs = self._fs.getRaw() if local else self._fs
        out = fs.create(new, False)
        out.write(json.dumps(said).encode())
        out.close()
        self._fs.mkdirs(self._path(kind))
        if local:
            return self._linked(new, at)
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        never_over = self.spark._sc._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            context.rename(self._fs.makeQualified(new), self._fs.makeQualified(at), never_over)
        except Exception as e:
            self._fs.delete(new, False)
            if not self._fs.exists(at):
                raise PySparkException(f"can't commit {name}") from e
            return False
        return True

    def _linked(self, new, at) -> bool:
        """Of local files, a rename looks before it moves, so that of two writers both may; only one can make a link."""
        file = lambda p: self.spark._jvm.java.io.File(p.toUri().getPath())
        try:
            self.spark._jvm.java.nio.file.Files.createLink(file(at).toPath(), file(new).toPath())
        except Exception as e:
            if not self._fs.exists(at):
                raise PySparkException(f"can't commit {at.getName()}") from e
            return False
        finally:
            self._fs.getRaw().delete(new, False)
        return True

    def _said(self, kind: str, name: str) -> dict:
        stream = self._fs.open(self._path(kind, name))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _write(self, rows: DataFrame) -> str:
        data = f"data-{uuid.uuid4().hex}"
        rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{self.folder}/{data}")
        return data

    def _rows(self, data: list[str]) -> DataFrame:
        return self.spark.read.schema(_SCHEMA).parquet(*(f"{self.folder}/{d}" for d in data)) if data else self.spark.createDataFrame([], _SCHEMA)

    def committed(self) -> list[str]:
        """Ids of the batches that count."""
        return self._names("batches")

    def commit(self, batch: str, inserted: DataFrame | None = None, deleted: DataFrame | None = None, revised: tuple[DataFrame, DataFrame] | None = None) -> bool:
        """Applies one batch once; False if it had been. revised: the rows as they were counted, and as they are now."""
        if self._fs.exists(self._path("batches", batch)):
            return False
        signed = [(x, s) for x, s in ((inserted, 1), (deleted, -1), *zip(revised or (), (-1, 1), strict=False)) if x is not None]
        rows = self.spark.createDataFrame([], _SCHEMA)
        for x, sign in signed:
            rows = rows.unionByName(x.select(*GROUP, F.lit(sign).cast("long").alias("docs"), (F.col("tokens") * sign).alias("tokens")))
        data = self._write(rows)
        if self._publish("batches", batch, {"data": data}):
            return True
        self._fs.delete(self._path(data), True)
        return False

    def _parts(self) -> tuple[int, list[str], list[str]]:
        """The number of the last compaction, and the batches and the data that count."""
        bases = self._names("compactions")
        base = self._said("compactions", bases[-1]) if bases else {"data": [], "batches": []}
        done = set(base["batches"])
        later = [b for b in self.committed() if b not in done]
        return len(bases), base["batches"] + later, base["data"] + [self._said("batches", b)["data"] for b in later]

    def compact(self, delete: bool = True) -> bool:
        """Replaces the deltas of all committed batches by their sum; False if another compaction came first.

        delete: also deletes what was replaced, which a reader of earlier totals may still want.
        """
        n, batches, old = self._parts()
        new = self._write(self._rows(old))
        if not self._publish("compactions", f"{n:012d}", {"data": [new], "batches": batches}):
            self._fs.delete(self._path(new), True)
            return False
        for data in old if delete else ():
            self._fs.delete(self._path(data), True)
        return True

    def totals(self) -> DataFrame:
        sums = self._rows(self._parts()[2]).groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 or tokens <> 0")


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads all documents under the old tokenizer; removes those labelled toxic; revises the labelled rest to the new one;
    then replays both batches, which must change nothing, and compacts the ledger."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ledger = Ledger(spark, scratch.path(spark, "ledger"))
    with scratch.scope():
        # texts are counted where they are read; the labels meet their counts
        sizes = scratch.saved(sized(docs, OLD, NEW), "counts")
        judged = sizes.join(labels, "doc_id")
        toxic, fine = judged.where("toxic = 1"), judged.where("toxic is null or toxic <> 1")
        old, new = (lambda d, i=i, n=n: counted(d, n, F.col("sizes")[i]) for i, n in enumerate((OLD, NEW)))
        for _ in range(2):
            ledger.commit("0001-load", inserted=old(sizes))
            ledger.commit("0002-labels", deleted=old(toxic), revised=(old(fine), new(fine)))
        ledger.compact()
    return ledger.totals()
