"""Readers of corpora: each returns a DataFrame with an explicit schema."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import os
import re
import tarfile
import urllib.request
import zipfile
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import linguistics

CONLL = ["index", "form", "lemma", "cpostag", "postag", "feats", "head", "deprel", "deps", "misc"]


def data_folder(name: str | None = None) -> Path:
    """Where corpora are kept: $GLOSSA_DATA, else ``data`` beside the package."""
    base = Path(os.environ.get("GLOSSA_DATA", Path(__file__).resolve().parents[2] / "data"))
    return base / name if name else base


def file_name_of(url: str) -> str:
    return url.split("?")[0].split("#")[0].rsplit("/", 1)[-1]


def download(url: str, folder: str | Path) -> Path:
    """Fetches a file once; one that is there stays."""
    target = Path(folder) / file_name_of(url)
    if not target.exists():
        target.parent.mkdir(parents=True, exist_ok=True)
        with urllib.request.urlopen(url) as source, open(f"{target}.part", "wb") as out:
            while block := source.read(1024):
                out.write(block)
        os.replace(f"{target}.part", target)
    return target


def iterate(rows: DataFrame, normalise: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    return rows.transform(normalise) if normalise else rows


def normalised(rows: DataFrame, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """Each row through a Python function; one that fails stays as it is, its results null and ``error`` set."""
    names = [f.name for f in rows.sparkSession.createDataFrame([], schema).schema]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                try:
                    made = fn(row)
                    out.append(row | {f"{n}": made.get(n) for n in names} | {"error": None})
                except Exception as e:
                    out.append(row | {n: None for n in names if n not in row} | {"error": str(e)})
            yield pd.DataFrame(out, columns=[*dict.fromkeys([*batch.columns, *names, "error"])])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in names)
    made = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.sparkSession.createDataFrame([], schema).schema)
    order = [*dict.fromkeys([*rows.columns, *names, "error"])]
    return rows.mapInPandas(run, ", ".join(x for x in (kept, made, "error string") if x)).select(*order)


def whole_files(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", glob: str | None = None) -> DataFrame:
    """file, value: whole text files."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.col("path").alias("file"), F.decode("content", encoding).alias("value"))


# --- treebanks -----------------------------------------------------------------


def parse_conll(files: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(file, value) to file, sent_id, tokens: array of structs, one a line; blank lines end sentences, runs of them once."""
    block = F.filter(F.split(F.regexp_replace("value", "\r\n?", "\n"), r"\n[ \t]*(?:\n[ \t]*)*\n|^\s*\n"), lambda s: F.trim(F.regexp_replace(s, r"\n", "")) != "")
    rows = files.select("file", F.posexplode(block).alias("sent_id", "block"))
    cells = F.transform(F.filter(F.split("block", "\n"), lambda x: F.trim(x) != ""), lambda x: F.split(x, "\t"))
    chosen = fields or CONLL
    token = lambda c: F.struct(*((F.get(c, F.lit(CONLL.index(f))).cast("int") if f == "index" else F.get(c, F.lit(CONLL.index(f)))).alias(f) for f in chosen))
    return rows.select("file", F.col("sent_id").cast("long").alias("sent_id"), F.transform(cells, token).alias("tokens"))


TREEBANK_SECTIONS = {"nob": ("blogs", "government-reports", "newspapers", "parliament"), "nno": ("blogs", "government-reports", "newspapers", "parliament")}


def treebank_files(names: list[str], lang=None, sections=None) -> list[str]:
    """The files of <lang>/<section>… or <lang>-<section>… that match; all where nothing is asked for."""
    langs = [lang] if isinstance(lang, str) else list(lang or TREEBANK_SECTIONS)
    asked = [sections] if isinstance(sections, str) else list(sections) if sections else None
    fits = lambda n: any(re.search(rf"(^|[/_.-]){re.escape(x)}([/_.-]|$)", n) for x in langs) and (asked is None or any(s in n for s in asked))
    return [n for n in names if fits(n)]


_PACKED = (".zip", ".tar", ".tgz", ".tar.gz", ".tar.bz2", ".gz", ".bz2")


def archive_members(spark: SparkSession, path: str | list[str], keep: str | list[str] = ".*", encoding: str = "UTF-8") -> DataFrame:
    """archive, file, value, error: the text members of zip, tar, gz and bz2 files, nested in each other or not.

    keep: patterns that a member's name must all match. They are tested by name, before a member is decompressed; only members
    that are archives themselves are opened for what is in them. One archive is read by one task, a member at a time. A member
    that can't be read gives a row with a null value and the error, and the others still come.
    """
    wanted = [re.compile(k) for k in ([keep] if isinstance(keep, str) else keep)]
    broken = (OSError, EOFError, ValueError, RuntimeError, NotImplementedError, zlib.error, lzma.LZMAError, zipfile.BadZipFile, tarfile.TarError)

    def inner(name: str) -> str:
        return name[:-3] if name.endswith(".gz") else name[:-4] if name.endswith(".bz2") else name

    def asked(name: str) -> bool:
        return name.endswith(_PACKED) and inner(name) == name or inner(name).endswith(_PACKED) or all(w.search(inner(name)) for w in wanted)

    def unpacked(name: str, read: Callable[[], bytes], top: bool = False) -> Iterator[tuple[str, bytes | None, str | None]]:
        if not top and not asked(name):
            return
        try:
            data = read()
            if name.endswith(".zip"):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for n in z.namelist():
                        if not n.endswith("/"):
                            yield from unpacked(n, lambda n=n: z.read(n))
            elif name.endswith((".tar", ".tgz", ".tar.gz", ".tar.bz2")):
                with tarfile.open(fileobj=io.BytesIO(data)) as t:
                    for m in t:
                        if m.isfile():
                            yield from unpacked(m.name, lambda m=m: t.extractfile(m).read())
            elif name.endswith((".gz", ".bz2")):
                plain = (gzip if name.endswith(".gz") else bz2).decompress(data)
                yield from unpacked(inner(name), lambda: plain)
            elif all(w.search(name) for w in wanted):
                yield name, data, None
        except broken as e:
            yield name, None, f"{type(e).__name__}: {e}"

    def run(batches):
        for batch in batches:
            for where, data in zip(batch["path"], batch["content"], strict=True):
                for n, raw, error in unpacked(where, lambda data=data: data, True):
                    yield pd.DataFrame({"archive": [where], "file": [n], "value": [raw if raw is None else raw.decode(encoding, "replace")], "error": [error]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, file string, value string, error string")


def treebank(spark: SparkSession, path: str | list[str], lang=None, sections=None, fields: list[str] | None = None) -> DataFrame:
    """Sentences of the treebank files, plain or archived, of the languages and sections asked for."""
    langs = [lang] if isinstance(lang, str) else list(lang or [])
    asked = [sections] if isinstance(sections, str) else list(sections or [])
    named = ["|".join(rf"(^|[/_.-]){re.escape(x)}([/_.0-9-]|$)" for x in group) for group in (langs, asked) if group]
    files = archive_members(spark, path, [r"\.conll$", *named])
    return parse_conll(files.where("error is null").select("file", "value"), fields)


def treebank_text(sentences: DataFrame) -> DataFrame:
    return sentences.withColumn("content", F.array_join(F.transform("tokens", lambda t: t["form"]), " "))


# --- newspapers ------------------------------------------------------------------


def _articles(files: DataFrame, header: str) -> DataFrame:
    """file, nth, url, body: what stands between header lines; text before the first is no article."""
    cut = F.split(F.concat(F.lit("\n"), F.regexp_replace("value", "\r\n?", "\n")), rf"\n(?={header})")
    rows = files.select("file", F.posexplode(cut).alias("nth", "part")).where("nth > 0")
    return rows.select("file", "nth", F.regexp_extract("part", header, 1).alias("url"), F.split("part", "\n").alias("lines"))


def _head(lines: Column, at: int, mark: str, kind: str | None = None) -> Column:
    found = tx.match_or_null(F.get(lines, F.lit(at)), mark)
    return found.cast(kind) if kind else found


def newspaper_1(files: DataFrame) -> DataFrame:
    """One token a line; a line after the address is skipped, then source, year, month and day stand on fixed lines."""
    rows = _articles(files, r"<U #(https?://[^>\n]*)>")
    tokens = F.filter(F.transform(F.slice("lines", F.lit(7), F.greatest(F.size("lines") - 6, F.lit(0))), lambda x: F.trim(x)), lambda t: t != "")
    made = rows.select(
        "url", _head(F.col("lines"), 2, r"^<B ([^>]*)>").alias("source"), *(_head(F.col("lines"), at, rf"^<{m} (\d+)>", "int").alias(n) for at, m, n in ((3, "A", "pub_year"), (4, "M", "pub_month"), (5, "D", "pub_day"))), tx.nfc_all(tokens).alias("tokens"), F.lit(1).alias("corpus_section")
    )
    return made.where(F.size("tokens") > 0)


def newspaper_2(files: DataFrame) -> DataFrame:
    """Fixed header lines; the body's lines are joined by a space and cut into sentences at paragraph signs and pipes."""
    rows = _articles(files, r"##U #(https?://[^>\n]*)>")
    lines = F.filter(F.transform(F.slice("lines", F.lit(6), F.greatest(F.size("lines") - 5, F.lit(0))), lambda x: F.trim(x)), lambda t: ~t.isin("", "|"))
    sentences = F.filter(F.transform(F.split(F.array_join(lines, " "), r"[¶|]"), lambda x: F.trim(x)), lambda t: t != "")
    made = rows.select(
        "url", _head(F.col("lines"), 1, r"^##B ([^>]*)>").alias("source"), *(_head(F.col("lines"), at, rf"^##{m} (\d+)>", "int").alias(n) for at, m, n in ((2, "A", "pub_year"), (3, "M", "pub_month"), (4, "D", "pub_day"))), tx.nfc_all(sentences).alias("sentences"), F.lit(2).alias("corpus_section")
    )
    return made.where(F.size("sentences") > 0)


def newspaper_3(files: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One XML article a file: attributes to a map, typed divisions to columns, paragraphs of the text to an array."""
    fields = fields or ["title"]
    names, values = F.expr("xpath(value, '//attribute/@name')"), F.expr("xpath(value, '//attribute/@value')")
    one = lambda f: tx.nfc(F.trim(F.expr(f"xpath_string(value, '//div[@type=\"{f}\"]')"))).alias(f)
    paragraphs = F.filter(F.transform(F.expr("xpath(value, '//div[@type=\"text\"]//p//text()')"), lambda x: F.trim(x)), lambda t: t != "")
    return files.where(F.col("file").endswith(".xml")).select(
        "file", *map(one, fields), tx.nfc_all(paragraphs).alias("text"), F.map_from_arrays(names, tx.nfc_all(values)).alias("metadata"), F.lit(3).alias("corpus_section")
    )


def newspapers(spark: SparkSession, folder: str, sections=(1, 2, 3), sources: list[str] | None = None, encoding: str = "ISO-8859-1") -> DataFrame:
    """Articles of the sections, from <folder>/section<N>: archives or plain files, whose members are pruned by name before they are unpacked.
    Members that can't be read are left out; archive_members() names them."""
    parts = []
    for n in sections:
        named = "|".join(map(re.escape, sources)) if sources and n > 1 else ".*"
        files = archive_members(spark, f"{folder}/section{n}", named, encoding if n < 3 else "UTF-8").where("error is null")
        rows = {1: newspaper_1, 2: newspaper_2, 3: newspaper_3}[n](files)
        parts.append(rows.where(F.col("source").isin(sources)) if sources and n == 1 else rows)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def newspaper_text(rows: DataFrame) -> DataFrame:
    """Adds ``content``: tokens joined by spaces, sentences by line feeds, paragraphs by blank lines."""
    have = lambda c, kind: F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    content = (
        F.when(F.col("corpus_section") == 1, F.array_join(have("tokens", "array<string>"), " "))
        .when(F.col("corpus_section") == 2, F.array_join(have("sentences", "array<string>"), "\n"))
        .when(F.col("corpus_section") == 3, F.array_join(have("text", "array<string>"), "\n\n"))
        .otherwise(F.raise_error(F.concat(F.lit("no such section: "), F.col("corpus_section").cast("string"))))
    )
    out = rows.withColumn("content", content)
    return out.withColumn("source", F.coalesce(have("source", "string"), F.get(F.array(F.try_element_at("metadata", F.lit("source"))), F.lit(0)))) if "metadata" in rows.columns else out


# --- newsgroups --------------------------------------------------------------------


def strip_post(text: Column) -> Column:
    """Without header (up to the first blank line), quotes, and footer (from the last blank or dashed line)."""
    body = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"(?s)^.*?\n\n", "")
    quoted = r"(writes in|writes:|wrote:|says:|said:|^In article|^Quoted from|^\||^>)"
    lines = F.filter(F.split(body, "\n"), lambda x: ~F.regexp_like(x, F.lit(quoted)))
    trimmed = F.regexp_replace(F.array_join(lines, "\n"), r"\s+$", "")
    return F.when(F.regexp_like(trimmed, F.lit(r"(?s)^.*\n[ \t]*-*[ \t]*\n")), F.regexp_replace(trimmed, r"(?s)^(.*)\n[ \t]*-*[ \t]*\n.*$", "$1")).otherwise(trimmed)


def newsgroups(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, article, group, target (the group's number in order of names), filename, of <folder>/<group>/<file>."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.decode("content", "ISO-8859-1").alias("raw"))
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("doc_id"), strip_post(F.col("raw")).alias("article"), F.element_at(F.split("path", "/"), -2).alias("group"), F.col("path").alias("filename"))
    groups = rows.select("group").distinct().select("group", F.expr("dense_rank() over (order by `group`) - 1").alias("target"))  # one row a group
    return rows.join(groups, "group").select("doc_id", "article", "group", "target", "filename")


# --- tables of terms -----------------------------------------------------------------


def term_count_lines(spark: SparkSession, path: str, delim: str = "\t", term: int = 1, count: int = 2) -> DataFrame:
    cells = F.split("value", re.escape(delim))
    return spark.read.text(path).where("value <> ''").select(F.get(cells, F.lit(term)).alias("term"), F.get(cells, F.lit(count)).cast("long").alias("count"))


def lexicon(spark: SparkSession, path: str, tag: Callable[[Column, Column, Column], Column] = linguistics.simple_tag) -> DataFrame:
    """Full forms: latin-1, tab-separated, comment lines start with ``*``; pos by ``tag`` and, as the file is one, line_no."""
    files = whole_files(spark, path, "ISO-8859-1")
    rows = files.select(F.posexplode(F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n")).alias("line_no", "line")).where("trim(line) <> '' and not line like '*%'")
    c = F.split("line", "\t")
    get = lambda i: F.get(c, F.lit(i))
    pos, feats = F.substring_index(get(3), " ", 1), F.regexp_replace(F.regexp_replace(get(3), r"^\S+\s*", ""), r"\s+", "|")
    made = rows.select(
        F.expr("try_cast(get(split(line, '\t'), 0) as int)").alias("word_id"), get(1).alias("lemma"), F.lower(get(2)).alias("fullform"), get(3).alias("morph_descr"), get(4).alias("paradigm_code"), F.expr("try_cast(get(split(line, '\t'), 5) as int)").alias("paradigm_entry"), pos.alias("ndt_pos"), feats.alias("ndt_feats"), F.col("line_no").cast("long").alias("line_no")
    )
    return made.withColumn("pos", tag(F.col("fullform"), F.col("ndt_pos"), F.col("ndt_feats")))


def text_lines(spark: SparkSession, path: str, field: int | None = 1) -> DataFrame:
    rows = spark.read.text(path)
    return rows if field is None else rows.select(F.get(F.split("value", "\t"), F.lit(field)).alias("value"))


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def table(spark: SparkSession, name: str, query: str | None = None, *columns: str) -> DataFrame:
    """An indexed table with a pushed-down query."""
    rows = spark.table(name) if not os.path.exists(name) else spark.read.parquet(name)
    rows = rows.where(query) if query else rows
    return rows.select(*columns) if columns else rows
