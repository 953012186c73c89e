"""Term statistics of a corpus, and significant terms of single documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import counts
from ..functions import text as tx

Tokens = Callable[[Column], Column]


def tokenised(docs: DataFrame, tokens: Tokens = tx.letters, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, tokens, and the document's length in tokens."""
    return docs.select(F.col(key), tokens(F.col(text)).alias("tokens")).withColumn("doc_len", F.size("tokens").cast("long"))


def exploded(rows: DataFrame, tokens: Column | str, *keep: str) -> DataFrame:
    """keep and ``term``, a row for each token. A plain explode lets Spark infer a filter on the array's size above the scan,
    which cuts every text into tokens a second time."""
    return rows.select(*keep, F.explode_outer(tokens).alias("term")).where(F.col("term").isNotNull())


def repeated(docs: DataFrame, key: str) -> bool:
    """Whether a key, null too, stands in several rows; only keys are read and moved."""
    return not docs.groupBy(key).count().where("count > 1").isEmpty()


def term_frequencies(docs: DataFrame, tokens: Tokens = tx.letters, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, term, tf and doc_len. A key stands for one document: letters are counted where the text is read, and nothing is
    shuffled, unless keys repeat; rows of one key are then counted together, and doc_len is the longest one's.

    With other tokens, one pre-aggregated shuffle, of which the length is a key, so that whatever a query then drops, each
    use of the counts plans the same exchange and the texts are cut into tokens once.
    """
    if tokens is tx.letters:
        tf = counts.frequencies(docs, key, text)
        return tf.groupBy(key, "term").agg(F.sum("tf").alias("tf"), F.max("doc_len").alias("doc_len")) if repeated(docs, key) else tf
    rows = exploded(tokenised(docs, tokens, key, text), "tokens", key, "doc_len")
    return rows.groupBy(key, "doc_len", "term").agg(F.count("*").alias("tf")).select(key, "term", "tf", "doc_len")


def statistics(docs: DataFrame, tokens: Tokens = tx.letters) -> DataFrame:
    """term, df, ttf, by rows."""
    if tokens is tx.letters:
        return counts.statistics(docs)
    rows = exploded(docs.select(F.monotonically_increasing_id().alias("row"), tokens(F.col("text")).alias("tokens")), "tokens", "row")
    return rows.groupBy("row", "term").agg(F.count("*").alias("tf")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ttf"))


def by_document(docs: DataFrame, tokens: Tokens = tx.letters) -> DataFrame:
    """term, df, ttf, by doc_id."""
    return document_frequency(term_frequencies(docs, tokens)) if repeated(docs, "doc_id") else statistics(docs, tokens)


def relative_frequency(counts: DataFrame, min_count: int = 1) -> DataFrame:
    """term, weight: a term's share of all counts. The floor is per input row; the total keeps what it drops."""
    total = counts.agg(F.sum("count").alias("total"))
    kept = counts.where(F.col("count") >= min_count).groupBy("term").agg(F.sum("count").alias("n"))
    return kept.crossJoin(F.broadcast(total)).select("term", (F.col("n") / F.col("total")).alias("weight"))  # one row


def term_counts(docs: DataFrame, tokens: Tokens = tx.letters) -> DataFrame:
    return statistics(docs, tokens).select("term", F.col("ttf").alias("count"))


def document_frequency(tf: DataFrame) -> DataFrame:
    """term, df, ttf of term_frequencies()."""
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ttf"))


def document_ratio(docs: DataFrame, tokens: Tokens = tx.letters) -> DataFrame:
    """term, weight: the share of documents that hold it."""
    total = docs.agg(F.count("*").alias("docs"))
    return statistics(docs, tokens).crossJoin(F.broadcast(total)).select("term", (F.col("df") / F.col("docs")).alias("weight"))  # one row


def idf_log2(docs: DataFrame, tokens: Tokens = tx.letters) -> DataFrame:
    """term, weight: log2(documents / document frequency)."""
    return document_ratio(docs, tokens).select("term", (-F.log2("weight")).alias("weight"))


def vocabulary(docs: DataFrame, no_below: int = 5, no_above: float = 0.5, keep: int | None = 100_000, tokens: Tokens = tx.letters) -> DataFrame:
    """id, term, df, of the ``keep`` most frequent terms (df desc, term) in at least no_below and at most no_above of the documents."""
    total = docs.agg(F.count("*").alias("docs"))
    fits = statistics(docs, tokens).where(F.col("df") >= no_below).crossJoin(F.broadcast(total)).where(F.col("df") <= no_above * F.col("docs"))  # one row
    ranked = fits.select("term", "df").orderBy(F.desc("df"), "term")
    if keep is not None:
        ranked = ranked.limit(keep)  # the operator's own parameter: what follows is at most this long
    return ranked.select((F.row_number().over(Window.orderBy(F.desc("df"), "term")) - 1).cast("long").alias("id"), "term", "df")


def tfidf(docs: DataFrame, normalise: bool = True, tokens: Tokens = tx.letters) -> DataFrame:
    """doc_id, term, weight: tf * log2(D / df), by default of unit length per document. Terms in all documents weigh nothing and go."""
    tf = term_frequencies(docs, tokens)
    total = docs.agg(F.count("*").alias("docs"))
    idf = by_document(docs, tokens).crossJoin(F.broadcast(total)).select("term", (-F.log2(F.col("df") / F.col("docs"))).alias("idf"))  # one row
    rows = tf.join(idf, "term").select("doc_id", "term", (F.col("tf") * F.col("idf")).alias("weight")).where("weight <> 0")
    if not normalise:
        return rows
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("doc_id")))
    return rows.select("doc_id", "term", (F.col("weight") / norm).alias("weight"))


def top(rows: DataFrame, n: int, by: list[str] | str, *order: Column, name: str = "rank") -> DataFrame:
    """The first n of each group; Spark limits groups before the shuffle."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(*order))).where(F.col(name) <= n)


def lift(docs: DataFrame, n: int = 5, tokens: Tokens = tx.letters, doc_id=None) -> DataFrame:
    """The n terms of each document whose share of it exceeds their share of the collection most. doc_id: of one document
    (no row if it is missing); the collection's statistics stay whole."""
    tf = term_frequencies(docs, tokens)
    stats = statistics(docs, tokens).select("term", "ttf")
    total = stats.agg(F.sum("ttf").alias("all"))
    own = tf if doc_id is None else term_frequencies(docs.where(F.col("doc_id") == doc_id), tokens)
    rows = own.join(stats, "term").crossJoin(F.broadcast(total))  # one row
    scored = rows.select("doc_id", "term", ((F.col("tf") / F.col("doc_len")) / (F.col("ttf") / F.col("all"))).alias("score"))
    return top(scored, n, "doc_id", F.desc("score"), F.asc("term"))


def weighted(docs: DataFrame, weights: DataFrame | None = None, n: int = 5, tokens: Tokens = tx.letters) -> DataFrame:
    """The n terms of each document of most tf, or tf times the provider's weight (ties, to nine digits, by term)."""
    tf = term_frequencies(docs, tokens)
    score = F.col("tf").cast("double")
    if weights is not None:
        tf, score = tf.join(weights, "term"), F.col("tf") * F.col("weight")
    return top(tf.select("doc_id", "term", score.alias("score")), n, "doc_id", F.desc(F.round("score", 9)), F.asc("term"))
