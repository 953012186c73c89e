"""Queries of strings, lemmas, corpus formats and markup over the whole tables, and the SQL that checks them.

Formats are checked both ways: the documents are written in a corpus' own format, and its reader gives them back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import counts
from ..functions import text as tx
from ..operators import keywords, linguistics, terms, topics, wikitext
from ..sources import corpora
from .registry import _HITS, _LLR, _TAG, CASED, TF, TOK, _docs, _rounded, query


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _text(column: Column) -> Column:
    return column.cast("string")


@query(
    "doc_filters",
    """SELECT doc_id AS id, source || ' er en tekst på ' || lang || '.' AS text, lang AS sprog FROM documents
WHERE lang <> 'en' AND length(source || ' er en tekst på ' || lang || '.') >= 24""",
)
def doc_filters(spark, sf_dir):
    """Pages made of the documents' columns: redirects where the text is English, articles of the others, the short ones dropped."""
    body = F.concat(F.lit("{{Infoboks tekst\n| sprog = "), "lang", F.lit("\n}}\n'''"), "source", F.lit("''' er en tekst på [[språk|"), "lang", F.lit("]].<ref>kilde</ref>"))
    text = F.when(F.col("lang") == "en", F.lit("#REDIRECT [[X]] and a long enough remainder")).otherwise(body)
    rows = _all(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("source").alias("title"), text.alias("text")).where("text is not null")
    return wikitext.pages(rows, min_length=24).select("id", F.col("article.text").alias("text"), F.col("infoboks")["sprog"].alias("sprog"))


_SENTENCES = r"list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"


@query(
    "kera_keywords",
    f"""WITH {_LLR.format(t="k0", tok=TOK)},
c AS (SELECT doc_id, {_SENTENCES} AS ss FROM documents), e AS (SELECT doc_id, unnest(ss) AS text, unnest(generate_series(1, len(ss))) AS si FROM c),
f AS (SELECT doc_id, si, list_append({CASED}, '.') AS ws FROM e), g AS (SELECT doc_id, si, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS i, len(ws) AS m FROM f),
h AS (SELECT doc_id, w, CASE WHEN i = m THEN 'o' ELSE {_TAG} END AS tag, row_number() OVER (PARTITION BY doc_id ORDER BY si, i) - 1 AS pos FROM g),
s AS (SELECT doc_id, string_agg(tag, '' ORDER BY pos) AS tags, list(w ORDER BY pos) AS ws FROM h GROUP BY doc_id),
r AS (SELECT doc_id, ws, regexp_extract_all(tags, 'A*N+|P+|.') AS runs FROM s), v AS (SELECT doc_id, ws, unnest(runs) AS run, unnest(generate_series(1, len(runs))) AS i FROM r),
x AS (SELECT *, sum(length(run)) OVER (PARTITION BY doc_id ORDER BY i) - length(run) AS pos FROM v),
ph AS (SELECT doc_id, lower(array_to_string(ws[pos + 1:pos + length(run)], ' ')) AS keyword, min(pos) AS pos FROM x WHERE length(run) > 1 AND regexp_matches(run, '[NP]') GROUP BY ALL),
n0 AS (SELECT doc_id, len(tok) AS size FROM k0),
ke AS (SELECT k.doc_id, ph.keyword, k.score / sum(k.score) OVER (PARTITION BY k.doc_id) AS a, 1 - ph.pos / greatest(size, ph.pos + 1) AS b
       FROM k JOIN ph ON ph.doc_id = k.doc_id AND ph.keyword = k.w1 || ' ' || k.w2 JOIN n0 ON n0.doc_id = k.doc_id WHERE k.rank <= 50),
lim AS (SELECT doc_id, count(*) AS k FROM ke GROUP BY doc_id), z AS (SELECT doc_id, w AS keyword, count(*) AS n, min(pos) AS pos FROM h WHERE tag = 'P' GROUP BY ALL),
y AS (SELECT z.*, sum(n) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, keyword) AS rank FROM z),
q AS (SELECT y.doc_id, keyword, n / total AS a, 1 - pos / len(ws) AS b FROM y JOIN lim USING (doc_id) JOIN s USING (doc_id) WHERE rank <= lim.k)
SELECT doc_id, keyword, 'collocation' AS kind, round(2 * a * b / (a + b), 6) AS score FROM ke UNION ALL SELECT doc_id, keyword, 'proper', round(2 * a * b / (a + b), 6) FROM q""",
)
def kera_keywords(spark, sf_dir):
    return _rounded(keywords.kera(_docs(spark, sf_dir)), "score")


@query(
    "topic_title_prefix",
    f"""WITH {TF}, {_HITS} SELECT query, rank, doc_id, string_agg(coalesce(source, '?') || '/' || doc_id, ' ') OVER (PARTITION BY query ORDER BY rank ROWS UNBOUNDED PRECEDING) AS prefix
FROM k JOIN documents USING (doc_id) WHERE rank <= 5""",
)
def topic_title_prefix(spark, sf_dir):
    title = F.concat(F.coalesce("source", F.lit("?")), F.lit("/"), _text(F.col("doc_id")))
    docs = _all(spark, sf_dir).select("doc_id", "text", title.alias("title"))
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query"), F.explode(tx.letters(F.col("text"))).alias("term"))
    return topics.titled(topics.hits(asked, docs), docs).select("query", F.col("rank").cast("long").alias("rank"), "doc_id", "prefix")


_HTML = r"regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<nav\b.*?</nav\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _name, _value in (("middot", "·"), ("copy", "©"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
    _HTML = f"replace({_HTML}, '&{_name};', '{_value}')"


@query("html_clean", rf"SELECT page_id, trim(regexp_replace({_HTML}, '\s+', ' ', 'g')) AS text FROM pages")
def html_clean(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", wikitext.html_text("html").alias("text"))


@query(
    "string_functions",
    rf"""SELECT doc_id, replace(text, chr(10), ' ') AS line, upper(text[1]) || text[2:] AS upper_first, lower(text[1]) || text[2:] AS lower_first,
CASE WHEN regexp_matches(text, '([A-Za-z]+)[.]') THEN regexp_extract(text, '([A-Za-z]+)[.]', 1) END AS matched, 'http://x?curid=' || doc_id AS url, chr(CAST(65 + n_chars % 26 AS INTEGER)) AS entity,
[source] AS listed, lower(source || ' ' || upper(lang)) AS flat, CAST(len({TOK}) AS BIGINT) AS keyword_tokens,
CASE WHEN lang = 'en' THEN 'Talk:' ELSE upper(lang[1]) || lang[2:] || ':' END || upper(source[1]) || source[2:] AS title FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL""",
)
def string_functions(spark, sf_dir):
    rows, text = _all(spark, sf_dir).where("source is not null and lang is not null"), F.col("text")
    title = tx.normal_title(F.concat(F.lit(" "), F.col("lang"), F.lit(":_ "), F.col("source"), F.lit("_")), {"en": "Talk"})
    return rows.select(
        "doc_id", tx.one_line(text).alias("line"), tx.upper_first(text).alias("upper_first"), tx.lower_first(text).alias("lower_first"), tx.match_or_null(text, "([A-Za-z]+)[.]").alias("matched"),
        tx.page_url("http://x", F.col("doc_id")).alias("url"), tx.numeric_entity(_text(65 + F.col("n_chars") % 26)).alias("entity"), tx.as_list(F.col("source"), False).alias("listed"),
        tx.flat_lower(F.array("source", F.upper("lang"))).alias("flat"), F.size(tx.keyword_tokens(text)).cast("long").alias("keyword_tokens"), title.alias("title"),
    )


@query(
    "compatible_tokens",
    r"""SELECT doc_id, CAST(len(list_filter(string_split_regex(lower(nfc_normalize(text)), '\s+'), lambda x: x <> '')) AS BIGINT) AS n,
sha256(array_to_string(list_filter(string_split_regex(lower(nfc_normalize(text)), '\s+'), lambda x: x <> ''), ' ')) AS tokens FROM documents WHERE text IS NOT NULL""",
)
def compatible_tokens(spark, sf_dir):
    tokens = tx.compatible_tokens(F.col("text"))
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", F.size(tokens).cast("long").alias("n"), F.sha2(F.array_join(tokens, " "), 256).alias("tokens"))


@query("unicode_tokens")
def unicode_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(tx.unicode_words("text")).alias("tokens"), F.size(tx.unicode_words_no_punct(F.col("text"))).alias("without_punctuation"))


@query(
    "lemmatize_by_pos",
    f"""WITH {TF}, l AS (SELECT term FROM df WHERE df >= 5), e AS (SELECT unnest({CASED}) AS token FROM documents),
p AS (SELECT lower(token) AS form, CASE length(token) % 4 WHEN 0 THEN 'NOUN' WHEN 1 THEN 'VERB' WHEN 2 THEN 'ADJ' END AS pos FROM e)
SELECT CASE WHEN l.term IS NULL OR pos = 'ADJ' THEN form WHEN pos = 'NOUN' THEN form || '-n2' ELSE form || '-v' END AS lemma, pos, count(*) AS n FROM p LEFT JOIN l ON l.term = form GROUP BY 1, 2""",
)
def lemmatize_by_pos(spark, sf_dir):
    """Lemmas by part of speech, from a lexicon of the corpus' own terms: two lines for a noun, the last one a verb's."""
    docs = _docs(spark, sf_dir)
    often = terms.by_document(docs).where("df >= 5")
    lines = F.array(*(F.struct(F.lit(pos).alias("pos"), F.concat(F.col("term"), F.lit(end)).alias("lemma"), F.lit(i).alias("line_no")) for i, (pos, end) in enumerate((("NOUN", "-n1"), ("NOUN", "-n2"), ("VERB", "-v")))))
    lexicon = often.select(F.col("term").alias("fullform"), F.inline(lines))
    kind = F.length("token") % 4
    tokens = docs.select(F.explode(tx.cased_letters(F.col("text"))).alias("token")).withColumn("pos", F.when(kind == 0, "NOUN").when(kind == 1, "VERB").when(kind == 2, "ADJ"))
    return linguistics.lemmatise(tokens, lexicon, with_pos=True).groupBy("lemma", "pos").agg(F.count("*").alias("n"))


def _cased(spark, sf_dir, least: int) -> DataFrame:
    return _all(spark, sf_dir).select("doc_id", F.coalesce("source", F.lit("x")).alias("source"), tx.cased_letters(F.col("text")).alias("tok")).where(F.size("tok") > least)


@query(
    "conll_sentences",
    f"""WITH t AS (SELECT doc_id, {CASED} AS tok FROM documents) SELECT CAST(doc_id AS VARCHAR) AS file, CAST(s AS BIGINT) AS sent_id, array_to_string(tok[50 * s + 1:50 * s + 50], ' ') AS content,
CAST(least(50, len(tok) - 50 * s) AS BIGINT) AS n, lower(tok[50 * s + 1]) AS first_lemma FROM (SELECT doc_id, tok, unnest(generate_series(0, (len(tok) - 1) // 50)) AS s FROM t WHERE len(tok) > 0)""",
)
def conll_sentences(spark, sf_dir):
    """Documents written as treebank files, fifty tokens a sentence, and read again."""
    line = lambda t, i: F.concat(_text((i % 50) + 1), F.lit("\t"), t, F.lit("\t"), F.lower(t), F.lit("\tsubst\tsubst\t_\t0\tX\t_\t_"))
    rows = _cased(spark, sf_dir, 0).select(_text(F.col("doc_id")).alias("file"), F.transform("tok", line).alias("lines"))
    blocks = F.transform(F.sequence(F.lit(0), F.expr("(size(lines) - 1) div 50").cast("int")), lambda s: F.array_join(F.slice("lines", s * 50 + 1, F.lit(50)), "\n"))
    files = rows.select("file", F.concat(F.lit("\n"), F.array_join(blocks, "\n\n"), F.lit("\n")).alias("value"))
    read = corpora.treebank_text(corpora.parse_conll(files))
    return read.select("file", "sent_id", "content", F.size("tokens").cast("long").alias("n"), F.col("tokens")[0]["lemma"].alias("first_lemma"))


@query(
    "newspaper_articles",
    f"""WITH t AS (SELECT doc_id, coalesce(source, 'x') AS source, {CASED} AS tok FROM documents), u AS (SELECT *, 'http://n/' || doc_id AS url, CAST(doc_id % 90 AS INTEGER) AS y, CAST(doc_id % 28 + 1 AS INTEGER) AS d FROM t WHERE len(tok) > 1)
SELECT url, source, y AS pub_year, 3 AS pub_month, d AS pub_day, CAST(len(tok) AS BIGINT) AS n, array_to_string(tok, ' ') AS content, 1 AS corpus_section FROM u
UNION ALL SELECT url, source, y, 3, d, 2, tok[1] || chr(10) || array_to_string(tok[2:], ' '), 2 FROM u
UNION ALL SELECT NULL, source, NULL, NULL, NULL, 2, tok[1] || chr(10) || chr(10) || array_to_string(tok[2:], ' '), 3 FROM u""",
)
def newspaper_articles(spark, sf_dir):
    """Documents written in the three formats of the newspaper corpus, and read again."""
    rows = _cased(spark, sf_dir, 1)
    file, url = _text(F.col("doc_id")).alias("file"), F.concat(F.lit("http://n/"), _text(F.col("doc_id")))
    mark = lambda at, m, v: F.concat(F.lit(f"{at}{m} "), v, F.lit(">"))
    head = lambda at: [mark(at, "B", F.col("source")), mark(at, "A", _text(F.col("doc_id") % 90)), mark(at, "M", F.lit("03")), mark(at, "D", _text(F.col("doc_id") % 28 + 1))]
    rest = F.array_join(F.slice("tok", F.lit(2), F.size("tok")), " ")
    one = rows.select(file, F.concat_ws("\n", F.lit("noise"), F.concat(F.lit("<U #"), url, F.lit(">")), F.lit("skipped"), *head("<"), F.array_join("tok", "\n")).alias("value"))
    two = rows.select(file, F.concat_ws("\n", F.concat(F.lit("##U #"), url, F.lit(">")), *head("##"), F.concat(F.col("tok")[0], F.lit(" ¶ "), rest), F.lit("|")).alias("value"))
    paragraphs = F.concat(F.lit("<p>"), F.col("tok")[0], F.lit("</p><p> "), rest, F.lit("</p>"))
    xml = F.concat(F.lit('<doc><attribute name="source" value="'), "source", F.lit('"/><div type="title">T</div><div type="text">'), paragraphs, F.lit("</div></doc>"))
    three = rows.select(F.concat(file, F.lit(".xml")).alias("file"), xml.alias("value"))
    columns = ["url", "source", "pub_year", "pub_month", "pub_day", "n", "content", "corpus_section"]
    out = None
    for reader, files, items in ((corpora.newspaper_1, one, "tokens"), (corpora.newspaper_2, two, "sentences"), (corpora.newspaper_3, three, "text")):
        read = corpora.newspaper_text(reader(files)).withColumn("n", F.size(items).cast("long"))
        read = read.select(*(c for c in columns if c in read.columns))
        out = read if out is None else out.unionByName(read, allowMissingColumns=True)
    return out


@query("newsgroup_posts", f"WITH t AS (SELECT doc_id, {CASED} AS tok FROM documents) SELECT doc_id, array_to_string(tok[1:20], ' ') || chr(10) || array_to_string(tok[21:], ' ') AS article FROM t WHERE len(tok) > 20")
def newsgroup_posts(spark, sf_dir):
    """Documents written as posts with a header, a quotation and a footer, which go when they are read."""
    body = F.concat_ws("\n", F.array_join(F.slice("tok", 1, 20), " "), F.array_join(F.slice("tok", F.lit(21), F.size("tok")), " "))
    post = F.concat(F.lit("From: a@b.c\r\nSubject: x\r\n\r\nJoe wrote:\n> quoted words\n"), body, F.lit("\n--\nsigned"))
    return _cased(spark, sf_dir, 20).select("doc_id", corpora.strip_post(post).alias("article"))


@query(
    "wiki_clean",
    """SELECT doc_id, source || ' er "' || lang || '"s ' || source || ' x ' || doc_id || ': ' || (doc_id + 2) * 3 || ', ' || CASE WHEN lang = 'en' THEN 'yes' ELSE 'no' END || ', '
|| upper(lang[1]) || lang[2:] || upper(lang) || ', Hei ' || source || ' ingen! & 5 km' AS text FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL""",
)
def wiki_clean(spark, sf_dir):
    """Markup of most kinds, made of the documents' columns: quotes, links, files, references, comments, tables, tags, parser
    functions, templates with parameters and redirects, entities."""
    site = wikitext.Site()
    site.define("Template:Hilsen", "Hei {{{1|ingen}}} {{{navn|ingen}}}!<noinclude>x</noinclude>")
    site.define("Template:Hils", "#REDIRECT [[Template:Hilsen]]")
    lit, lang, source, number = F.lit, F.col("lang"), F.col("source"), _text(F.col("doc_id"))
    text = F.concat(
        lit("'''"), source, lit("''' er ''"), lang, lit("''s [[X|"), source, lit("]]<ref>kilde</ref><!-- c --> {{lc:X}} "), number, lit(": {{#expr: ("), number, lit(" + 2) * 3}}, {{#ifeq: "), lang, lit("|en|yes|no}}, {{ucfirst:"), lang, lit("}}{{uc:"), lang,
        lit("}}[[Fil:x.jpg|thumb|y]]{| a {| b |} |}, {{hils|"), source, lit("}} &amp; <b>{{#invoke:convert|convert|5|km}}</b>"),
    )
    rows = _all(spark, sf_dir).where("source is not null and lang is not null")
    return rows.select("doc_id", wikitext.cleaned(text, site=site).alias("text"))
