"""Readers and writers on small files, and the wikitext cleaner."""

import bz2
import gzip
import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from glossa.operators import wikitext
from glossa.sources import corpora, sinks

CONLL = "\n1\tEg\teg\tpron\tpron\tpers\t0\tX\t_\t_\n2\tvar\tvere\tverb\tverb\t_\t0\tX\t_\t_\n3\t.\t.\tclb\tclb\t_\t0\tX\t_\t_\n\n\n1\tHei\thei\tinterj\tinterj\t_\t0\tX\t_\t_\n"


def test_conll(spark, tmp_path):
    (tmp_path / "a.conll").write_text(CONLL)
    rows = corpora.parse_conll(corpora.whole_files(spark, str(tmp_path / "a.conll"))).orderBy("sent_id").collect()
    assert [[t["form"] for t in r["tokens"]] for r in rows] == [["Eg", "var", "."], ["Hei"]] and rows[0]["tokens"][1]["index"] == 2
    part = corpora.parse_conll(corpora.whole_files(spark, str(tmp_path / "a.conll")), ["form", "lemma"])
    assert part.schema["tokens"].dataType.elementType.names == ["form", "lemma"]
    assert corpora.treebank_text(part).orderBy("sent_id").first()["content"] == "Eg var ."


def test_treebank_archive(spark, tmp_path):
    with tarfile.open(tmp_path / "ndt.tar.gz", "w:gz") as t:
        for name in ("nob/parliament.conll", "nno/parliament.conll", "nob/blogs.conll", "nob/readme.txt"):
            info = tarfile.TarInfo(name)
            info.size = len(CONLL.encode())
            t.addfile(info, io.BytesIO(CONLL.encode()))
    where = str(tmp_path / "ndt.tar.gz")
    assert corpora.treebank(spark, where).count() == 6
    assert corpora.treebank(spark, where, lang="nob", sections="parliament").select("file").distinct().count() == 1
    assert corpora.treebank_files(["nob/a.conll", "nno/a.conll"], lang="nno") == ["nno/a.conll"]


PAPER_1 = "noise\n<U #http://x/1>\nskipped\n<B aa>\n<A 99>\n<M 01>\n<D 02>\nBlåbær\n\ner\n<U #http://x/2>\nskipped\nno\n<A 98>\n<M x>\n<D 03>\nord\n<U #http://x/3>\nskipped\n<B bb>\n"
PAPER_2 = "##U #http://x/1>\n##B aa>\n##A 05>\n##M 01>\n##D 02>\nFørste setning ¶ andre\n|\n\ntredje | fjerde\n"
PAPER_3 = '<doc><attribute name="source" value="vg"/><div type="title">Tittel</div><div type="text"><p>En.</p><p>To.</p></div></doc>'


def test_newspapers(spark, tmp_path):
    for n in (1, 2, 3):
        (tmp_path / f"section{n}").mkdir()
    (tmp_path / "section1" / "a.gz").write_bytes(gzip.compress(PAPER_1.encode("latin-1")))
    with zipfile.ZipFile(tmp_path / "section2" / "b.zip", "w") as z:
        z.writestr("aa.gz", gzip.compress(PAPER_2.encode("latin-1")))
    with zipfile.ZipFile(tmp_path / "section3" / "c.zip", "w") as z:
        z.writestr("vg/1.xml", PAPER_3)
        z.writestr("vg/note.txt", "x")
    rows = {r["url"] or r["title"]: r for r in corpora.newspaper_text(corpora.newspapers(spark, str(tmp_path))).collect() if r["url"] != "http://x/1" or r["corpus_section"] == 1}
    assert rows["http://x/1"]["tokens"] == ["Blåbær", "er"] and rows["http://x/1"]["content"] == "Blåbær er"
    assert [rows["http://x/1"][c] for c in ("source", "pub_year", "pub_month", "pub_day")] == ["aa", 99, 1, 2]
    assert (rows["http://x/2"]["source"], rows["http://x/2"]["pub_year"], rows["http://x/2"]["pub_month"]) == (None, 98, None)
    assert "http://x/3" not in rows
    assert rows["Tittel"]["text"] == ["En.", "To."] and rows["Tittel"]["source"] == "vg" and rows["Tittel"]["content"] == "En.\n\nTo."
    two = corpora.newspapers(spark, str(tmp_path), sections=(2,)).first()
    assert two["sentences"] == ["Første setning", "andre tredje", "fjerde"] and two["pub_year"] == 5
    assert corpora.newspapers(spark, str(tmp_path), sections=(1,), sources=["bb"]).count() == 0
    with pytest.raises(Exception, match="no such section"):
        corpora.newspaper_text(spark.createDataFrame([(9,)], "corpus_section int")).collect()


def test_newsgroups(spark, tmp_path):
    for group, name in (("alt.a", "1"), ("sci.b", "2")):
        (tmp_path / group).mkdir()
        (tmp_path / group / name).write_text("From: x\nSubject: y\n\nJoe wrote:\n> quoted\nBody line\nmore\n\n--\nJoe's footer\n")
    rows = corpora.newsgroups(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["group"], r["target"]) for r in rows] == [("1", "alt.a", 0), ("2", "sci.b", 1)]
    assert rows[0]["article"].strip() == "Body line\nmore"


def test_tables(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("5949\tabsolutely\t342\n497\tfinished\t136\n")
    assert sorted(map(tuple, corpora.term_count_lines(spark, str(tmp_path / "c.tsv")).collect())) == [("absolutely", 342), ("finished", 136)]
    assert corpora.line_count(spark, str(tmp_path / "c.tsv")) == 2 and corpora.text_lines(spark, str(tmp_path / "c.tsv")).first()[0] == "absolutely"
    (tmp_path / "lex.txt").write_bytes("* comment\n1\tbåt\tBåten\tsubst mask appell\tm1\t2\n\n2\tgå\tgår\tverb pres\tv\t1\n".encode("latin-1"))
    rows = corpora.lexicon(spark, str(tmp_path / "lex.txt")).orderBy("line_no").collect()
    assert [(r["word_id"], r["lemma"], r["fullform"], r["pos"], r["ndt_feats"], r["paradigm_entry"]) for r in rows] == [(1, "båt", "båten", "SUBST", "mask|appell", 2), (2, "gå", "går", "VERB", "pres", 1)]
    assert corpora.file_name_of("http://x/a/b.zip?c#d") == "b.zip"


def test_normalised(spark):
    got = corpora.normalised(spark.createDataFrame([(1,), (0,)], "a int"), lambda r: {"b": 1 // r["a"]}, "b long").orderBy("a").collect()
    assert got[1]["b"] == 1 and got[1]["error"] is None and got[0]["error"]


DUMP = """<mediawiki><siteinfo><base>http://x.no/wiki/A</base><namespaces><namespace key="10">Mal</namespace></namespaces></siteinfo>
<page><title>Oslo</title><ns>0</ns><id>1</id><revision><id>5</id><parentid></parentid><contributor><id>7</id></contributor><text xml:space="preserve">{{Infoboks by
| areal = 454
}}
'''Oslo''' er en by i [[Norge]] med mange {{hus}} og mennesker.</text></revision></page>
<page><title>R</title><ns>0</ns><id>2</id><revision><id>6</id><text>#REDIRECT [[Oslo]] and a long enough remainder</text></revision></page>
<page><title>Kort</title><ns>0</ns><id>3</id><revision><id>8</id><text>For kort.</text></revision></page>
<page><title>Mal:Hus</title><ns>10</ns><id>4</id><revision><id>9</id><text>store hus</text></revision></page></mediawiki>"""


def test_dump(spark, tmp_path):
    (tmp_path / "d.xml.bz2").write_bytes(bz2.compress(DUMP.encode()))
    where = str(tmp_path / "d.xml.bz2")
    info = wikitext.site_info(spark, where)
    assert info["template_prefix"] == "Mal:" and info["base"] == "http://x.no/wiki"
    raw = wikitext.dump(spark, where)
    rows = wikitext.pages(raw).collect()
    assert [(r["id"], r["title"], r["revision_parentid"], r["contributor_id"]) for r in rows] == [(1, "Oslo", -1, 7)]
    assert rows[0]["infoboks"] == {"areal": "454"} and rows[0]["article"]["text"] == "Oslo er en by i Norge med mange og mennesker."
    site = wikitext.site_of(wikitext.templates(raw, "Mal:"), "Mal:")
    assert "mange store hus og" in wikitext.pages(raw, site=site).first()["article"]["text"]
    assert {r["title"] for r in wikitext.in_namespaces(raw, template_prefix="Mal:").collect()} == {"Oslo", "Kort"}
    assert '<doc id="1" url="b?curid=1"' in wikitext.marked_up(wikitext.pages(raw), "b").first()["value"]


CLEAN = [
    ("[[Oslo]]s [[By|byer]]", "Oslos byer"), ("[[Fil:x.jpg|thumb|y]]tekst", "tekst"), ("[http://x.no lenke] igjen", " igjen"), ("{{mal|1}}A{{!}}B", "A|B"), ("{{lc:ABC}}", "abc"), ("{{#if: |x|y}}", "y"), ("{{#switch: b|a=1|b=2|#default=3}}", "2"),
    ("'''fet''' og ''kursiv''", 'fet og "kursiv"'), ("A<ref>note</ref>B<!-- c -->", "AB"), ("[//x.no lenke]", "lenke"), ("<div>a</div>b", "ab"), ("{| x {| y |} |}z", "z"), ("{{#expr: (1+2)*3 mod 4}}", "1"), ("{{#ifeq: a|a|x|y}}", "x"), ("{{#invoke:convert|convert|5|km}}", "5 km"), ("{{ucfirst:ab}}{{#time:x}}", "Ab"),
]


@pytest.mark.parametrize("source,want", CLEAN)
def test_clean(source, want):
    assert wikitext.Page().clean(source) == want


def test_sections_and_templates():
    page = wikitext.Page()
    assert page.compact("== Historie ==\nTekst her\n== Tom ==") == ["Historie.", "Tekst her"] and page.compact("* punkt\n: innrykk\n(merknad)") == []
    assert wikitext.Page(keep_sections=True).compact("== A ==\nb") == ["b"]
    assert wikitext.Page(html=True).compact("== A ==\nb\n* c") == ["<h2>A</h2>", "b", "<ul>", "<li>c</li>", "</ul>"]
    site = wikitext.Site()
    site.define("Template:Mal", "Hei {{{1|ingen}}} {{{navn}}}!<noinclude>x</noinclude>")
    site.define("Template:R", "#REDIRECT [[Template:Mal]]")
    site.define("Template:Loop", "{{loop}}x")
    assert wikitext.Page(site).expand("{{mal|Ola|navn=X}}{{r|b}}{{mal}}") == "Hei Ola X!Hei b !Hei ingen !"
    assert set(wikitext.Page(site).expand("{{loop}}")) <= {"x"}
    assert wikitext.Page(title="T").expand("{{PAGENAME}}{{CURRENTYEAR}}") == "T2015"
    assert 'class="error"' in wikitext.Page().expand("{{#expr: 1/0}}") and wikitext.Page().expand("{{#expr: __import__('os')}}").startswith("<span")
    assert wikitext.Page().expand("{{#iferror: {{#expr: 1/0}}|bad|good}}") == "bad"


def test_infobox():
    assert wikitext.infobox("{{Infoboks by\n| navn = [[Oslo]]\n| areal = 454<ref>x</ref>\n| tom = \n}}\nText") == {"navn": "oslo", "areal": "454"}
    assert wikitext.infobox("nothing") is None and wikitext.infobox("{{Infoboks by\n| a = b") is None and wikitext.infobox(None) is None


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a\tb"), (2, "c"), (2, "c")], "doc_id int, text string")
    where = str(tmp_path / "t")
    sinks.install(rows, where)
    sinks.index(rows, where, key="doc_id")
    assert sorted(map(tuple, spark.read.parquet(where).collect())) == [(1, "a\tb"), (2, "c")]
    sinks.index(spark.createDataFrame([(2, "new"), (3, "d")], "doc_id int, text string"), where, key="doc_id")
    assert sorted(map(tuple, spark.read.parquet(where).collect())) == [(1, "a\tb"), (2, "new"), (3, "d")]
    sinks.index(rows, where)
    assert spark.read.parquet(where).count() == 6 and corpora.table(spark, where, "doc_id = 1", "text").columns == ["text"]
    assert sinks.delete(spark, where) and not sinks.delete(spark, where)
    sinks.id_text(rows, where)
    assert sorted(r[0] for r in spark.read.text(where).collect())[0] == "1\ta b"
    sinks.split_text(rows.repartition(1), str(tmp_path / "s"), 1, bzip2=True, column="text")
    assert len(list((tmp_path / "s").glob("*.bz2"))) == 3
    sinks.topic_csv(spark.createDataFrame([(1, ["a", "b"])], "t int, k array<string>"), str(tmp_path / "k"))
    assert spark.read.option("escape", '"').csv(str(tmp_path / "k"), header=True).first()["k"] == '["a","b"]'
    sinks.vocabulary_text(spark.createDataFrame([(0, "x", 2)], "id long, term string, df long"), str(tmp_path / "v"))
    assert spark.read.text(str(tmp_path / "v")).first()[0] == "0\tx\t2"
    assert tuple(sinks.load_vocabulary(spark, str(tmp_path / "v")).first()) == (0, "x", 2)
    sinks.template_cache(spark.createDataFrame([("T", "x")], "title string, text string"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).select(F.col("text")).first()[0] == "x"


def test_split_files(spark, tmp_path):
    rows = spark.range(450).coalesce(1).selectExpr("repeat('x', 40) as value")
    found = sinks.split_files(rows, str(tmp_path / "out"), 100).collect()
    assert len(found) == 225 and all(r["bytes"] == 82 for r in found)
    assert sorted(p.name for p in (tmp_path / "out" / "00000").iterdir()) == ["AA", "AB", "AC"] and len(list((tmp_path / "out" / "00000" / "AA").iterdir())) == 100
    packed = sinks.split_files(rows.limit(3), str(tmp_path / "packed"), 100, bzip2=True).collect()
    assert [bz2.decompress(open(r["path"], "rb").read()).count(b"\n") for r in packed] == [2, 1]
    long = sinks.split_files(spark.createDataFrame([("y" * 500,), ("z",)], "value string").coalesce(1), str(tmp_path / "long"), 100).collect()
    assert sorted(r["bytes"] for r in long) == [2, 501]


@pytest.mark.parametrize("bad", [0, 1, 2])
def test_bad_member_does_not_hide_others(spark, tmp_path, bad):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(3):
            if i == bad:
                z.writestr(f"{i}.gz", b"not gzip")
            else:
                z.writestr(f"{i}.txt", f"text {i}")
    rows = {r["file"]: r for r in corpora.archive_members(spark, str(tmp_path / "a.zip")).collect()}
    assert {f for f, r in rows.items() if r["error"] is None} == {f"{i}.txt" for i in range(3) if i != bad}
    assert rows[f"{bad}.gz"]["value"] is None and "gzip" in rows[f"{bad}.gz"]["error"].lower()


def test_members_are_pruned_by_name(spark, tmp_path):
    """A member that isn't asked for is never decompressed: one that can't be gives no error."""
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("nob/a.conll.gz", gzip.compress(CONLL.encode()))
        z.writestr("nno/b.conll.gz", b"not gzip")
        z.writestr("inner.tar.gz", b"not gzip either")
    found = corpora.archive_members(spark, str(tmp_path / "a.zip"), [r"\.conll$", "nob"]).collect()
    assert sorted((r["file"], r["error"] is None) for r in found) == [("inner.tar.gz", False), ("nob/a.conll", True)]
    assert corpora.treebank(spark, str(tmp_path / "a.zip"), lang="nob").count() == 2


def test_nested_structs_and_single_article(spark, tmp_path):
    rows = spark.createDataFrame([(1, ("x", ("y",)))], "id int, revision struct<id:string, contributor:struct<id:string>>")
    assert wikitext.flat(rows).columns == ["id", "revision_id", "revision_contributor_id"]
    assert tuple(wikitext.flat(rows, "revision.contributor.id").first()) == ("y",)
    (tmp_path / "one.xml").write_text(DUMP)
    one = wikitext.single_article(spark, str(tmp_path / "one.xml"))
    assert (one["id"], one["title"]) == (1, "Oslo") and one["text"].endswith("Oslo er en by i Norge med mange og mennesker.")
    (tmp_path / "none.xml").write_text("nothing")
    assert wikitext.single_article(spark, str(tmp_path / "none.xml")) is None


def test_parameter_depth_and_ignored_tags():
    deep = "end"
    for i in range(12):
        deep = "{{{p%d|%s}}}" % (i, deep)
    shallow = "{{{a|{{{b|end}}}}}}"
    site = wikitext.Site()
    site.define("Template:Deep", deep)
    site.define("Template:Shallow", shallow)
    assert wikitext.Page(site).expand("{{deep}}") == "" and wikitext.Page(site).expand("{{shallow}}") == "end"
    assert "mark" not in wikitext.UNWRAPPED
    wikitext.ignore_tag("mark")
    try:
        assert wikitext.Page().clean("a<mark>b</mark>c") == "abc"
    finally:
        wikitext.UNWRAPPED.remove("mark")
