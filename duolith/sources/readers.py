"""Readers: EPUB, Markdown, plain text, tables of contents, TSV, gold lists, traces."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

from duolith.functions import markup
from duolith.functions import text as T
from duolith.operators.matching import first_of
from duolith.schema import BLOCKS


def epub_parts(spark: SparkSession, path: str) -> DataFrame:
    return parts_of(spark.read.format("binaryFile").load(path).select("path", "content"))


def parts_of(files: DataFrame) -> DataFrame:
    """Members of EPUB files (path, content): book, path, content, length. One file is one task's unit; a member is one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for book, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        if not info.is_dir():
                            data = z.read(info)
                            yield pd.DataFrame({"book": [book], "path": [info.filename], "content": [data], "length": [len(data)]})

    return files.select("path", "content").mapInPandas(run, "book string, path string, content binary, length bigint")


def _text_of(content: Column) -> Column:
    return F.decode(content, "UTF-8")


def package(parts: DataFrame) -> DataFrame:
    """The package document of each book: book, opf_path, opf."""
    box = parts.where("path = 'META-INF/container.xml'").select("book", F.regexp_extract(_text_of(F.col("content")), 'full-path="([^"]+)"', 1).alias("opf_path"))
    return box.join(parts.select("book", F.col("path").alias("opf_path"), _text_of(F.col("content")).alias("opf")), ["book", "opf_path"])


def _attribute(item: Column, name: str) -> Column:
    return F.regexp_extract(item, f"\\b{name}\\s*=\\s*\"([^\"]*)\"", 1)


def resolved(base: Column, href: Column) -> Column:
    """A reference against the folder of its document."""
    folder = F.regexp_replace(base, "[^/]*$", "")
    return T.normalised_path(F.concat(folder, href))


def manifest(parts: DataFrame) -> DataFrame:
    """R2: book, item_id, path, media_type of every item."""
    items = package(parts).select("book", "opf_path", F.explode(F.regexp_extract_all("opf", F.lit("<(?:opf:)?item\\b[^>]*>"), F.lit(0))).alias("i"))
    return items.select("book", _attribute(F.col("i"), "id").alias("item_id"), resolved(F.col("opf_path"), _attribute(F.col("i"), "href")).alias("path"), _attribute(F.col("i"), "media-type").alias("media_type"))


def spine(parts: DataFrame) -> DataFrame:
    """The content documents of each book in reading order: book, spine_idx, path."""
    refs = package(parts).select("book", F.posexplode(F.regexp_extract_all("opf", F.lit("<(?:opf:)?itemref\\b[^>]*idref\\s*=\\s*\"([^\"]+)\""), F.lit(1))).alias("n", "item_id"))
    docs = refs.join(manifest(parts), ["book", "item_id"]).where(F.col("media_type").contains("html"))
    return docs.select("book", (F.row_number().over(Window.partitionBy("book").orderBy("n")) - 1).alias("spine_idx"), "path")


def html_blocks(pages: DataFrame, key: list[str], html: str) -> DataFrame:
    """Key columns and one row for each block; null pages have none. The page's html isn't carried along."""
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    kinds = dict(pages.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in key) + ", " + BLOCKS
    types = to_arrow_schema(StructType.fromDDL(BLOCKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, rows = [], []
            for i, page in enumerate(batch.column(len(key)).to_pylist()):
                blocks = markup.parse_blocks(page) if page else []
                own += [i] * len(blocks)
                rows += blocks
            keys = [batch.column(i).take(pa.array(own, pa.int64())) for i in range(len(key))]
            made = [pa.array([r[f.name] for r in rows], f.type) for f in types]
            yield pa.RecordBatch.from_arrays([*keys, *made], names=[*key, *names])

    return pages.select(*key, html).mapInArrow(run, schema)


def epub_blocks(parts: DataFrame) -> DataFrame:
    docs = spine(parts).join(parts.select("book", "path", _text_of(F.col("content")).alias("html")), ["book", "path"])
    return html_blocks(docs, ["book", "spine_idx", "path"], "html")


@F.pandas_udf(StringType())
def decoded(content: pd.Series) -> pd.Series:
    """The first of UTF-8 (with or without mark), GBK and Big5 that fits, else UTF-8 with replacements."""

    def one(b: bytes) -> str | None:
        if b is None:
            return None
        for name in ("utf-8-sig", "utf-8", "gbk", "big5"):
            try:
                return b.decode(name)
            except UnicodeDecodeError:
                continue
        return b.decode("utf-8", "replace")

    return content.map(one)


def text_documents(texts: DataFrame, lang: str = "en") -> DataFrame:
    """Plain text (book, text) as blocks: book, doc_ord, pos, type, level, text; a heading line opens a document."""
    rows = texts.select("book", F.posexplode(F.split("text", "\r?\n")).alias("pos", "line")).where(F.trim("line") != "")
    rows = rows.withColumn("_head", T.is_heading_line(F.col("line"), lang))
    w = Window.partitionBy("book").orderBy("pos")
    return rows.select(
        "book",
        F.sum(F.col("_head").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("doc_ord"),
        "pos",
        F.when(F.col("_head"), "heading").otherwise("para").alias("type"),
        F.col("_head").cast("int").alias("level"),
        T.stripped(F.col("line")).alias("text"),
    )


def markdown_documents(texts: DataFrame) -> DataFrame:
    """Markdown (book, text) as blocks: book, doc_ord, pos, type, level, text.

    Blank lines end a paragraph; the shallowest heading level opens a document; $$
    blocks and tables are blocks of their own; images are dropped.
    """
    body = T.strip_front_matter(F.col("text"))
    rows = texts.select("book", F.posexplode(F.split(body, "\r?\n")).alias("pos", "line"))
    w = Window.partitionBy("book").orderBy("pos")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    fence = F.trim("line") == "$$"
    fences = F.sum(fence.cast("int")).over(run)
    rows = rows.withColumn("_math", fence | (fences % 2 == 1))
    level = F.when(F.col("_math"), 0).otherwise(F.length(F.regexp_extract("line", "^(#{1,6})\\s+\\S", 1)))
    rows = rows.withColumns({"level": level, "_blank": ~F.col("_math") & (F.trim("line") == "")})
    kind = F.when(F.col("_math") | F.col("line").rlike("^\\s*\\$\\$.+\\$\\$\\s*$"), "formula").when(F.col("line").rlike("(?i)^\\s*<table"), "table").when(F.col("level") > 0, "heading").otherwise("para")
    rows = rows.withColumn("type", kind)
    before = F.lag("type").over(w)
    new = (F.col("type") != before) | (F.col("level") > 0) | F.lag("_blank").over(w) | (fence & ((F.sum(fence.cast("int")).over(run)) % 2 == 1))
    rows = rows.withColumn("_unit", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(run)).where("not _blank")
    parts = F.array_sort(F.collect_list(F.struct("pos", "line")))
    out = rows.groupBy("book", "_unit").agg(F.min("pos").alias("pos"), F.first("type").alias("type"), F.max("level").alias("level"), F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("text"))
    plain = F.when(F.col("type").isin("formula", "table"), F.col("text")).otherwise(T.norm_md_inline(F.regexp_replace(F.regexp_replace("text", "^#{1,6}\\s+", ""), "\n", " ")))
    out = out.withColumn("text", plain).where("text != ''")
    top = F.min(F.when(F.col("level") > 0, F.col("level"))).over(Window.partitionBy("book"))
    out = out.withColumn("_opens", ((F.col("level") > 0) & (F.col("level") == top)).cast("int"))
    return out.select("book", F.sum(F.coalesce("_opens", F.lit(0))).over(run).alias("doc_ord"), "pos", "type", "level", "text")


def toc_entries(nav: DataFrame) -> DataFrame:
    """Navigation documents (book, html) as tree rows: book, pos, level (from 1), title, file, anchor.

    Depth is the number of lists open at an entry.
    """
    tokens = F.regexp_extract_all("html", F.lit("(?is)<ol\\b[^>]*>|</ol\\s*>|<navPoint\\b[^>]*>|</navPoint\\s*>|<a\\b[^>]*href\\s*=\\s*\"[^\"]*\"[^>]*>.*?</a>|<text>[^<]*</text>\\s*</navLabel>\\s*<content\\b[^>]*>"), F.lit(0))
    rows = nav.select("book", F.posexplode(tokens).alias("pos", "t"))
    step = F.when(F.col("t").rlike("(?i)^<(ol|navPoint)"), 1).when(F.col("t").rlike("(?i)^</(ol|navPoint)"), -1).otherwise(0)
    w = Window.partitionBy("book").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_depth", F.sum(step).over(w)).where(F.col("t").rlike("(?i)^<(a|text)"))
    href = F.coalesce(F.nullif(F.regexp_extract("t", "(?i)href\\s*=\\s*\"([^\"]*)\"", 1), F.lit("")), F.regexp_extract("t", "(?i)src\\s*=\\s*\"([^\"]*)\"", 1))
    title = T.without_tags(F.regexp_replace("t", "(?is)<content\\b[^>]*>", ""))
    level = F.col("_depth") - F.min("_depth").over(Window.partitionBy("book")) + 1
    return rows.select("book", "pos", level.alias("level"), title.alias("title"), F.substring_index(href, "#", 1).alias("file"), F.regexp_extract(href, "#(.*)$", 1).alias("anchor"))


def toc_titles(entries: DataFrame) -> DataFrame:
    """One title for each file: entries without anchor or at a chapter first, then parts; section anchors don't count."""
    rank = F.when((F.col("anchor") == "") | F.col("anchor").rlike("(?i)^chapter[0-9]*$"), 0).when(F.col("anchor").rlike("(?i)^part|^[0-9]+$"), 1)
    return first_of(entries.withColumn("_rank", rank).where("_rank is not null"), ["book", "file"], ["_rank", "pos"]).select("book", "file", "title")


def endnotes(docs: DataFrame) -> DataFrame:
    """Notes (book, note_id, text) of the notes document: named so, else the first that says it is one."""
    name = F.lower(F.substring_index("path", "/", -1))
    rank = F.when(name.contains("nts") | name.contains("note"), 0).when(F.col("html").contains("doc-endnotes"), 1)
    doc = first_of(docs.withColumn("_rank", rank).where("_rank is not null"), ["book"], ["_rank", "spine_idx"])
    item = "(?s)<li\\b[^>]*id=\"(en_\\w+)\"[^>]*>(.*?)</li>"
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(item), F.lit(1)).alias("id"), F.regexp_extract_all("html", F.lit(item), F.lit(2)).alias("text"))
    text = T.stripped(F.regexp_replace(T.without_tags(F.col("p.text")), "(?i)BACK TO NOTE REFERENCE\\s*[0-9]*", ""))
    return doc.select("book", F.explode(pairs).alias("p")).select("book", F.col("p.id").alias("note_id"), text.alias("text")).where("text != ''")


def book_metadata(parts: DataFrame) -> DataFrame:
    """Title, creator, publisher, language, isbn and cover path of each book, from its package document."""
    opf = package(parts)
    dc = lambda name: F.nullif(T.without_tags(F.regexp_extract("opf", f"(?is)<dc:{name}\\b[^>]*>(.*?)</dc:{name}>", 1)), F.lit(""))
    cover = F.coalesce(F.nullif(F.regexp_extract("opf", "(?i)<item\\b[^>]*properties=\"[^\"]*cover-image[^\"]*\"[^>]*>", 0), F.lit("")), F.regexp_extract("opf", "(?i)<item\\b[^>]*id=\"cover[^\"]*\"[^>]*media-type=\"image/[^>]*>", 0))
    return opf.select("book", *[dc(n).alias(n) for n in ("title", "creator", "publisher", "language", "date", "identifier")], F.regexp_extract("opf", "(97[89][0-9-]{10,14})", 1).alias("isbn"), resolved(F.col("opf_path"), _attribute(cover, "href")).alias("cover_path"))


def scan_copyright(pages: DataFrame, first: int = 8) -> DataFrame:
    """Publisher, ISBN and year from the first documents of a book (book, spine_idx, text), where the package has none."""
    found = pages.where(F.col("spine_idx") < first).select(
        "book", "spine_idx", F.nullif(F.regexp_extract("text", "ISBN[:： ]*((?:97[89][- ]?)?[0-9][0-9 -]{8,15}[0-9Xx])", 1), F.lit("")).alias("isbn"),
        F.nullif(F.regexp_extract("text", "(?i)(?:©|copyright)\\s*(?:©\\s*)?([12][0-9]{3})", 1), F.lit("")).alias("year"),
    )
    return found.groupBy("book").agg(F.min_by("isbn", F.when(F.col("isbn").isNotNull(), F.col("spine_idx"))).alias("isbn"), F.min_by("year", F.when(F.col("year").isNotNull(), F.col("spine_idx"))).alias("year"))


def preferred(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Field by field the target edition's value, else the source edition's."""
    fields = [c for c in target.columns if c != key]
    both = target.alias("t").join(source.alias("s"), key, "full_outer")
    return both.select(key, *[F.coalesce(F.nullif(F.col(f"t.{c}"), F.lit("")), F.col(f"s.{c}")).alias(c) for c in fields])


def sentence_pairs(spark: SparkSession, path: str) -> DataFrame:
    return sentence_pairs_of(spark.read.text(path))


def sentence_pairs_of(lines: DataFrame) -> DataFrame:
    """A TSV of sentence pairs (value): tgt, src, empty (whether a cell is empty, so that such rows can be counted and left out)."""
    cells = F.split("value", "\t", -1)
    rows = lines.select(F.coalesce(F.get(cells, 0), F.lit("")).alias("tgt"), F.coalesce(F.get(cells, 1), F.lit("")).alias("src"))
    return rows.withColumn("empty", (F.trim("tgt") == "") | (F.trim("src") == ""))


def gold_list(spark: SparkSession, path: str) -> DataFrame:
    return gold_rows(spark.read.text(path))


def gold_rows(lines: DataFrame) -> DataFrame:
    """Lines (value) seq|L<level>|F or blank|text; comment lines are left out."""
    rows = lines.where("value not like '#%' and trim(value) != ''").select(F.split("value", "\\|", 4).alias("p")).where(F.size("p") == 4)
    return rows.select(F.trim(F.col("p")[0]).cast("int").alias("seq"), F.regexp_extract(F.col("p")[1], "([0-9]+)", 1).cast("int").alias("level"), (F.trim(F.col("p")[2]) == "F").alias("front"), F.trim(F.col("p")[3]).alias("text"))


TRACE = "t string, kind string, hit int, in_tok bigint, out_tok bigint, srv_cache bigint, n bigint, drop bigint, n_vis bigint, broken string"


def trace(spark: SparkSession, path: str, low: str = "", high: str = "~") -> DataFrame:
    return trace_rows(spark.read.text(path), low, high)


def trace_rows(lines: DataFrame, low: str = "", high: str = "~") -> DataFrame:
    """A JSON-lines log (value) between two times as text; broken lines are left out."""
    rows = lines.select(F.from_json("value", TRACE, {"columnNameOfCorruptRecord": "broken"}).alias("r")).select("r.*")
    return rows.where(F.col("broken").isNull() & F.col("t").between(low, high)).drop("broken")


def safe_name(name: Column) -> Column:
    """A file name without folders and signs that a file system may refuse."""
    return F.regexp_replace(F.regexp_replace(name, "^.*[/\\\\]", ""), "(?U)[^\\w.\\u4e00-\\u9fff-]+", "_")


def heading_classes(css: DataFrame, ratio: float = 1.12) -> DataFrame:
    """Classes of style sheets (book, css) that look like headings: book, cls, why (size, bold or caps)."""
    rule = "(?s)([^{}]+)\\{([^{}]*)\\}"
    pairs = F.arrays_zip(F.regexp_extract_all("css", F.lit(rule), F.lit(1)).alias("sel"), F.regexp_extract_all("css", F.lit(rule), F.lit(2)).alias("body"))
    rows = css.select("book", F.posexplode(pairs).alias("n", "r")).select("book", "n", F.col("r.body").alias("body"), F.explode(F.regexp_extract_all("r.sel", F.lit("\\.([\\w-]+)"), F.lit(1))).alias("cls"))
    told = F.regexp_extract("body", "font-size\\s*:\\s*([0-9.]+)", 1).try_cast("double")
    unit = F.regexp_extract("body", "font-size\\s*:\\s*[0-9.]+\\s*(px|pt|em|rem|%)", 1)
    px = told * F.when(unit == "pt", 4 / 3).when(unit.isin("em", "rem"), 16.0).when(unit == "%", 0.16).otherwise(1.0)
    rows = rows.withColumn("px", px).withColumn("_bucket", F.bround(F.col("px") * 2) / 2)
    counts = rows.where("px is not null").groupBy("book", "_bucket").agg(F.count("*").alias("_n"))
    base = first_of(counts, ["book"], [F.desc("_n"), "_bucket"]).select("book", F.col("_bucket").alias("base"))
    why = (
        F.when(F.col("px") >= ratio * F.col("base"), "size")
        .when(F.col("body").rlike("(?i)font-weight\\s*:\\s*(bold|[6-9]00)"), "bold")
        .when(F.col("body").rlike("(?i)font-variant\\s*:\\s*small-caps|text-transform\\s*:\\s*uppercase"), "caps")
    )
    rows = rows.join(base, "book", "left").withColumn("why", why).where("why is not null")
    return first_of(rows, ["book", "cls"], ["n"]).select("book", "cls", "why")


def document_titles(docs: DataFrame) -> DataFrame:
    """The <title> of each document (book, path, html), and whether its name says front matter."""
    front = F.lower(F.substring_index("path", "/", -1)).rlike("cover|half[-_]?title|^title|copyright|dedicat|^toc|contents|front")
    return docs.select("book", "path", T.without_tags(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), front.alias("front"))


def word_hints(text: Column) -> Column:
    """Q13: words of four letters and numbers of three or four digits."""
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit("[A-Za-z]{4,}"), F.lit(0)), F.regexp_extract_all(text, F.lit("(?<![0-9])[0-9]{3,4}(?![0-9])"), F.lit(0))))


def multipart_name(disposition: str) -> str:
    """The file name in a part's header."""
    m = re.search(r'filename="([^"]*)"', disposition)
    return m[1] if m else ""


def parse_opf_dc(opf: str) -> dict[str, str]:
    """Dublin Core fields by XML where the document is sound."""
    try:
        root = ElementTree.fromstring(opf)
    except ElementTree.ParseError:
        return {}
    return {e.tag.rsplit("}", 1)[-1]: (e.text or "").strip() for e in root.iter() if "purl.org/dc" in e.tag}
