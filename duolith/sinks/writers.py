"""Rendering aligned pairs: HTML, EPUB, text, review."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duolith.functions import text as T


def shown_target(pairs: DataFrame) -> Column:
    """The target text that counts: a correction, else the text, else a machine's."""
    have = [F.nullif(F.trim(c), F.lit("")) for c in ("fix", "tgt_text", "mt") if c in pairs.columns]
    return F.coalesce(*have, F.lit(""))


def pair_html(pairs: DataFrame, *, target_first: bool = False) -> DataFrame:
    """Each pair as a div of its source and target paragraphs; sides that are missing are left out.

    Where pairs have them, a level above 0 makes headings of both sides, and an image
    (its path) with a caption makes a figure.
    """
    have = set(pairs.columns)
    level = F.coalesce("level", F.lit(0)) if "level" in have else F.lit(0)
    name = F.when(level > 0, F.concat(F.lit("h"), F.least(level + 1, F.lit(6)).cast("string"))).otherwise("p")
    side = lambda c, cls: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit("<"), name, F.lit(f' class="{cls}">'), T.escaped(c), F.lit("</"), name, F.lit(">")))
    s, t = side(F.col("src_text"), "src"), side(shown_target(pairs), "tgt")
    html = F.concat(F.lit('<div class="pair">'), F.concat_ws("", *((t, s) if target_first else (s, t))), F.lit("</div>"))
    if "image" in have:
        caption = T.escaped(F.coalesce("caption", F.lit(""))) if "caption" in have else F.lit("")
        figure = F.concat(F.lit('<figure><img src="'), T.escaped(F.col("image")), F.lit('" alt=""/><figcaption>'), caption, F.lit("</figcaption></figure>"))
        html = F.when(F.coalesce("image", F.lit("")) != "", figure).otherwise(html)
    return pairs.withColumn("html", html)


def chapter_html(pairs: DataFrame, key: list[str], *, notes: DataFrame | None = None, **options) -> DataFrame:
    """O3: pairs of each chapter joined in order: key, html, n_pairs; notes (key, num, text) follow as a numbered list."""
    rows = pair_html(pairs, **options)
    parts = F.array_sort(F.collect_list(F.struct("pair_idx", "html")))
    out = rows.groupBy(*key).agg(F.array_join(F.transform(parts, lambda p: p["html"]), "\n").alias("html"), F.count("*").alias("n_pairs"))
    if notes is None:
        return out
    item = F.concat(F.lit('<li id="note_'), F.col("num").cast("string"), F.lit('">'), T.escaped(F.col("text")), F.lit("</li>"))
    told = notes.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("num", item.alias("li")))).alias("_notes"))
    block = F.concat(F.lit('\n<section class="notes"><ol>'), F.array_join(F.transform("_notes", lambda n: n["li"]), ""), F.lit("</ol></section>"))
    return out.join(told, key, "left").select(*key, F.concat("html", F.coalesce(block, F.lit(""))).alias("html"), "n_pairs")


def single_language(html: Column, cls: str) -> Column:
    """A page without the paragraphs of one side."""
    return F.regexp_replace(html, f'<(p|h[1-6]) class="{cls}">[^<]*</(?:p|h[1-6])>', "")


def html_page(title: Column, body: Column) -> Column:
    """O2: a whole page."""
    return F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"/><title>'), T.escaped(title), F.lit("</title></head><body>"), body, F.lit("</body></html>"))


def interleaved(pairs: DataFrame, key: list[str], *, markdown: bool = True) -> DataFrame:
    """Text of each chapter, source and target in turn; a title becomes a heading."""
    line = F.concat_ws("\n\n", F.nullif("src_text", F.lit("")), F.nullif(shown_target(pairs), F.lit("")))
    if markdown and "level" in pairs.columns:
        line = F.when(F.col("level") > 0, F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.regexp_replace(line, "\n+", " "))).otherwise(line)
    parts = F.array_sort(F.collect_list(F.struct("pair_idx", line.alias("line"))))
    return pairs.groupBy(*key).agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n\n").alias("value"))


def review(pairs: DataFrame, low: float = 1.0, high: float = 3.0) -> DataFrame:
    """One line for each pair with its ratio and a mark where it is out of range."""
    mark = F.when(F.col("r").between(low, high), "").otherwise(" !")
    return pairs.withColumn("value", F.concat(F.lit("### "), F.col("pair_idx").cast("string"), F.format_string(" r=%.2f", "r"), mark, F.lit("\n"), F.coalesce("src_text", F.lit("")), F.lit("\n"), F.coalesce("tgt_text", F.lit(""))))


def write_text(df: DataFrame, path: str, by: list[str]) -> None:
    """One folder for each value of `by`; Spark's committer makes the write whole or not at all."""
    df.select(*by, "value").write.partitionBy(*by).text(path)


def with_missing_anchors(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """Anchors put before documents for references that have none: docs (doc_id, html), refs (doc_id, anchor)."""
    lost = refs.join(docs, "doc_id").where(~F.contains("html", F.concat(F.lit('id="'), F.col("anchor"), F.lit('"')))).select("doc_id", "anchor").distinct()
    spans = lost.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("anchor")), lambda a: F.concat(F.lit('<span id="'), a, F.lit('"></span>'))), "").alias("spans"))
    return docs.join(spans, "doc_id", "left").withColumn("html", F.concat(F.coalesce("spans", F.lit("")), "html")).drop("spans")


Entry = tuple[str, str, int]  # file, title, level from 1


def tree(entries: list[Entry]) -> list[tuple[str, str, list]]:
    """Entries with those below them."""
    top: list = []
    open_: list[tuple[int, list]] = [(0, top)]
    for file, title, level in entries:
        while open_[-1][0] >= level:
            open_.pop()
        inner: list = []
        open_[-1][1].append((file, title, inner))
        open_.append((level, inner))
    return top


def navigation(entries: list[Entry]) -> str:
    """The navigation document, with lists within lists."""

    def listed(found: list) -> str:
        return "<ol>" + "".join(f'<li><a href="{f}">{t}</a>{listed(inner) if inner else ""}</li>' for f, t, inner in found) + "</ol>"

    return f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>Contents</title></head><body><nav epub:type="toc">{listed(tree(entries))}</nav></body></html>'


def ncx(title: str, entries: list[Entry]) -> str:
    """The same for older readers."""
    order = iter(range(1, len(entries) + 1))

    def points(found: list) -> str:
        return "".join(f'<navPoint id="n{n}" playOrder="{n}"><navLabel><text>{t}</text></navLabel><content src="{f}"/>{points(inner)}</navPoint>' for f, t, inner in found for n in [next(order)])

    return f'<?xml version="1.0" encoding="utf-8"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head/><docTitle><text>{title}</text></docTitle><navMap>{points(tree(entries))}</navMap></ncx>'


def epub_bytes(title: str, lang: str, chapters: list[tuple]) -> bytes:
    """O1: an EPUB of chapters: title, body html and, if not 1, level."""
    files = [(f"c{i:04d}.xhtml", t, b, level[0] if level else 1) for i, (t, b, *level) in enumerate(chapters)]
    listed = [(f, t, level) for f, t, _, level in files]
    items = "".join(f'<item id="c{i}" href="{f}" media-type="application/xhtml+xml"/>' for i, (f, *_) in enumerate(listed))
    refs = "".join(f'<itemref idref="c{i}"/>' for i in range(len(listed)))
    opf = (
        '<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id">'
        f'<metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">duolith</dc:identifier><dc:title>{title}</dc:title><dc:language>{lang}</dc:language></metadata>'
        f'<manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>{items}</manifest><spine toc="ncx">{refs}</spine></package>'
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip")
        z.writestr("META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        z.writestr("OEBPS/content.opf", opf)
        z.writestr("OEBPS/nav.xhtml", navigation(listed))
        z.writestr("OEBPS/toc.ncx", ncx(title, listed))
        for name, t, body, _ in files:
            z.writestr(f"OEBPS/{name}", f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml"><head><title>{t}</title></head><body><h1>{t}</h1>{body}</body></html>')
    return out.getvalue()


def epubs(chapters: DataFrame) -> DataFrame:
    """O1: one EPUB for each book of chapters (book, chapter_ord, title, html and, if nested, level), as bytes: book, content. A book is one task's unit."""
    level = F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)) if "level" in chapters.columns else F.lit(1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chapter_ord")
        book = pdf["book"].iloc[0]
        return pd.DataFrame({"book": [book], "content": [epub_bytes(book, "en", list(zip(pdf["title"], pdf["html"], pdf["level"], strict=True)))]})

    return chapters.select("book", "chapter_ord", T.escaped(F.col("title")).alias("title"), "html", level.alias("level")).groupBy("book").applyInPandas(run, "book string, content binary")


def content_key(*parts: Column) -> Column:
    """Name of a stored result by what it is made from."""
    return F.sha2(F.concat_ws("\n", *parts), 256)


def distinct_work(df: DataFrame, *parts: str) -> DataFrame:
    """Each different input of a costly step once, with the key to join its result back."""
    return df.select(content_key(*map(F.col, parts)).alias("key"), *parts).dropDuplicates(["key"])
