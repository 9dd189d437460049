"""Ordered rows: islands, sections, tails, offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duolith.functions import text as T


def _w(key: Sequence[str], order: str):
    return Window.partitionBy(*key).orderBy(order)


def islands(df: DataFrame, key: Sequence[str], order: str, flag: Column) -> DataFrame:
    """Runs of neighbouring rows that carry a flag: key, first, last, n."""
    w = _w(key, order)
    rows = df.withColumn("_flag", F.coalesce(flag, F.lit(False))).withColumn("_rn", F.row_number().over(w))
    rows = rows.where("_flag").withColumn("_island", F.col("_rn") - F.row_number().over(w))
    return rows.groupBy(*key, "_island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_island")


def longest_run(df: DataFrame, key: Sequence[str], order: str, flag: Column) -> DataFrame:
    """Length of the longest run of each key that has one."""
    return islands(df, key, order, flag).groupBy(*key).agg(F.max("n").alias("longest"))


def chains(df: DataFrame, key: Sequence[str], at: str, gap: int) -> DataFrame:
    """Flagged places merged while the gap between them is at most `gap`: key, first, last, n."""
    w = _w(key, at)
    new = (F.col(at) - F.lag(at).over(w) > gap).cast("int")
    rows = df.withColumn("_new", F.coalesce(new, F.lit(1))).withColumn("_chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*key, "_chain").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("_chain")


def adjacent_repeats(df: DataFrame, key: Sequence[str], order: str, value: str) -> DataFrame:
    """Rows whose value is that of the row before."""
    return df.withColumn("_before", F.lag(value).over(_w(key, order))).where(F.col(value) == F.col("_before")).drop("_before")


def modal_level(df: DataFrame, key: Sequence[str], level: str) -> DataFrame:
    """The commonest level of each key; of equals the smallest."""
    counts = df.groupBy(*key, level).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*key).orderBy(F.desc("_n"), level)
    return counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*key, F.col(level).alias("modal_level"))


def split_sections(blocks: DataFrame, *, deep: bool = False) -> DataFrame:
    """Sections of each document's blocks (doc_id, pos, type, level, text).

    The first heading is the document's title; headings of the modal level (every
    heading, if deep) open sections. Adds sec (from 0), section_title, para_idx
    (place among the section's paragraphs, headings and visuals aside) and after
    (for visuals: the paragraph before, -1 for none).
    """
    w = _w(["doc_id"], "pos")
    heading = F.col("type") == "heading"
    nth = F.sum(heading.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = blocks.withColumn("_nth", nth)
    later = rows.where(heading & (F.col("_nth") > 1)).select("doc_id", "level")
    rows = rows.join(modal_level(later, ["doc_id"], "level"), "doc_id", "left")
    opens = heading & (F.col("_nth") > 1) & (F.lit(deep) | (F.col("level") == F.col("modal_level")))
    rows = rows.withColumn("_opens", F.coalesce(opens, F.lit(False)))
    rows = rows.withColumn("_sec", F.sum(F.col("_opens").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy("doc_id", "_sec").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    visual = F.col("type").isin("figure", "image", "table", "formula")
    para = ~heading & ~visual
    seen = F.sum(para.cast("int")).over(inner) - 1
    title = F.first(F.when(F.col("_opens"), F.col("text")), ignorenulls=True).over(Window.partitionBy("doc_id", "_sec").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    full = F.max((~heading | F.col("_opens")).cast("int")).over(Window.partitionBy("doc_id", "_sec"))
    rows = rows.withColumns({"para_idx": F.when(para, seen), "after": F.when(visual, seen), "section_title": F.coalesce(title, F.lit("")), "_full": full})
    # A part that holds nothing but the title is no section.
    rows = rows.where("_full = 1").withColumn("sec", F.dense_rank().over(_w(["doc_id"], "_sec")) - 1)
    return rows.select(*blocks.columns, "sec", "section_title", "para_idx", "after")


def conservation(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """Documents whose blocks that aren't headings didn't all come through."""
    count = lambda df: df.groupBy("doc_id").agg(F.count(F.when(F.col("type") != "heading", 1)).alias("n"))
    both = count(blocks).withColumnRenamed("n", "n_in").join(count(sections).withColumnRenamed("n", "n_out"), "doc_id", "left").fillna(0, ["n_out"])
    return both.where("n_in <> n_out")


def note_boundary(paras: DataFrame, key: Sequence[str], order: str, text: str, hint: Column | int = 0) -> DataFrame:
    """Where the tail of notes begins: key, n, boundary (n if there is none).

    A suffix sum of +1 for notes and -1 for running text is greatest there; ties go
    to the earlier place. Only the last 10 rows count, or 2.2 * hint + 20.
    """
    hint = F.lit(hint) if isinstance(hint, int) else hint
    score = F.when(T.note_likeness(F.col(text)) >= 0.5, 1).otherwise(-1)
    size = Window.partitionBy(*key)
    rows = paras.select(*key, order, score.alias("_s"), F.when(hint <= 0, 10).otherwise(F.floor(2.2 * hint) + 20).alias("_span"))
    rows = rows.withColumns({"n": F.count("*").over(size), "_at": F.row_number().over(_w(key, order)) - 1})
    rows = rows.where(F.col("_at") >= F.col("n") - F.col("_span"))
    back = Window.partitionBy(*key).orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.withColumn("_sum", F.sum("_s").over(back))
    best = F.max(F.struct("_sum", -F.col("_at")))
    out = sums.groupBy(*key).agg(F.max("n").alias("n"), best.alias("_b"))
    return out.select(*key, "n", F.when(F.col("_b._sum") > 0, -F.col("_b.col2")).otherwise(F.col("n")).alias("boundary"))


def rank_before(df: DataFrame, key: Sequence[str], order: str, flag: Column) -> DataFrame:
    """How many rows without the flag come before each row."""
    w = _w(key, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("rank_before", F.coalesce(F.sum((~F.coalesce(flag, F.lit(False))).cast("int")).over(w), F.lit(0)))


def windows(n: Column, *, width: int = 40, overlap: int = 10, whole: int = 80) -> Column:
    """Starts and ends (exclusive) of sliding windows over n places; up to `whole` places are one window."""
    step = width - overlap
    last = F.greatest(F.lit(0), F.ceil((n - width) / step)) * step
    sliding = F.transform(F.sequence(F.lit(0), last.cast("int"), F.lit(step)), lambda a: F.struct(a.alias("low"), F.least(a + width, n).alias("high")))
    return F.when(n <= whole, F.array(F.struct(F.lit(0).alias("low"), n.cast("int").alias("high")))).otherwise(sliding)


def context(pairs: DataFrame, key: Sequence[str], order: str, text: str, side: Column, n: int = 2) -> DataFrame:
    """The texts of the n rows before and after that have the side, the nearest first.

    The texts of the side are numbered and each row looks up the numbers around its
    own place, so nothing is held but the rows themselves.
    """
    w = _w(key, order)
    rows = pairs.withColumns({"_in": F.coalesce(side, F.lit(False)).cast("int")}).withColumn("_at", F.sum("_in").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # Of a run without the side each row has the place of the one before it: steps count rows of the side only.
    seen = rows.where("_in = 1").withColumns({f"_b{d}": F.lag(text, d).over(w) for d in range(n)} | {f"_a{d}": F.lead(text, d).over(w) for d in range(n + 1)})
    seen = seen.select(*key, F.col("_at").alias("_place"), *[f"_b{d}" for d in range(n)], *[f"_a{d}" for d in range(n + 1)])
    before = seen.select(*key, (F.col("_place")).alias("_up"), F.filter(F.array(*[f"_b{d}" for d in range(n)]), lambda x: x.isNotNull()).alias("before"))
    after = seen.select(*key, (F.col("_place") - 1).alias("_at"), F.filter(F.array(*[f"_a{d}" for d in range(n)]), lambda x: x.isNotNull()).alias("after_texts"))
    out = rows.withColumn("_up", F.col("_at") - F.col("_in")).join(before, [*key, "_up"], "left").join(after, [*key, "_at"], "left")
    none = F.array().cast("array<string>")
    return out.select(*pairs.columns, F.coalesce("before", none).alias("before"), F.coalesce("after_texts", none).alias("after_texts"))


def split_tail(paras: DataFrame, key: Sequence[str], order: str, text: str, n_notes: Column) -> DataFrame:
    """The last n_notes paragraphs as notes where there are more paragraphs than that: adds part (body or notes) and the notes' mean likeness."""
    size, back = F.count("*").over(Window.partitionBy(*key)), F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))
    rows = paras.withColumn("part", F.when((n_notes > 0) & (size > n_notes) & (back <= n_notes), "notes").otherwise("body"))
    likeness = F.avg(F.when(F.col("part") == "notes", T.note_likeness(F.col(text)))).over(Window.partitionBy(*key))
    return rows.withColumn("tail_likeness", F.coalesce(likeness, F.lit(0.0)))


def split_detected(paras: DataFrame, key: Sequence[str], order: str, text: str, hint: Column | int = 0) -> DataFrame:
    """Paragraphs from the detected boundary on are notes: adds part."""
    cut = note_boundary(paras, key, order, text, hint).select(*key, "boundary")
    rows = paras.withColumn("_at", F.row_number().over(_w(key, order)) - 1).join(cut, list(key))
    return rows.withColumn("part", F.when(F.col("_at") >= F.col("boundary"), "notes").otherwise("body")).drop("_at", "boundary")


def cut_notes(paras: DataFrame, key: Sequence[str], order: str, text: str, n_notes: Column, *, trust: float = 0.5) -> DataFrame:
    """Notes by their number where the tail looks like notes, else from the detected boundary on: adds part."""
    counted = split_tail(paras, key, order, text, n_notes)
    found = split_detected(paras, key, order, text).select(*key, order, F.col("part").alias("_found"))
    rows = counted.join(found, [*key, order])
    return rows.withColumn("part", F.when(F.col("tail_likeness") >= trust, F.col("part")).otherwise(F.col("_found"))).drop("_found", "tail_likeness")


def median_outliers(df: DataFrame, key: Sequence[str], value: str, low: float = 0.55, high: float = 1.9) -> DataFrame:
    """Each value beside its group's median (of the middle two, their mean), and whether it is outside the band."""
    med = df.groupBy(*key).agg(F.percentile(value, 0.5).alias("median"))
    out = df.join(med, list(key))
    return out.withColumn("skewed", (F.col("median") > 0) & ~(F.col(value) / F.col("median")).between(low, high))


def promote_first(blocks: DataFrame) -> DataFrame:
    """In a document without headings, a short first block that doesn't end like a sentence becomes one."""
    all_ = Window.partitionBy("doc_id")
    bare = (F.max((F.col("type") == "heading").cast("int")).over(all_) == 0) & (F.count("*").over(all_) >= 2)
    first = F.row_number().over(_w(["doc_id"], "pos")) == 1
    s = T.stripped(F.col("text"))
    rise = bare & first & (F.length(s) > 0) & (F.length(s) <= 40) & ~s.rlike("[.。,，;；:：]$")
    return blocks.withColumn("_rise", rise).withColumns({"type": F.when(F.col("_rise"), "heading").otherwise(F.col("type")), "level": F.when(F.col("_rise"), 1).otherwise(F.col("level"))}).drop("_rise")


def fill_captions(blocks: DataFrame) -> DataFrame:
    """A visual without caption takes the label at +1, -1, +2 or -2; the label is marked as consumed."""
    w = _w(["doc_id"], "pos")
    visual = F.col("type").isin("figure", "image", "table", "formula")
    label = F.when(~visual & (F.col("type") != "heading") & T.is_caption_label(F.col("text")), F.struct("pos", "text"))
    near = F.coalesce(*[F.lead(label, d).over(w) if d > 0 else F.lag(label, -d).over(w) for d in (1, -1, 2, -2)])
    needs = visual & (F.coalesce(T.stripped(F.col("caption")), F.lit("")) == "")
    rows = blocks.withColumn("_label", F.when(needs, near))
    used = rows.where("_label is not null").select("doc_id", F.col("_label.pos").alias("pos")).distinct().withColumn("cap_consumed", F.lit(True))
    rows = rows.withColumn("caption", F.coalesce(F.col("_label.text"), "caption")).drop("_label")
    rows = rows.drop("cap_consumed") if "cap_consumed" in rows.columns else rows
    return rows.join(used, ["doc_id", "pos"], "left").fillna(False, ["cap_consumed"])


def fold_head_noise(blocks: DataFrame) -> DataFrame:
    """Of the first ten blocks, page numbers and the repeated title go; a quote's source joins the quote before."""
    w = _w(["doc_id"], "pos")
    s = T.stripped(F.col("text"))
    title = F.first(F.when(F.col("type") == "heading", s), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = blocks.withColumns({"_n": F.row_number().over(w), "_title": title})
    noise = (F.col("_n") <= 10) & (F.col("type") == "para") & (s.rlike("(?i)^(?:[0-9]{1,4}|[ivxlcdm]{1,7})$") | (s == F.col("_title")))
    rows = rows.where(~F.coalesce(noise, F.lit(False))).drop("_n", "_title")
    source = (F.col("type") == "quote") & (F.length(s) <= 40) & s.rlike("^[^，,。.;；!！?？]{1,40}([,，]\\s*[0-9]{3,4}\\s*年?|[(（]\\s*[0-9]{3,4}\\s*[)）])\\s*$")
    joins = F.coalesce(source & (F.lag("type").over(w) == "quote"), F.lit(False))
    rows = rows.withColumn("_joins", joins)
    rows = rows.withColumn("_unit", F.sum((~F.col("_joins")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    keep = [c for c in blocks.columns if c not in ("doc_id", "pos", "text")]
    firsts = [F.min_by(c, "pos").alias(c) for c in keep]
    out = rows.groupBy("doc_id", "_unit").agg(F.min("pos").alias("pos"), F.array_join(F.transform(parts, lambda p: T.stripped(p["text"])), " ").alias("text"), *firsts)
    return out.select(*blocks.columns)


def demote_unnumbered(heads: DataFrame) -> DataFrame:
    """A heading at the modal level without number goes down one level if two numbered ones or more are at that level."""
    rows = heads.join(modal_level(heads, ["doc_id"], "level"), "doc_id")
    numbered = T.section_number(F.col("text")) != ""
    peers = F.sum((numbered & (F.col("level") == F.col("modal_level"))).cast("int")).over(Window.partitionBy("doc_id"))
    lower = (F.col("level") == F.col("modal_level")) & ~numbered & (peers >= 2)
    return rows.withColumn("level", F.when(lower, F.col("level") + 1).otherwise(F.col("level"))).drop("modal_level")


def merge_broken(paras: DataFrame, broken: Column, goes_on: Column) -> DataFrame:
    """A paragraph that breaks off takes the next one that goes on; each takes part in one merge only.

    broken and goes_on are predicates on text. Returns doc_id, idx, text, n (1 or 2).
    In a run of possible merges every other one is made, from the first.
    """
    w = _w(["doc_id"], "idx")
    rows = paras.withColumns({"_b": F.coalesce(broken, F.lit(False)), "_g": F.coalesce(goes_on, F.lit(False))})
    rows = rows.withColumns({"_link": F.col("_b") & F.coalesce(F.lead("_g").over(w), F.lit(False)), "_rn": F.row_number().over(w)})
    # Place within the run of links: the rows since the last one that doesn't link.
    stop = F.last(F.when(~F.col("_link"), F.col("_rn")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_head", F.col("_link") & ((F.col("_rn") - F.coalesce(stop, F.lit(0))) % 2 == 1))
    rows = rows.withColumn("_unit", F.when(F.coalesce(F.lag("_head").over(w), F.lit(False)), F.col("_rn") - 1).otherwise(F.col("_rn")))
    parts = F.array_sort(F.collect_list(F.struct("idx", "text")))
    out = rows.groupBy("doc_id", "_unit").agg(parts.alias("parts"))
    return out.select("doc_id", F.col("parts")[0]["idx"].alias("idx"), F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("text"), F.size("parts").alias("n"))


def repeated_texts(df: DataFrame, text: str, file: str, least: int = 3) -> DataFrame:
    """Texts in `least` files or more, with the number of files; two steps, so no file list is held."""
    return df.select(text, file).distinct().groupBy(text).agg(F.count("*").alias("n_files")).where(F.col("n_files") >= least)


def without_repeated(df: DataFrame, text: str, file: str, least: int = 3) -> DataFrame:
    return df.join(repeated_texts(df, text, file, least), text, "left_anti")


def merged_titles(rows: DataFrame) -> DataFrame:
    """Candidate headings (file, text, src, level, spine) by file and text: their sources in order, least level and place."""
    return rows.groupBy("file", "text").agg(F.array_sort(F.collect_set("src")).alias("srcs"), F.min("level").alias("level"), F.min("spine").alias("spine"))


def ordinal_keys(units: DataFrame, key: str, order: str, kind: str) -> DataFrame:
    """Units without number get their place within their kind."""
    return units.withColumn("ordinal", F.row_number().over(Window.partitionBy(key, kind).orderBy(order)))
