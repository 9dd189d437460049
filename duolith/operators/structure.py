"""Book structure: typed units, section candidates, numbered pairing, peeling, claims."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duolith.functions import kernels as K
from duolith.functions import text as T
from duolith.operators import matching
from duolith.operators import sequences as S
from duolith.operators.groups import by_both, by_group

# Titles and file names that say what a unit is.
FRONT_TITLES = ["prologue", "preface", "foreword", "introduction", "editor’s foreword", "editor's foreword", "序言", "前言", "编者序", "引言", "导言"]
BACK_TITLES = ["epilogue", "conclusions", "conclusion", "afterword", "acknowledgments", "acknowledgements", "结语", "结论", "后记", "致谢"]
SKIPPED = (
    "(?i)^(contents|cover|title page|half title|copyright|colophon|index|notes|bibliography|references|author index|subject index|about the author|"
    "版权信息|出版信息|内容提要|版权声明|封面|扉页|作者介绍|封面介绍)"
)
NUMBER_WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
FILE_HINTS = [("(?i)_c([0-9]{3})_r[0-9]", "ch"), ("(?i)_p([0-9]{3})_r[0-9]", "pt"), ("(?i)chapter([0-9]{3})\\.xhtml$", "ch"), ("_Chapter([0-9]+)\\.html$", "ch"), ("_Part([0-9]+)\\.html$", "pt"), ("_Appendix([0-9]+)\\.html$", "ap")]


def unit_kind(title: Column, file: Column) -> Column:
    """struct(kind, num): ch, pt, ap, front, back, skip or null; by the title, else by the file's name."""
    t = T.stripped(title)
    got = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    as_ = lambda kind, num: F.struct(F.lit(kind).alias("kind"), num.cast("string").alias("num"))
    none = F.lit(None).cast("string")
    zh_ch, en_ch = got("^第\\s*([0-9一二三四五六七八九十]+)\\s*章"), got("(?i)^Chapter\\s+([0-9]+)")
    zh_pt, en_pt = got("^第\\s*([一二三四五六七八九十]+)\\s*部分"), got("(?i)^Part\\s+([IVXLC]+|[0-9]+)")
    ap = F.coalesce(got("^附录\\s*([A-Da-d])"), got("(?i)^Appendix\\s+([A-D])"))
    low = F.regexp_replace(F.lower(t), "[:：]+$", "")
    out = (
        F.when(t.rlike(SKIPPED), as_("skip", none))
        .when(zh_ch.isNotNull(), as_("ch", T.cn_int(zh_ch)))
        .when(en_ch.isNotNull(), as_("ch", en_ch.cast("int")))
        .when(zh_pt.isNotNull(), as_("pt", T.cn_int(zh_pt)))
        .when(en_pt.rlike("^[0-9]+$"), as_("pt", en_pt.cast("int")))
        .when(en_pt.isNotNull(), as_("pt", T.roman(en_pt)))
        .when(ap.isNotNull(), as_("ap", F.upper(ap)))
        .when(low.isin(FRONT_TITLES), as_("front", none))
        .when(low.isin(BACK_TITLES), as_("back", none))
    )
    for pattern, kind in FILE_HINTS:
        n = F.nullif(F.regexp_extract(file, pattern, 1), F.lit("")).cast("int")
        out = out.when(n.isNotNull(), as_(kind, F.char(n + 64) if kind == "ap" else n))
    return out.otherwise(as_(None, none))


def chapter_key(heads: Column, n_chars: Column, file: Column) -> Column:
    """struct(kind, num) of an English document from its headings (array), its length and its file's name."""
    first = F.lower(T.stripped(F.coalesce(F.get(heads, 0), F.lit(""))))
    some = F.lower(F.array_join(F.slice(heads, 1, 3), " "))
    part, chap = F.regexp_extract(first, "^part\\s+(\\w+)", 1), F.regexp_extract(some, "chapter\\s+([0-9]+|[ivxlc]+|\\w+)", 1)
    word = F.array_position(F.array(*[F.lit(w) for w in NUMBER_WORDS]), chap).cast("int")
    number = lambda x: F.when(x.rlike("^[0-9]+$"), x.try_cast("int")).when(x.rlike("^[ivxlc]+$"), T.roman(x))
    part_no = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(w) for w in NUMBER_WORDS[:5]]), part).cast("int"), F.lit(0)), F.when(part.rlike("^[ivxlc]+$"), T.roman(part)), F.lit(0))
    chap_no = F.coalesce(number(chap), F.when(word > 0, word), F.lit(-1))
    as_ = lambda kind, num: F.struct(F.lit(kind).alias("kind"), F.lit(num).alias("num") if isinstance(num, int) else num.alias("num"))
    out = F.when(first.rlike("^notes?\\b"), as_("notes", 0)).when(first.rlike("^index\\b"), as_("index", 0)).when(first.rlike("^acknowledg"), as_("ack", 0))
    out = out.when(first.rlike("^contents\\b|^table of contents|^about the author|^copyright|^dedicat|^also by|^praise|^title page|^credits|^what.s next"), as_("skip", 0))
    out = out.when(first.rlike("^epilogue"), as_("epilogue", 0)).when(first.rlike("^prologue"), as_("prologue", 0))
    out = out.when(F.replace(file, F.lit("\\"), F.lit("/")).rlike("(?i)(?:^|[_/])(?:cover|half[-_]?title|title|copyright|dedication|toc|contents)\\.x?html?$"), as_("skip", 0))
    return out.when(part != "", as_("part", part_no)).when(chap_no > 0, as_("chapter", chap_no)).when(n_chars < 400, as_("skip", 0)).otherwise(as_("other", 0))


def units(docs: DataFrame) -> DataFrame:
    """Documents (book, spine, file, title) as units with keys: book, unit, kind, key, title, files.

    A document without kind continues the unit before; front and back matter are
    keyed by their place within their kind; of units with one key the first stays.
    """
    rows = docs.withColumn("_k", unit_kind(F.col("title"), F.col("file")))
    w = Window.partitionBy("book").orderBy("spine")
    rows = rows.withColumn("_unit", F.sum(F.col("_k.kind").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_unit > 0")
    out = rows.groupBy("book", "_unit").agg(F.min("spine").alias("spine"), F.first("_k", ignorenulls=True).alias("_k"), F.min_by("title", "spine").alias("title"), F.array_sort(F.collect_list(F.struct("spine", "file"))).alias("_files"), F.min_by("_k", "spine").alias("_first"))
    out = out.select("book", "spine", F.col("_first.kind").alias("kind"), F.col("_first.num").alias("num"), "title", F.transform("_files", lambda f: f["file"]).alias("files")).where("kind <> 'skip'")
    out = S.ordinal_keys(out, "book", "spine", "kind")
    out = out.withColumn("key", F.concat_ws(":", "kind", F.when(F.col("kind").isin("front", "back"), F.col("ordinal").cast("string")).otherwise(F.col("num")))).drop("ordinal")
    return matching.first_of(out, ["book", "key"], ["spine"])


def section_candidates(heads: DataFrame) -> DataFrame:
    """Headings (unit, label, pos, text) that may open sections: no label of the chapter, noise or repeat."""
    plain, label = T.normalised(F.col("text")), T.normalised(F.col("label"))
    bare = plain.rlike("^(?:chapter[0-9]*|第[0-9]+章|part[ivxlcdm0-9]*|第[一二三四五六七八九十]+部分|appendix[a-d]|附录[a-d]|[0-9]+)$")
    own = (plain == label) | ((F.length(plain) >= 2) & F.contains(label, plain)) | (F.contains(plain, label) & (F.length(label) >= 6) & (F.length(plain) <= F.length(label) + 6))
    s = T.stripped(F.col("text"))
    noise = s.rlike("^〔|^[0-9]+\\|") | s.rlike("(?i)^(?:人名索引|术语索引|符号|参考文献|索引|notes|index)$") | ((F.length(s) > 50) & s.rlike("[。，]")) | F.contains(s, F.lit("。"))
    kept = heads.where((plain != "") & ~bare & ~own & ~noise)
    return matching.first_of(kept, ["unit", "text"], ["pos"])


def sections_by_number(src: DataFrame, tgt: DataFrame, key: str, least: int = 3, share: float = 0.5) -> DataFrame:
    """Sections (key, idx, title) paired by number, then those right after a pair: key, src_idx, tgt_idx.

    A chapter whose numbers don't carry half of its smaller side gives no rows; a
    section without partner stays alone.
    """
    number = lambda df, i: df.select(key, F.col("idx").alias(i), T.section_number(F.col("title")).alias("no"))
    a, b = number(src, "src_idx"), number(tgt, "tgt_idx")
    hits = matching.kth_join(a.where("no <> ''"), b.where("no <> ''"), [key, "no"], "src_idx", "tgt_idx").where("src_idx is not null and tgt_idx is not null").select(key, "src_idx", "tgt_idx")
    size = a.groupBy(key).agg(F.count("*").alias("n")).join(b.groupBy(key).agg(F.count("*").alias("m")), key)
    good = size.join(hits.groupBy(key).agg(F.count("*").alias("n_hits")), key).where((F.col("n_hits") >= least) & (F.col("n_hits") >= share * F.least("n", "m"))).select(key)
    hits = hits.join(good, key)
    free_a = a.join(good, key).join(hits.select(key, "src_idx"), [key, "src_idx"], "left_anti").select(key, "src_idx")
    free_b = b.join(good, key).join(hits.select(key, "tgt_idx"), [key, "tgt_idx"], "left_anti").select(key, "tgt_idx")
    after = hits.select(key, (F.col("src_idx") + 1).alias("src_idx"), (F.col("tgt_idx") + 1).alias("tgt_idx"))
    more = after.join(free_a, [key, "src_idx"], "left_semi").join(free_b, [key, "tgt_idx"], "left_semi")
    pairs = hits.unionByName(more)
    alone_a = free_a.join(more, [key, "src_idx"], "left_anti").withColumn("tgt_idx", F.lit(None).cast("int"))
    alone_b = free_b.join(more, [key, "tgt_idx"], "left_anti").withColumn("src_idx", F.lit(None).cast("int"))
    return pairs.unionByName(alone_a).unionByName(alone_b)


def key_scores(found: DataFrame, src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Mapping (book, src, tgt) against units with the same key on both sides (book, idx, key): tp, fp, fn by book."""
    gold = src.select("book", F.col("idx").alias("src"), "key").join(tgt.select("book", F.col("idx").alias("tgt"), "key"), ["book", "key"]).select("book", "src", "tgt")
    from duolith.operators.audit import link_scores

    return link_scores(found, gold, ["book"])


def peel_runs(own: DataFrame, other: DataFrame, visuals: DataFrame, key: str, flag: Column, *, reach: int = 1, least: int = 2) -> DataFrame:
    """Runs of flagged paragraphs that have no counterpart but stand beside visuals: key, first, last, n.

    own and other: key, idx, text; visuals: key, after. A run's place on the other
    side is the number of unflagged rows before it; it stays if the row there is
    flagged too.
    """
    ranked = S.rank_before(own, [key], "idx", flag)
    runs = S.islands(own, [key], "idx", flag).where(F.col("n") >= least)
    runs = runs.join(ranked.select(key, F.col("idx").alias("first"), "rank_before"), [key, "first"])
    there = other.select(key, F.col("idx").alias("rank_before"), flag.alias("_same"))
    runs = runs.join(there, [key, "rank_before"], "left").where(~F.coalesce("_same", F.lit(False)))
    near = runs.join(visuals.where("after >= 0"), key).where(F.abs(F.col("after") - F.col("rank_before")) <= reach)
    enough = near.groupBy(key, "first", "last", "n").agg(F.count("*").alias("_v")).where(F.col("_v") >= F.when(F.lit(reach > 1), F.lit(1)).otherwise(F.col("n")))
    return enough.select(key, "first", "last", "n")


def attach_figures(figures: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Each figure claims a target: by equation number, then caption number, then the nearest within 8, then the next free.

    figures and targets: key, idx, eq, cap, pos (eq and cap '' where there is none).
    A target is claimed once, in the figures' order: key, fig, target. Wishes are
    looked up one by one, as most figures get their first.
    """
    kind = dict(figures.dtypes)[key]

    def run(name, a: list[tuple], b: list[tuple]) -> Iterator[tuple]:
        places = sorted((pos, idx) for idx, _, _, pos in b)
        by_number: dict[tuple[str, str], list] = defaultdict(list)
        for idx, eq, cap, pos in b:
            by_number["eq", eq].append((pos, idx))
            by_number["cap", cap].append((pos, idx))

        def wishes(eq: str, cap: str, at: int) -> Iterator[int]:
            for what, no in (("eq", eq), ("cap", cap)):
                if no:
                    yield from (i for _, i in sorted((abs(pos - at), i) for pos, i in by_number.get((what, no), ())))
            near = places[bisect_left(places, (at - 8,)) : bisect_left(places, (at + 9,))]
            yield from (i for _, i in sorted((abs(pos - at), i) for pos, i in near))
            yield from (r[0] for r in b)

        for (fig, *_), got in zip(a, K.claim(wishes(eq, cap, pos) for _, eq, cap, pos in a), strict=True):
            yield name, fig, got

    return by_both(figures, targets, key, ["idx"], ["idx", "eq", "cap", "pos"], run, f"{key} {kind}, fig bigint, target bigint")


def leading_titles(pairs: DataFrame, heads: DataFrame, key: str) -> DataFrame:
    """Target paragraphs that open a group of several, look like titles and have a source heading within one place.

    pairs: key, pair_idx, src, tgt, first_text (of the target's first paragraph); heads: key, at.
    """
    s = T.stripped(F.col("first_text"))
    like = (F.length(s) > 0) & (F.length(s) <= 12) & T.looks_like_title(s)
    rows = pairs.where((F.size("tgt") >= 2) & (F.size("src") >= 1) & like).withColumn("_at", F.get("src", 0))
    return rows.join(heads, key).where(F.abs(F.col("at") - F.col("_at")) <= 1).select(key, "pair_idx", F.get("tgt", 0).alias("tgt"), "first_text").distinct()


def structural_conflicts(pairs: DataFrame) -> DataFrame:
    """Pairs whose source is short and target long, or whose numbers have nothing in common."""
    numbers = lambda c: F.regexp_extract_all(c, F.lit("[0-9]+\\.[0-9]+"), F.lit(0))
    a, b, han = numbers("src_text"), numbers("tgt_text"), T.han_chars(F.col("tgt_text"))
    short = (F.size(F.filter(F.split("src_text", "\\s+"), lambda x: x != "")) <= 6) & (han >= 25)
    apart = (F.size(a) > 0) & (han >= 20) & ~F.arrays_overlap(a, b)
    return pairs.withColumn("conflict", F.when(short, "short source, long target").when(F.coalesce(apart, F.lit(False)), "numbers apart")).where("conflict is not null")


def unstable_pairs(base: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Links that only one of two alignments has."""
    a, b = (x.select(key, "src", "tgt") for x in (base, other))
    return a.exceptAll(b).unionByName(b.exceptAll(a)).distinct()


#: Places of the histograms of letters that rule pairs of texts out.
LETTER_BINS = 64


def fuzzy_duplicates(texts: DataFrame, key: str, *, threshold: float = 0.75, least_chars: int = 20) -> DataFrame:
    """For each text (key, idx, text) its best like of another place in the group: key, idx, other, ratio.

    The ratio is that of longest common blocks. Common blocks are common letters, so
    lengths and then histograms of letters bound it from above; what is left is
    bounded by the longest common subsequence, and compared in full last. A group's
    texts stream through one task in order of length, and each meets only those
    whose length allows a like; nothing is left out.
    """
    kinds = dict(texts.dtypes)
    rows = texts.select(key, "idx", "text", F.length("text").alias("_n")).where(F.col("_n") >= least_chars)

    def run(name, found: list[tuple]) -> Iterator[tuple]:
        ids, told, sizes = [r[0] for r in found], [r[1] for r in found], np.array([r[2] for r in found])
        bins = np.zeros((len(found), LETTER_BINS), dtype=np.int32)
        for i, t in enumerate(told):
            bins[i] = np.bincount(np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32) % LETTER_BINS, minlength=LETTER_BINS)
        best: list[tuple[float, int] | None] = [None] * len(found)
        keep = lambda i, j, ratio: best[i] is None or (-ratio, ids[j]) < (-best[i][0], ids[best[i][1]])
        for i in range(len(found)):
            # 2 * common >= threshold * (n + m), and common <= the shorter's length
            last = int(np.searchsorted(sizes, sizes[i] * (2 / threshold - 1) + 1e-9, side="right"))
            common = np.minimum(bins[i], bins[i + 1 : last]).sum(1)
            for j in (np.flatnonzero(2 * common >= threshold * (sizes[i] + sizes[i + 1 : last])) + i + 1).tolist():
                a, b = (i, j) if ids[i] < ids[j] else (j, i)
                ratio = 1.0 if told[i] == told[j] else K.ratcliff_from(told[a], told[b], threshold)
                if ratio is not None:
                    for x, y in ((i, j), (j, i)):
                        if keep(x, y, ratio):
                            best[x] = ratio, y
        for i, got in enumerate(best):
            if got:
                yield name, ids[i], ids[got[1]], got[0]

    return by_group(rows, key, ["_n", "idx"], ["idx", "text", "_n"], run, f"{key} {kinds[key]}, idx {kinds['idx']}, other {kinds['idx']}, ratio double")


def one_sided_kind(t: Column) -> Column:
    """What a one-sided text is: empty, caption, footnote, metadata, lead-in, formula or prose."""
    s = T.stripped(t)
    ends = s.rlike("[。！？；，、.!?;:,]")
    return (
        F.when(s == "", "empty").when(T.is_caption(s), "caption").when(T.is_footnote(s), "footnote").when((F.length(s) <= 24) & ~ends, "metadata")
        .when((F.length(s) <= 40) & ~ends, "lead-in").when(s.rlike("\\$|\\\\[a-zA-Z]{2,}") & (F.length(s) <= 80), "formula").otherwise("prose")
    )


def preceding_text(events: DataFrame, key: str, order: str, number: str, text: str) -> DataFrame:
    """Q8, Q9: for each numbered event the text last seen before it (first event of a number)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(F.col(number).isNull(), F.col(text)), ignorenulls=True).over(w)
    rows = events.withColumn("preceding", F.coalesce(seen, F.lit(""))).where(F.col(number).isNotNull())
    return matching.first_of(rows, [key, number], [order]).select(key, number, "preceding")


def placement(a: DataFrame, b: DataFrame, key: str, number: str, chars: int = 16) -> DataFrame:
    """Q8: numbers of two event streams by whether the text before them begins alike: same, moved, only_first, only_second."""
    both = a.withColumnRenamed("preceding", "_a").join(b.withColumnRenamed("preceding", "_b"), [key, number], "full_outer")
    same = F.left("_a", F.lit(chars)) == F.left("_b", F.lit(chars))
    return both.select(key, number, F.when(F.col("_b").isNull(), "only_first").when(F.col("_a").isNull(), "only_second").when(same, "same").otherwise("moved").alias("placement"))


def lines_between(lines: DataFrame, anchors: DataFrame, key: str, most: int = 46) -> DataFrame:
    """Q12: short lines that may be headings between an anchor and the next: key, anchor, pos, text.

    lines: key, pos, text; anchors: key, pos, anchor. A line belongs to the last
    anchor before it; one at an anchor's own place belongs to none.
    """
    marks = anchors.groupBy(key, "pos").agg(F.max("anchor").alias("anchor"))
    rows = matching.asof_backward(lines, marks, [key], "pos", "anchor").join(marks.select(key, "pos"), [key, "pos"], "left_anti")
    s = T.stripped(F.col("text"))
    short = (F.length(s) > 0) & (F.length(s) <= most) & ~s.rlike("^(#|\\$\\$|\\||>|---)") & ~s.rlike("[$\\\\]") & ~s.rlike("[。，；：、.,;:!?！？]$")
    return rows.where(F.col("anchor").isNotNull() & short).select(key, "anchor", "pos", "text")


def hint_hits(texts: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Q13: how many of a text's hints (words of four letters, numbers) the other side has: key, idx, n_hints, n_found."""
    from duolith.sources.readers import word_hints

    hints = texts.select(key, "idx", F.explode(F.transform(word_hints(F.col("text")), F.lower)).alias("h")).distinct()
    there = other.select(key, F.explode(F.transform(word_hints(F.col("text")), F.lower)).alias("h")).distinct().withColumn("_f", F.lit(1))
    return hints.join(there, [key, "h"], "left").groupBy(key, "idx").agg(F.count("*").alias("n_hints"), F.count("_f").alias("n_found"))


def chapter_stats(blocks: DataFrame, key: str) -> DataFrame:
    """Per chapter: headings, paragraphs, visuals, note marks, mean likeness of the last ten paragraphs to notes."""
    w = Window.partitionBy(key).orderBy(F.desc("pos"))
    rows = blocks.withColumn("_last", F.row_number().over(w) <= 10)
    return rows.groupBy(key).agg(
        F.count_if(F.col("type") == "heading").alias("headings"), F.count_if(F.col("type").isin("para", "quote", "li")).alias("paras"),
        F.count_if(F.col("type").isin("figure", "image", "table", "formula")).alias("visuals"), F.sum(F.regexp_count("text", F.lit("\\[[0-9]{1,3}\\]"))).alias("note_marks"),
        F.avg(F.when(F.col("_last"), T.note_likeness(F.col("text")))).alias("note_likeness"),
    )
