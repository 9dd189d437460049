"""Audits, gates and verdicts over aligned pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duolith.functions import text as T
from duolith.operators import sequences as S
from duolith.operators.groups import by_group
from duolith.operators.matching import cells_join


def paired_texts(links: DataFrame, src: DataFrame, tgt: DataFrame, key: str) -> DataFrame:
    """Links with the joined texts and lengths of both sides (G18): key, pair_idx, src, tgt, src_text, tgt_text, r, c.

    Links are read once: every place finds its paragraph, then a link's paragraphs
    come together. Links that have no paragraph on either side are left out.
    """
    numbered = lambda c, n: F.transform(c, lambda x, i: F.struct(F.lit(n).alias("_side"), i.alias("_n"), x.alias("idx")))
    places = F.concat(numbered("src", 0), numbered("tgt", 1))
    paras = src.select(key, F.lit(0).alias("_side"), "idx", "text").unionByName(tgt.select(key, F.lit(1).alias("_side"), "idx", "text"))
    rows = links.select(key, "pair_idx", F.explode(places).alias("_l")).select(key, "pair_idx", "_l.*").join(paras, [key, "_side", "idx"])
    rows = rows.groupBy(key, "pair_idx").agg(F.array_sort(F.collect_list(F.struct("_side", "_n", "idx", "text"))).alias("_p"))
    part = lambda n: F.filter("_p", lambda p: p["_side"] == n)
    rows = rows.select(key, "pair_idx", part(0).alias("_s"), part(1).alias("_t"))
    text = lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda p: p["text"]), " "))
    mass = lambda c: F.aggregate(c, F.lit(0), lambda n, p: n + T.en_words(p["text"]))
    both = (F.size("_s") > 0) & (F.size("_t") > 0)
    return rows.select(
        key, "pair_idx", F.transform("_s", lambda p: p["idx"]).alias("src"), F.transform("_t", lambda p: p["idx"]).alias("tgt"), text("_s").alias("src_text"), text("_t").alias("tgt_text"),
        F.when(both, mass("_t") / F.greatest(F.lit(1), mass("_s"))).otherwise(0.0).alias("r"), F.when(both, 0.9).otherwise(0.4).alias("c"),
    )


def sided(pairs: DataFrame) -> DataFrame:
    s, t = F.size("src"), F.size("tgt")
    return pairs.withColumns({"only_src": (s > 0) & (t == 0), "only_tgt": (t > 0) & (s == 0), "both": (s > 0) & (t > 0), "multi": (s > 0) & (t > 0) & ((s > 1) | (t > 1))})


def _count(flag: Column, name: str) -> Column:
    return F.count(F.when(flag, 1)).alias(name)


def audit_fixed(pairs: DataFrame, key: Sequence[str], low: float = 1.0, high: float = 3.0, fail_rate: float = 0.20) -> DataFrame:
    """The frozen ruler for decisions: absolute range of r, every gap is bad."""
    rows = sided(pairs).withColumn("_ratio", F.col("both") & ~F.col("r").between(low, high))
    out = rows.groupBy(*key).agg(F.count("*").alias("total"), _count(F.col("only_src"), "only_src"), _count(F.col("only_tgt"), "only_tgt"), _count(F.col("multi"), "multi"), _count(F.col("_ratio"), "ratio_bad"))
    out = out.withColumn("bad", F.col("only_src") + F.col("only_tgt") + F.col("ratio_bad"))
    return out.withColumn("verdict", F.when(F.col("bad") / F.col("total") > fail_rate, "FAIL").otherwise("PASS"))


def audit_calibrated(pairs: DataFrame, key: Sequence[str], low: float = 1.0, high: float = 3.0, fail_rate: float = 0.20) -> DataFrame:
    """G1: the ruler for reports, in two passes.

    The range of r follows the upper median of the section's pairs that aren't
    formulas, where there are five; formulas have no ratio; notes and scraps without
    counterpart are differences of structure, not errors. pairs needs src_text and
    tgt_text.
    """
    rows = sided(pairs)
    formula = T.formulaish(F.col("src_text")) | T.formulaish(F.col("tgt_text"))
    kind = T.struct_kind(F.when(F.col("only_src"), F.col("src_text")).otherwise(F.col("tgt_text")))
    rows = rows.withColumns({"_formula": formula, "_kind": kind})
    plain = rows.where("both and not _formula").groupBy(*key).agg(F.sort_array(F.collect_list("r")).alias("_rs"))
    plain = plain.select(*key, F.size("_rs").alias("_n"), F.element_at("_rs", (F.floor(F.size("_rs") / 2) + 1).cast("int")).alias("r_med"))
    rows = rows.join(plain, list(key), "left")
    own = F.coalesce(F.col("_n"), F.lit(0)) >= 5
    lo = F.when(own, F.greatest(F.lit(0.30), 0.45 * F.col("r_med"))).otherwise(low)
    hi = F.when(own, F.least(F.lit(high), 1.8 * F.col("r_med"))).otherwise(high)
    gap = F.col("only_src") | F.col("only_tgt")
    rows = rows.withColumns({"_ratio": F.col("both") & ~F.col("_formula") & ~F.col("r").between(lo, hi), "_cover": gap & (F.col("_kind") == ""), "_struct": gap & (F.col("_kind") != "")})
    out = rows.groupBy(*key).agg(
        F.count("*").alias("total"), _count(F.col("only_src"), "only_src"), _count(F.col("only_tgt"), "only_tgt"), _count(F.col("multi"), "multi"),
        _count(F.col("_ratio"), "ratio_bad"), _count(F.col("_cover"), "cover_bad"), _count(F.col("_struct"), "struct_diff"),
        F.max(F.when(own, F.col("r_med")).otherwise(0.0)).alias("r_med"),
    )
    out = out.withColumn("bad", F.col("ratio_bad") + F.col("cover_bad"))
    return out.withColumns({"rate": F.col("bad") / F.col("total"), "verdict": F.when(F.col("bad") / F.col("total") > fail_rate, "FAIL").otherwise("PASS")})


def coverage(pairs: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct places that are used on each side."""
    used = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    return pairs.groupBy(*key).agg(used("src").alias("src_matched"), used("tgt").alias("tgt_matched"))


def rollup(pairs: DataFrame, chapter: str, section: str) -> DataFrame:
    """Counts by section, chapter and all."""
    rows = sided(pairs)
    return rows.rollup(chapter, section).agg(F.count("*").alias("pairs"), _count(F.col("both"), "matched"), _count(F.col("only_src"), "missing"), _count(F.col("only_tgt"), "surplus"))


def link_scores(found: DataFrame, gold: DataFrame, key: Sequence[str]) -> DataFrame:
    """True, false and missed links (key, src, tgt) of each key with precision, recall and F1."""
    a = found.select(*key, "src", "tgt").distinct().withColumn("_found", F.lit(True))
    b = gold.select(*key, "src", "tgt").distinct().withColumn("_gold", F.lit(True))
    both = a.join(b, [*key, "src", "tgt"], "full_outer")
    out = both.groupBy(*key).agg(_count(F.col("_found") & F.col("_gold"), "tp"), _count(F.col("_found") & F.col("_gold").isNull(), "fp"), _count(F.col("_gold") & F.col("_found").isNull(), "fn"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    out = out.withColumns({"p": p, "rec": r})
    return out.withColumn("f1", F.when(F.col("p") + F.col("rec") > 0, 2 * F.col("p") * F.col("rec") / (F.col("p") + F.col("rec"))).otherwise(0.0))


def exploded_links(links: DataFrame, key: str) -> DataFrame:
    return links.select(key, F.explode("src").alias("src"), "tgt").select(key, "src", F.explode("tgt").alias("tgt"))


def anchor_agreement(pairs: DataFrame) -> DataFrame:
    """Of pairs with anchors on both sides (arrays src_anchors, tgt_anchors), how many agree wholly, in part, not at all."""
    a, b = F.array_sort("src_anchors"), F.array_sort("tgt_anchors")
    rows = pairs.where((F.size(a) > 0) & (F.size(b) > 0))
    exact, some = a == b, F.arrays_overlap(a, b)
    return rows.agg(F.count("*").alias("comparable"), _count(exact, "exact"), _count(~exact & some, "partial"), _count(~some, "disjoint"))


def inversions(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Pairs of a group that stand in the wrong order, counted by merging in n log n: key, inversions."""
    kind = dict(rows.dtypes)[key]

    def count(xs: list) -> int:
        n, width = 0, 1
        while width < len(xs):
            out = []
            for i in range(0, len(xs), 2 * width):
                a, b, x = xs[i : i + width], xs[i + width : i + 2 * width], 0
                for y in b:
                    while x < len(a) and a[x] <= y:
                        out.append(a[x])
                        x += 1
                    out.append(y)
                    n += len(a) - x
                out += a[x:]
            xs, width = out, 2 * width
        return n

    return by_group(rows, key, [order], [value], lambda name, found: iter([(name, count([v for (v,) in found]))]), f"{key} {kind}, inversions bigint")


def one_sided_verdicts(texts: DataFrame, pool: DataFrame, key: str, text: str, share: float = 0.30) -> DataFrame:
    """Whether one-sided texts are really alone, by their signals in the other side's pool (key, signal).

    Verdicts: unsure (no signal, or few found), unique (none found), misplaced (share found or more).
    """
    rows = texts.withColumn("_signals", T.content_signals(F.col(text)))
    ids = [c for c in texts.columns if c != text]
    flat = rows.select(*ids, F.explode_outer("_signals").alias("signal"))
    hits = flat.join(pool.select(key, "signal").distinct().withColumn("_hit", F.lit(1)), [key, "signal"], "left")
    out = hits.groupBy(*ids).agg(F.count("signal").alias("n_signals"), F.count("_hit").alias("n_hits"))
    verdict = F.when(F.col("n_signals") == 0, "unsure").when(F.col("n_hits") == 0, "unique").when(F.col("n_hits") / F.col("n_signals") >= share, "misplaced").otherwise("unsure")
    return out.withColumn("verdict", verdict)


def signal_pool(paras: DataFrame, key: str, text: str = "text") -> DataFrame:
    """the distinct signals of each key."""
    return paras.select(key, F.explode(T.content_signals(F.col(text))).alias("signal")).distinct()


def screened(sections: DataFrame) -> DataFrame:
    """Verdict of each section, by ordered rules on its counts.

    sections: n_src, n_tgt, only_src, only_tgt (real ones), footnotes, multi, pairs,
    run_src, run_tgt, misplaced, title, chapter_title, key, chapter_has_src.
    """
    diff = F.col("n_src") - F.col("n_tgt")
    real = F.col("only_src") + F.col("only_tgt")
    many = F.col("multi") / F.greatest(F.lit(1), F.col("pairs")) > 0.25
    blocks = (F.col("n_src") > 0) & (F.abs(diff) / F.greatest(F.lit(1), F.col("n_src")) > 0.08) & ((real > 0) | (F.col("multi") > 0))
    why = F.concat_ws("+", F.when(blocks, "blocks"), F.when(F.col("only_src") > 0, "only_src"), F.when(F.col("only_tgt") > 0, "only_tgt"), F.when(many, "multi"))
    unexplained = diff != F.col("only_src") - F.col("only_tgt")
    lone = (F.col("only_src") <= 1) & (F.col("only_tgt") <= 1) & (F.col("run_src") <= 1) & (F.col("run_tgt") <= 1) & ~many & ~unexplained & (F.col("misplaced") == 0)
    verdict = (
        F.when(~F.col("chapter_has_src"), "exempt: no source chapter")
        .when(T.is_untranslated_section(F.col("title"), F.col("chapter_title"), F.col("key")), "exempt: bibliography or index")
        .when((why != "") & lone, "exempt: isolated")
        .when((real > 0) & (F.col("footnotes") == real), "exempt: footnotes")
        .when(why == "", "exempt: unique")
        .otherwise("candidate")
    )
    return sections.withColumns({"why": why, "verdict": verdict})


def admitted(audits: DataFrame, gate: float = 0.15) -> DataFrame:
    """D3: whether an alignment is taken as it is or needs an annotation."""
    return audits.withColumn("route", F.when(F.col("rate") <= gate, "accepted").otherwise("needs_annotation"))


def best_candidate(candidates: DataFrame, key: Sequence[str]) -> DataFrame:
    """Of candidates (key, name, bad, rank) the one with fewest bad pairs; ties go to the lower rank."""
    return candidates.groupBy(*key).agg(F.min_by("name", F.struct("bad", "rank")).alias("winner"), F.min("bad").alias("bad"))


def accept_annotation(rows: DataFrame, slack: int = 2) -> DataFrame:
    """An annotated mapping replaces the old one if it covers both sides, isn't more skewed, and isn't much worse."""
    ok = (F.col("src_coverage") >= 0.8) & (F.col("tgt_coverage") >= 0.7) & (F.col("new_skew") <= F.col("old_skew")) & (F.col("new_bad") <= F.col("old_bad") + slack)
    return rows.withColumn("accepted", ok)


def annotate(pairs: DataFrame, notes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Labels (skew, missing, offset) from an annotation table; pairs without one keep nulls."""
    return pairs.join(notes, list(key), "left")


def leak_counts(docs: DataFrame, text: str, rules: dict[str, str]) -> DataFrame:
    """Matches of each rule in each document, as rows: doc_id, rule, n."""
    counts = F.array(*[F.struct(F.lit(name).alias("rule"), F.regexp_count(text, F.lit(p)).alias("n")) for name, p in rules.items()])
    return docs.select("doc_id", F.explode(counts).alias("r")).select("doc_id", "r.*").where("n > 0")


def wide_groups(pairs: DataFrame) -> DataFrame:
    """Groups of three or more against two or more, without a stub under 40 characters."""
    a, b = F.size("src"), F.size("tgt")
    return pairs.where((F.greatest(a, b) >= 3) & (F.least(a, b) >= 2) & (F.least(F.length("src_text"), F.length("tgt_text")) >= 40))


def side_order(children: DataFrame) -> DataFrame:
    """Which side each pair shows first (pair children: key, pos, side): target, source, source only or none."""
    first = F.min_by("side", "pos")
    out = children.groupBy("key").agg(first.alias("first"), F.count_distinct("side").alias("sides"))
    return out.withColumn("order", F.when(F.col("first") == "tgt", "tgt_first").when((F.col("first") == "src") & (F.col("sides") == 2), "src_first").when(F.col("first") == "src", "src_only").otherwise("none"))


def sequences_equal(a: DataFrame, b: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Keys whose ordered values differ between two tables, with the first place that differs."""
    number = lambda df, c: df.select(key, F.col(value).alias(c), F.row_number().over(Window.partitionBy(key).orderBy(order)).alias("_n"))
    both = number(a, "_a").join(number(b, "_b"), [key, "_n"], "full_outer")
    return both.where("not (_a <=> _b)").groupBy(key).agg(F.min("_n").alias("first_difference"), F.count("*").alias("n_differences"))


def neighbour_drift(a: DataFrame, b: DataFrame, key: str, width: int = 2) -> DataFrame:
    """Signals (key, i, signal) that the pair's other side lacks but a neighbour within width has.

    Returns key, i, own (found in place), moved (found beside), lost.
    """
    y = b.select(key, F.col("i").alias("j"), "signal").distinct()
    x = a.select(key, "i", "signal").distinct()
    near = x.join(y.withColumn("_cell", F.explode(F.array(*[F.floor(F.col("j") / (width + 1)) + d for d in (-1, 0, 1)]))), [key, "signal"]).where(F.floor(F.col("i") / (width + 1)) == F.col("_cell"))
    near = near.where(F.abs(F.col("i") - F.col("j")) <= width)
    best = near.groupBy(key, "i", "signal").agg(F.min(F.abs(F.col("i") - F.col("j"))).alias("_d"))
    rows = x.join(best, [key, "i", "signal"], "left")
    return rows.groupBy(key, "i").agg(_count(F.col("_d") == 0, "own"), _count(F.col("_d") > 0, "moved"), _count(F.col("_d").isNull(), "lost"))


def strength_tiers(sections: DataFrame) -> DataFrame:
    """Q2: A (blocks differ by over 8 %, or a run of two), B (one-sided, few groups), C (groups only), D."""
    differ = F.abs(F.col("n_src") - F.col("n_tgt")) / F.greatest(F.lit(1), F.col("n_src")) > 0.08
    single = F.col("only_src") + F.col("only_tgt") > 0
    many = F.col("multi") / F.greatest(F.lit(1), F.col("total")) > 0.25
    return sections.withColumn("tier", F.when(differ | (F.col("longest") >= 2), "A").when(single & ~many, "B").when(~single & (F.col("multi") > 0), "C").otherwise("D"))


def gate_funnel(audits: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Q1: sections, those too small to judge, those that the gate stops, those that pass."""
    small = F.col("total") < 5
    fired = ~small & (F.col("bad") > threshold * F.col("total"))
    return audits.agg(F.count("*").alias("sections"), _count(small, "small"), _count(fired, "fired"), _count(~small & ~fired, "passed"))


def footnote_share(pairs: DataFrame, key: Sequence[str]) -> DataFrame:
    """Q3: of a section's one-sided pairs, whether all, some or none are footnotes."""
    rows = sided(pairs).withColumn("_single", F.col("only_src") | F.col("only_tgt"))
    foot = F.col("_single") & T.is_footnote(F.coalesce("src_text", "tgt_text"))
    out = rows.groupBy(*key).agg(_count(F.col("_single"), "one_sided"), _count(foot, "footnotes"))
    share = F.when(F.col("one_sided") == 0, "no one-sided").when(F.col("footnotes") == F.col("one_sided"), "all").when(F.col("footnotes") > 0, "part").otherwise("none")
    return out.withColumn("share", share)


def beside_visuals(singles: DataFrame, visuals: DataFrame, key: str, slack: int = 1) -> DataFrame:
    """Q4: whether a visual stands within slack of a one-sided pair: same, after, before or none."""
    near = cells_join(singles.select(key, "at"), visuals.select(key, F.col("after").alias("_v")), [key], "at", "_v", slack)
    best = near.groupBy(key, "at").agg(F.min(F.struct(F.abs(F.col("_v") - F.col("at")).alias("d"), (F.col("at") - F.col("_v")).alias("s"))).alias("_b"))
    out = singles.select(key, "at").distinct().join(best, [key, "at"], "left")
    return out.select(key, "at", F.when(F.col("_b").isNull(), "none").when(F.col("_b.s") == 0, "same").when(F.col("_b.s") < 0, "after").otherwise("before").alias("visual"))


def run_kinds(pairs: DataFrame, key: Sequence[str], least: int = 3) -> DataFrame:
    """Q5: members of one-sided runs of three or more by kind: empty, footnote, short, prose."""
    rows = sided(pairs)
    runs = S.islands(rows, key, "pair_idx", F.col("only_src") | F.col("only_tgt")).where(F.col("n") >= least)
    members = rows.join(runs, list(key)).where(F.col("pair_idx").between(F.col("first"), F.col("last")))
    t = T.stripped(F.coalesce("src_text", "tgt_text"))
    kind = F.when(t == "", "empty").when(T.is_footnote(t), "footnote").when(F.length(t) <= 30, "short").otherwise("prose")
    return members.groupBy(*key, kind.alias("kind")).agg(F.count("*").alias("n"))


def skew_shapes(pairs: DataFrame, flag: Column) -> DataFrame:
    """Q7: shapes of flagged pairs."""
    rows = pairs.where(flag)
    return rows.agg(_count(F.size("tgt") >= 2, "multi_tgt"), _count(F.size("tgt") == 1, "single_tgt"), _count(F.size("src") >= 2, "multi_src"))


def reconciliation(claims: DataFrame, src: DataFrame, tgt: DataFrame, key: str) -> DataFrame:
    """Q16: per key: sources nobody claims, targets nobody claims, sources claimed twice, claims of what isn't there.

    claims: key, src, tgt; src and tgt: key, idx.
    """
    s, t = src.select(key, F.col("idx").alias("src")), tgt.select(key, F.col("idx").alias("tgt"))
    count = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    parts = [
        count(s.join(claims, [key, "src"], "left_anti"), "src_unclaimed"),
        count(t.join(claims, [key, "tgt"], "left_anti"), "tgt_unclaimed"),
        count(claims.groupBy(key, "src").agg(F.count_distinct("tgt").alias("n")).where("n > 1"), "src_claimed_twice"),
        count(claims.groupBy(key, "tgt").agg(F.count_distinct("src").alias("n")).where("n > 1"), "tgt_claimed_twice"),
        count(claims.join(t, [key, "tgt"], "left_anti"), "dangling"),
    ]
    out = src.select(key).union(tgt.select(key)).distinct()
    for p in parts:
        out = out.join(p, key, "left")
    return out.fillna(0)


def cross_links(links: DataFrame, src_sec: DataFrame, tgt_sec: DataFrame, key: str) -> DataFrame:
    """Q14: links whose sides lie in different sections, of all."""
    rows = links.join(src_sec.select(key, F.col("idx").alias("src"), F.col("sec").alias("a")), [key, "src"]).join(tgt_sec.select(key, F.col("idx").alias("tgt"), F.col("sec").alias("b")), [key, "tgt"])
    return rows.groupBy(key).agg(F.count("*").alias("links"), _count(F.col("a") != F.col("b"), "crossing"))
