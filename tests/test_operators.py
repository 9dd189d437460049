"""Sequences, audits, matching and usage on small tables with known results."""

import datetime
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from duolith.functions import kernels
from duolith.functions import text as T
from duolith.operators import alignment, audit, matching, usage
from duolith.operators import sequences as S


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def blocks(spark, told):
    return spark.createDataFrame([(1, i, *b) for i, b in enumerate(told)], "doc_id int, pos int, type string, level int, text string, caption string")


def test_sections(spark):
    b = blocks(spark, [("heading", 1, "Title", ""), ("para", 0, "intro", ""), ("heading", 2, "A", ""), ("para", 0, "x", ""), ("figure", 0, "f", ""), ("heading", 3, "A.1", ""), ("heading", 2, "B", ""), ("figure", 0, "g", ""), ("para", 0, "y", "")])
    flat = rows(S.split_sections(b), "pos", "sec", "section_title", "para_idx", "after")
    assert flat[1] == (1, 0, "", 0, None) and flat[3] == (3, 1, "A", 0, None) and flat[4] == (4, 1, "A", None, 0) and flat[7] == (7, 2, "B", None, -1) and flat[8] == (8, 2, "B", 0, None)
    assert max(r[1] for r in rows(S.split_sections(b, deep=True), "pos", "sec")) == 3
    assert S.conservation(b, S.split_sections(b)).count() == 0
    assert S.conservation(b, S.split_sections(b).where("pos <> 3")).count() == 1


def test_captions_and_head_noise(spark):
    b = blocks(spark, [("heading", 1, "Title", ""), ("para", 0, "12", ""), ("para", 0, "Title", ""), ("quote", 0, "Words.", ""), ("quote", 0, "Laplace, 1819", ""), ("para", 0, "Figure 3.2", ""), ("figure", 0, "", "")])
    filled = {r.pos: r for r in S.fill_captions(b).collect()}
    assert filled[6].caption == "Figure 3.2" and filled[5].cap_consumed
    folded = S.fold_head_noise(b.drop("caption").withColumn("caption", F.lit(""))).orderBy("pos").collect()
    assert [r.text for r in folded] == ["Title", "Words. Laplace, 1819", "Figure 3.2", ""]


def test_first_block_becomes_a_heading(spark):
    assert [r.type for r in S.promote_first(blocks(spark, [("para", 0, "Preface", ""), ("para", 0, "Text.", "")])).orderBy("pos").collect()] == ["heading", "para"]
    assert [r.type for r in S.promote_first(blocks(spark, [("para", 0, "A sentence.", ""), ("para", 0, "Text.", "")])).collect()] == ["para", "para"]


def test_unnumbered_headings_go_down(spark):
    b = blocks(spark, [("heading", 2, "1. A", ""), ("heading", 2, "2. B", ""), ("heading", 2, "Aside", ""), ("heading", 1, "T", "")])
    assert {r.text: r.level for r in S.demote_unnumbered(b).collect()} == {"1. A": 2, "2. B": 2, "Aside": 3, "T": 1}


def test_note_boundary(spark):
    p = [(i, t) for i, t in enumerate(["正文", "正文", "Smith (1990) Press, p. 1", "正文一", "Jones (1991) Press, p. 2", "www.x.org/y z"])]
    df = spark.createDataFrame([(1, *x) for x in p], "doc int, i int, t string")
    assert rows(S.note_boundary(df, ["doc"], "i", "t"), "n", "boundary") == [(6, 2)]
    assert rows(S.note_boundary(df.where("i < 2"), ["doc"], "i", "t"), "n", "boundary") == [(2, 2)]


def test_context_takes_the_nearest_on_each_side(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a", None, "b", "c", None, "d"])], "k int, i int, t string")
    got = {r.i: (r.before, r.after_texts) for r in S.context(df, ["k"], "i", "t", F.col("t").isNotNull()).collect()}
    assert got[3] == (["b", "a"], ["d"]) and got[0] == ([], ["b", "c"])


def test_fragments_merge_in_pairs(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(["ab-", "+c-", "+d-", "+e", "f"])], "doc_id int, idx int, text string")
    assert rows(S.merge_broken(df, F.col("text").endswith("-"), F.col("text").startswith("+")), "idx", "text", "n") == [(0, "ab- +c-", 2), (2, "+d- +e", 2), (4, "f", 1)]


def pairs(spark, told):
    return spark.createDataFrame([(1, i, *p) for i, p in enumerate(told)], "k int, pair_idx int, src array<int>, tgt array<int>, r double, src_text string, tgt_text string")


TEXT = "some running text here"


def test_audits(spark):
    p = pairs(spark, [([i], [i], 1.0, TEXT, TEXT) for i in range(5)] + [([5], [5], 2.0, TEXT, TEXT), ([6], [], 0.0, TEXT, None), ([], [6], 0.0, None, "[1] note text"), ([7, 8], [7], 1.2, TEXT, TEXT), ([9], [8], 9.0, TEXT, "x \\frac{a}{b} \\sum_{i}")])
    fixed = audit.audit_fixed(p, ["k"]).first()
    assert (fixed.total, fixed.only_src, fixed.only_tgt, fixed.multi, fixed.ratio_bad, fixed.bad, fixed.verdict) == (10, 1, 1, 1, 1, 3, "FAIL")
    a = audit.audit_calibrated(p, ["k"]).first()
    assert (a.ratio_bad, a.cover_bad, a.struct_diff, a.bad, a.r_med, a.verdict) == (1, 1, 1, 2, 1.0, "PASS")
    c = audit.coverage(p, ["k"]).first()
    assert (c.src_matched, c.tgt_matched) == (10, 9)


def test_verdicts(spark):
    pool = spark.createDataFrame([(1, "w:bayes"), (1, "w:theorem")], "k int, signal string")
    texts = spark.createDataFrame([(1, 0, "Bayes theorem"), (1, 1, "Gauss formula"), (1, 2, "短"), (1, 3, "bayes aaaa bbbb cccc dddd")], "k int, i int, text string")
    assert rows(audit.one_sided_verdicts(texts, pool, "k", "text"), "i", "verdict") == [(0, "misplaced"), (1, "unique"), (2, "unsure"), (3, "unsure")]


def test_screening_rules(spark):
    cols = "n_src int, n_tgt int, only_src int, only_tgt int, footnotes int, multi int, pairs int, run_src int, run_tgt int, misplaced int, title string, chapter_title string, key string, chapter_has_src boolean"
    base = dict(n_src=10, n_tgt=10, only_src=0, only_tgt=0, footnotes=0, multi=0, pairs=10, run_src=0, run_tgt=0, misplaced=0, title="x", chapter_title="", key="chapter1", chapter_has_src=True)
    told = [base | d for d in ({"chapter_has_src": False}, {"title": "References"}, {"n_tgt": 9, "only_src": 1, "run_src": 1}, {"n_tgt": 8, "only_src": 2, "run_src": 2, "footnotes": 2}, {}, {"n_tgt": 7, "only_src": 3, "run_src": 3})]
    df = spark.createDataFrame([tuple(d.values()) for d in told], cols)
    assert [r.verdict.split(":")[0] + r.verdict.partition(":")[2][:9] for r in audit.screened(df).collect()] == ["exempt no sourc", "exempt bibliogr", "exempt isolated", "exempt footnote", "exempt unique", "candidate"]


def test_gates_and_candidates(spark):
    df = spark.createDataFrame([(1, "dp", 3, 0), (1, "model", 2, 1), (2, "dp", 1, 0), (2, "model", 1, 1)], "k int, name string, bad int, rank int")
    assert rows(audit.best_candidate(df, ["k"]), "k", "winner") == [(1, "model"), (2, "dp")]
    rates = spark.createDataFrame([(0.15,), (0.16,)], "rate double")
    assert [r.route for r in audit.admitted(rates).collect()] == ["accepted", "needs_annotation"]
    rule = spark.createDataFrame([(0.9, 0.9, 1, 2, 5, 4), (0.7, 0.9, 1, 2, 1, 4)], "src_coverage double, tgt_coverage double, new_skew int, old_skew int, new_bad int, old_bad int")
    assert [r.accepted for r in audit.accept_annotation(rule).collect()] == [True, False]


def test_annotations_and_orders(spark):
    p = pairs(spark, [([0], [0], 1.0, TEXT, TEXT)])
    notes = spark.createDataFrame([(1, 0, "skew")], "k int, pair_idx int, label string")
    assert audit.annotate(p, notes, ["k", "pair_idx"]).first().label == "skew"
    kids = spark.createDataFrame([(1, 0, "src"), (1, 1, "tgt"), (2, 0, "tgt"), (3, 0, "src")], "key int, pos int, side string")
    assert rows(audit.side_order(kids), "key", "order") == [(1, "src_first"), (2, "tgt_first"), (3, "src_only")]
    a, b = (spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "k int, i int, v string") for x in ("abcd", "abxd"))
    assert rows(audit.sequences_equal(a, b, "k", "i", "v"), "first_difference", "n_differences") == [(3, 1)]


def test_wide_groups_and_shapes(spark):
    long = "x" * 60
    p = pairs(spark, [([0, 1, 2], [0, 1], 1.0, long, long), ([3], [2, 3], 1.0, long, long), ([4, 5, 6], [4, 5], 1.0, "short", long)])
    assert rows(audit.wide_groups(p), "pair_idx") == [(0,)]
    s = audit.skew_shapes(p, F.lit(True)).first()
    assert (s.multi_tgt, s.single_tgt, s.multi_src) == (3, 0, 2)


def test_visuals_beside(spark):
    single = spark.createDataFrame([(1, 2), (1, 5), (1, 9)], "k int, at int")
    visual = spark.createDataFrame([(1, 2), (1, 6)], "k int, after int")
    assert rows(audit.beside_visuals(single, visual, "k"), "at", "visual") == [(2, "same"), (5, "after"), (9, "none")]


def test_refinement_and_integrity(spark):
    now = spark.createDataFrame([(1, [0, 1]), (1, [2])], "k int, src array<int>")
    assert matching.is_refinement(spark.createDataFrame([(1, [0]), (1, [1]), (1, [2])], "k int, src array<int>"), now, "k").first().refines
    assert not matching.is_refinement(spark.createDataFrame([(1, [0]), (1, [1, 2])], "k int, src array<int>"), now, "k").first().refines
    maps = spark.createDataFrame([("a", 0, 0, 0), ("a", 1, 1, 1), ("b", 0, 0, 1), ("b", 1, 1, 0), ("c", 0, 0, 7)], "key string, ord int, src int, tgt int")
    got = {r.key: (r.in_bounds, r.monotone, r.valid) for r in matching.mapping_integrity(maps, F.lit(2), F.lit(2)).collect()}
    assert got == {"a": (True, True, True), "b": (True, False, False), "c": (False, True, False)}


def test_titles_references_and_owners(spark):
    docs = spark.createDataFrame([("x/a.html", "old"), ("b.html", "keep")], "path string, title string")
    toc = spark.createDataFrame([("text/a.html", "New")], "path string, title string")
    assert rows(matching.toc_titles(docs, toc), "path", "title") == [("b.html", "keep"), ("x/a.html", "New")]
    refs = spark.createDataFrame([("1.2",), ("1.3",)], "no string")
    assert rows(matching.dead_references(refs, refs.where("no = '1.2'"), "no"), "no") == [("1.3",)]
    units = spark.createDataFrame([("b", 0, "前言"), ("b", 1, "致谢"), ("b", 2, "第1章")], "book string, ord int, title string")
    assert [r.target_ord for r in matching.fold_acknowledgments(units, False, True).orderBy("ord").collect()] == [0, 0, 2]
    spans = spark.createDataFrame([(1, "wide", 0, 9), (1, "narrow", 3, 5)], "k int, span_id string, low int, high int")
    places = spark.createDataFrame([(1, 4), (1, 8)], "k int, at int")
    assert rows(matching.owners(places, spans, "k"), "at", "span_id") == [(4, "narrow"), (8, "wide")]
    assert [r[0] for r in spark.range(1).select(matching.proportional_place(F.lit(4), F.lit(10), F.lit(5))).collect()] == [1]


def test_increasing_pairs_and_anchors(spark):
    p = spark.createDataFrame([(1, 0, 3), (1, 1, 1), (1, 2, 4)], "k int, i int, j int")
    assert rows(alignment.increasing_pairs(p, "k"), "i", "j") == [(0, 3), (2, 4)]
    text = lambda marks: spark.createDataFrame([(1, i, f"({m}) text of it") for i, m in enumerate(marks)], "k int, idx int, text string")
    assert rows(alignment.unique_anchors(text("aabc"), text("bca"), "k"), "i", "j") == [(2, 0), (3, 1)]


def test_soft_anchors_follow_the_rule(spark):
    """Read directly: the nearest of the places within three whose lengths agree and that a sign or the sentence curve speaks for, always further on."""
    dice = random.Random(4)
    words = ["alpha", "beta", "gamma", "12", "37", "400", "de", "x"]
    make = lambda k: [(k, i, " ".join(dice.choice(words) for _ in range(dice.randint(3, 12))) + dice.choice([".", ". More here now.", ""])) for i in range(dice.randint(2, 9))]
    a, b = ([r for k in range(12) for r in make(k)] for _ in range(2))
    df = lambda rows_: spark.createDataFrame(rows_, "doc_id int, idx int, text string")
    want = []
    for k in range(12):
        src, tgt = ([t for d, _, t in side if d == k] for side in (a, b))
        size = lambda t: len([w for w in t.split() if re.search("[A-Za-z0-9]", w)])
        signs = lambda t: {w for w in re.findall("[0-9]{2,}|[A-Za-z]{3,}", t)}
        curve = lambda t: [max(1, size(s)) for s in re.split("[。！？；!?;]+", t) if s.strip()]
        low = 0
        for i, s in enumerate(src if len(src) >= 4 and len(tgt) >= 4 else []):
            found = []
            for j, t in enumerate(tgt):
                off = abs(math.log((size(t) + 1) / (max(1, size(s)) + 1)))
                if j >= low and abs(i - j) <= 3 and off <= 0.30:
                    bent, sign = kernels.dtw(curve(s), curve(t)), bool({x.lower() for x in signs(s)} & {x.lower() for x in signs(t)})
                    if sign or bent <= 0.25:
                        found.append((off + 0.4 * bent - 0.05 * sign, j))
            if found:
                want.append((k, i, min(found)[1]))
                low = min(found)[1] + 1
    got = rows(alignment.soft_anchors(df(a), df(b), "doc_id", unit="words", k=1.0), "doc_id", "i", "j")
    assert sorted(got) == sorted(want) and len(want) > 10


def test_section_maps(spark):
    from duolith.operators import books

    assert books.coalesced([([0], [1]), ([1], [1, 2]), ([2], [])], 4, 5) == [([0, 1], [1, 2]), ([2], []), ([3], []), ([], [0]), ([], [3]), ([], [4])]
    assert books.one_sided_merged([([0], [0]), ([1], []), ([], [1]), ([2], [2])]) == [([0, 1], [0, 1]), ([2], [2])]
    assert books.claimed_pairs([[1], [1, 3], []], 5) == [([], [0]), ([0], [1]), ([], [2]), ([1], [3]), ([2], []), ([], [4])]


def test_one_side_only(spark):
    one = spark.createDataFrame([(1, 0, "a b"), (2, 0, "c d")], "doc_id int, idx int, text string")
    got = rows(alignment.align(one, one.where("doc_id = 1"), unit="words", k=1.0), "doc_id", "src", "tgt")
    assert got == [(1, [0], [0]), (2, [0], [])]
    assert alignment.align(one.limit(0), one.limit(0), unit="words").count() == 0


def test_lexicon_breaks_ties_by_token(spark):
    df = spark.createDataFrame([(["a"], ["x", "y", "z", "w"])] * 2, "l array<string>, r array<string>")
    assert rows(matching.dice_lexicon(df, "l", "r"), "g", "rank") == [("w", 1), ("x", 2), ("y", 3)]


def test_costs(spark):
    at = lambda d, h: datetime.datetime(2026, 9, d, h)
    df = spark.createDataFrame([("deepseek-chat", at(14, 8), 1_000_000, 400_000, 100_000), ("x qwen3.7-flash y", at(14, 9), 1_000_000, 0, 0), ("?", at(12, 9), 0, 0, 1_000_000)], "model string, ts timestamp_ntz, prompt long, cached long, completion long")
    got = {r.model: (float(r.cost), float(r.saved)) for r in usage.with_cost(df).collect()}
    assert got["deepseek-chat"] == pytest.approx((0.4 * 0.02 + 0.6 * 1 + 0.1 * 4, 0.4 * 0.98)) and got["x qwen3.7-flash y"][0] == pytest.approx(0.4) and got["?"][0] == pytest.approx(4.0)
    e = spark.range(1).select(*[c.alias(n) for n, c in usage.estimated_tokens(F.lit(41), F.lit(2)).items()]).first()
    assert (e.tokens_in, e.tokens_out) == (3 * 5600 + 400, 3 * 400 + 400)


def test_signals_and_maps(spark):
    df = spark.createDataFrame([("(2.15) see 2–15 and 123 “quoted words” Bayes",)], "t string")
    m = df.select(T.signal_map(F.col("t"))).first()[0]
    assert m["eq"] == ["2.15"] and m["int"] == ["123"] and m["quot"] == ["quoted words"] and "bayes" in m["word"] and "2.15" in m["num"]


def test_paragraphs_without_words_meet_their_copies(spark):
    told = ["\u00c8.", "one two three", "\u00c8.", "\u00e9\u00e8", "four five", "\u00c8.", "six seven eight nine", "\u00e0", "\u00c8."]
    p = spark.createDataFrame([(1, i, t) for i, t in enumerate(told)], "doc_id bigint, idx int, text string")
    for repair in (False, True):
        links = alignment.align(p, p, unit="words", k=1.0, repair=repair)
        assert rows(links, "pair_idx", "src", "tgt", "r", "c") == [(i, [i], [i], 1.0, 1.0) for i in range(len(told))]
