"""Structure operators on small tables with known results."""

from pyspark.sql import functions as F

from duolith.functions import text as T
from duolith.operators import structure as B
from duolith.plans import queries as Q


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_unit_kinds(spark):
    told = [("第 3 章 初等", ""), ("Chapter 12", ""), ("第二部分", ""), ("Part IV", ""), ("Appendix B", ""), ("Preface:", ""), ("致谢", ""), ("Index", ""), ("The Outside View", "x/chapter023.xhtml"), ("x", "a_Appendix2.html"), ("plain", "y.html")]
    got = spark.createDataFrame(told, "title string, file string").select(B.unit_kind(F.col("title"), F.col("file")).alias("k")).collect()
    assert [(r.k.kind, r.k.num) for r in got] == [("ch", "3"), ("ch", "12"), ("pt", "2"), ("pt", "4"), ("ap", "B"), ("front", None), ("back", None), ("skip", None), ("ch", "23"), ("ap", "B"), (None, None)]


def test_chapter_keys(spark):
    told = [(["Chapter Twelve"], 900, ""), (["Part II"], 900, ""), (["Notes"], 9, ""), (["A Title"], 900, "x/copyright.html"), (["Short"], 10, ""), (["Long one"], 900, ""), (["Chapter IX", "x"], 900, "")]
    got = spark.createDataFrame(told, "heads array<string>, n int, file string").select(B.chapter_key(F.col("heads"), F.col("n"), F.col("file")).alias("k")).collect()
    assert [(r.k.kind, r.k.num) for r in got] == [("chapter", 12), ("part", 2), ("notes", 0), ("skip", 0), ("skip", 0), ("other", 0), ("chapter", 9)]


def test_units_continue_and_keep_the_first(spark):
    docs = spark.createDataFrame([("b", i, f"f{i}.html", t) for i, t in enumerate(["x", "Preface", "Foreword", "Chapter 1", "more", "Chapter 1", "Index"])], "book string, spine int, file string, title string")
    assert rows(B.units(docs), "key", "files") == [("ch:1", ["f3.html", "f4.html"]), ("front:1", ["f1.html"]), ("front:2", ["f2.html"])]


def test_section_candidates(spark):
    heads = spark.createDataFrame([("u", "Cognitive Ease", i, t) for i, t in enumerate(["第5章", "Cognitive Ease", "COGNITIVE EASE", "Illusions of Truth", "Illusions of Truth", "THE PLEASURE OF COGNITIVE EASE", "notes", "〔x〕"])], "unit string, label string, pos int, text string")
    assert rows(B.section_candidates(heads), "text") == [("Illusions of Truth",), ("THE PLEASURE OF COGNITIVE EASE",)]


def test_sections_by_number(spark):
    side = lambda titles: spark.createDataFrame([(1, i, t) for i, t in enumerate(titles)], "k int, idx int, title string")
    got = B.sections_by_number(side(["2.1 a", "2.2 b", "Aside", "2.3 c", "Lost"]), side(["2.1 x", "2.2 y", "旁白", "2.3 z"]), "k")
    assert rows(got, "src_idx", "tgt_idx") == [(0, 0), (1, 1), (2, 2), (3, 3), (4, None)]
    assert B.sections_by_number(side(["2.1 a", "b", "c"]), side(["2.1 x", "y", "z"]), "k").count() == 0


def test_peeling(spark):
    own = spark.createDataFrame([(1, i, t) for i, t in enumerate(["正文", "(a) 第一条性质", "(b) 第二条性质", "结束"])], "k int, idx int, text string")
    other = spark.createDataFrame([(1, 0, "text"), (1, 1, "end")], "k int, idx int, text string")
    vis = spark.createDataFrame([(1, 0), (1, 1)], "k int, after int")
    assert rows(B.peel_runs(own, other, vis, "k", T.enum_key(F.col("text")) != ""), "first", "last") == [(1, 2)]
    assert B.peel_runs(own, own, vis, "k", T.enum_key(F.col("text")) != "").count() == 0


def test_figures_claim_once(spark):
    fig = spark.createDataFrame([(1, 0, "2.1", "", 5), (1, 1, "", "3-1", 5), (1, 2, "", "", 5), (1, 3, "", "", 90)], "k int, idx int, eq string, cap string, pos int")
    tgt = spark.createDataFrame([(1, 0, "", "", 6), (1, 1, "", "3-1", 40), (1, 2, "2.1", "", 50), (1, 3, "", "", 7)], "k int, idx int, eq string, cap string, pos int")
    assert rows(B.attach_figures(fig, tgt, "k"), "fig", "target") == [(0, 2), (1, 1), (2, 0), (3, 3)]


def test_conflicts_titles_and_instability(spark):
    long = "汉" * 30
    p = spark.createDataFrame([(1, 0, [0], [0, 1], "a few words", long, "蕴涵关系"), (1, 1, [5], [2], "see 2.15 for all of the long words here", long, "x")], "k int, pair_idx int, src array<int>, tgt array<int>, src_text string, tgt_text string, first_text string")
    assert rows(B.structural_conflicts(p), "pair_idx", "conflict") == [(0, "short source, long target"), (1, "numbers apart")]
    assert rows(B.leading_titles(p, spark.createDataFrame([(1, 1)], "k int, at int"), "k"), "pair_idx", "tgt") == [(0, 0)]
    assert B.unstable_pairs(p, p.where("pair_idx = 0"), "k").count() == 1


def test_fuzzy_duplicates(spark):
    df = spark.createDataFrame([(1, 0, "the quick brown fox jumps"), (1, 1, "the quick brown fox jumped"), (1, 2, "something else entirely here"), (2, 0, "the quick brown fox jumps")], "k int, idx int, text string")
    assert rows(B.fuzzy_duplicates(df, "k"), "k", "idx", "other") == [(1, 0, 1), (1, 1, 0)]


def test_placement_and_gaps(spark):
    ev = lambda told: spark.createDataFrame([(1, i, *x) for i, x in enumerate(told)], "k int, pos int, no string, text string")
    a = B.preceding_text(ev([(None, "first para"), ("2.1", None), (None, "second"), ("2.2", None), ("2.3", None)]), "k", "pos", "no", "text")
    b = B.preceding_text(ev([(None, "first para"), ("2.1", None), ("2.2", None), ("2.9", None)]), "k", "pos", "no", "text")
    assert rows(B.placement(a, b, "k", "no"), "no", "placement") == [("2.1", "same"), ("2.2", "moved"), ("2.3", "only_first"), ("2.9", "only_second")]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["2.1 A", "short line", "a sentence.", "2.2 B", "other"])], "k int, pos int, text string")
    marks = spark.createDataFrame([(1, 0, "2.1"), (1, 3, "2.2")], "k int, pos int, anchor string")
    assert rows(B.lines_between(lines, marks, "k"), "anchor", "text") == [("2.1", "short line"), ("2.2", "other")]


def test_kinds_hints_and_scores(spark):
    df = spark.createDataFrame([("",), ("Figure 3.2 A thing",), ("[1] note here",), ("Short meta",), ("x" * 30,), ("Long words, that go on and on and on, with a stop at the end of it.",)], "t string")
    assert [r[0] for r in df.select(B.one_sided_kind(F.col("t"))).collect()] == ["empty", "caption", "footnote", "metadata", "lead-in", "prose"]
    a, b = spark.createDataFrame([(1, 0, "Bayes 1763 theorem")], "k int, idx int, text string"), spark.createDataFrame([(1, 0, "bayes 1763")], "k int, idx int, text string")
    assert rows(B.hint_hits(a, b, "k"), "n_hints", "n_found") == [(3, 2)]
    u = spark.createDataFrame([("b", 0, "ch:1"), ("b", 1, "ch:2")], "book string, idx int, key string")
    found = spark.createDataFrame([("b", 0, 0), ("b", 1, 0)], "book string, src int, tgt int")
    s = B.key_scores(found, u, u).first()
    assert (s.tp, s.fp, s.fn) == (1, 1, 1)
    assert B.chapter_stats(Q.blocks(spark, "/root/testdata/sf0.001"), "doc_id").count() > 100
