"""Column functions against known values."""

import pytest
from pyspark.sql import functions as F

from duolith.functions import text as T


def values(spark, make, texts, kind="string"):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, t {kind}")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("t"))).collect()]


CASES = [
    (T.han_chars, ["中文 abc", "", None], [2, 0, 0]),
    (T.en_words, ["a　b c²３ é_x -- 12", "é", None], [5, 0, 0]),
    (T.numbers, ["1,200 3 45.60 45.6 100", "7"], [["1200", "45.6", "100"], []]),
    (T.en_tokens, ["That Bayes bayes cat theory"], [["bayes", "bayes", "theory"]]),
    (T.zh_bigrams, ["概率a论", "概", "无无无"], [["概率", "率论"], [], ["无无"]]),
    (T.note_likeness, ["这是正文", "参见第三章", "See www.x.org", ""], [0.0, 0.8, 1.0, 0.0]),
    (T.no_translate_reason, ["", "x = y", "Smith, J. (1990) Some long enough title of a book", "This is an ordinary sentence with words"], ["empty", "symbolic", "reference", ""]),
    (T.enum_key, ["(a) first item", "（IIIb） 第三条内容", "(a)", "(abcd) no"], ["a", "IIIb", "", ""]),
    (T.is_definition, ["A ≡ it will start to rain", "where α ≡ max(1)", "For n = 37 trials", "(1) 〈β〉 = α,", "the = x"], [True, False, False, True, False]),
    (T.is_note, ["[1] In his talk", "(1) text", "x [1] y"], [True, False, False]),
    (T.is_footnote, ["[12] note", "① 注", "as [3] says"], [True, True, False]),
    (T.is_connective, ["Likewise,", "也可以", "这就是为什么我们必须考虑先验信息", "a theorem of Gauss"], [True, True, False, False]),
    (T.content_signals, ["see 2.6 and A.1 in “Annals” theory theory"], [["2.6", "A.1", "q:annals", "w:annals", "w:theory"]]),
    (T.struct_kind, ["", "[3] note text", "where", "a longer paragraph of text"], ["frag", "note", "frag", ""]),
    (T.section_number, ["2.6.1 Goedel", "第3章 初等", "Chapter 12", "Appendix A.1", "A.2 x", "4. Elementary", "4", "none"], ["2.6.1", "3", "12", "A.1", "A.2", "4", "4", ""]),
    (T.roman, ["iv", "IX", "xl", "i"], [4, 9, 40, 1]),
    (T.cn_int, ["一", "十", "十二", "二十", "三十五", "42", "", "x"], [1, 10, 12, 20, 35, 42, -1, -1]),
    (T.class_level, ["h2a", "h3", "chapter-title", "h2a1"], [2, 3, 1, 1]),
    (T.looks_like_heading, ["A title", "A sentence.", "", "x" * 121], [True, False, False, False]),
    (T.norm_cjk_spacing, ["第 1 章", "1 0 章", "plain text 1 2"], ["第1章", "10章", "plain text 1 2"]),
    (T.normalised_path, ["a/../b/./c.html", "..\\x\\y", "/a//b"], ["b/c.html", "x/y", "a/b"]),
    (T.equation_key, ["02.100", "2.1", "2-07"], ["2.100", "2.1", "2.7"]),
    (T.equation_tag, ["x = y \\tag{2.15}", "x"], ["2.15", ""]),
    (T.figure_refs, ["Figure 3.2 and Fig. 3-2, 图 4–1"], [["3-2", "4-1"]]),
    (T.is_caption_label, ["Figure 3.2", "表17-1", "Figure 3.2 shows that"], [True, True, False]),
    (T.strip_fill_prefix, ["[1] 2. text", "text 1."], ["text", "text 1."]),
    (T.slugify, ["Probability Theory: The Logic"], ["probability-theory-the-logic"]),
    (T.norm_md_inline, ["**bold** and ![i](x.png)[link](y)"], ["bold and link"]),
    (T.without_tags, ["<p>a &amp; <b>b</b></p>"], ["a & b"]),
    (lambda t: T.is_untranslated_section(t, F.lit(""), F.lit("")), ["Bibliography", "参考文献", "Chapter 1"], [True, True, False]),
    (T.sentence_lengths, ["One two. Three; four!"], [[3, 1]]),
    (lambda t: T.map_position(F.lit(5), F.lit(10), t), ["一二三四五六。八九十", "", "没有标点"], [7, 0, 4]),
    (lambda t: T.zh_mass(t, 2.0), ["概率 x=1", "概率"], [4.0, 2.0]),
]


@pytest.mark.parametrize("n", range(len(CASES)))
def test_text_function(spark, n):
    make, texts, want = CASES[n]
    assert values(spark, make, texts) == want


def test_enum_family(spark):
    got = values(spark, T.enum_family, [["a", "b", "c"], ["IIIa", "IIIb"], ["a", "a"], ["a", "b", "I"], ["1", "2"], ["i", "ii", "iii"], ["a"]], "array<string>")
    assert got == [True, True, False, False, True, True, False]


def test_semantic_types(spark):
    rows = [("h2", "", "", "x"), ("p", "epigraph", "", "x"), ("p", "h2a", "", "Title"), ("p", "h2", "", "A sentence."), ("li", "", "", "x"), ("div", "", "pagebreak", "x"), ("p", "", "", "x"), ("hr", "", "", "")]
    df = spark.createDataFrame(rows, "tag string, cls string, kind string, text string")
    got = [r[0] for r in df.select(T.semantic_type(*map(F.col, df.columns))).collect()]
    assert got == ["heading", "quote", "heading", "para", "li", "sep", "para", "sep"]
