"""Text measures and predicates as column expressions (inventory F and parts of T).

All are built-in functions, so they stay inside generated code. Patterns use the
Unicode classes of Java where white space or word characters may be non-ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = "[\\u4e00-\\u9fff]"
WORDISH = "(?U)\\S*[A-Za-z0-9]\\S*"

# Words that carry no lexical signal.
LEXICON_STOP = """
the and for that with this from they have are was were not but his her its you our
their them there then than when what which who how why all can will would could should
about into over more most some such only also been being because these those does did
has had one two out any may might must very much many other each even like just
now see way things thing people world
""".split()
# Latin words that prove nothing when found on the other side.
SIGNAL_STOP = """
the and that this with from which have been there their would could should about these those
when then than them they will shall must some such only also more most less least very well
case cases made make give given take taken used using true false here where what other another
first second third same different each both many much however therefore thus hence because since
""".split()
# Words before an equals sign that don't define anything.
DEFINITION_STOP = """
the this that then there these those where when but and for or if as so now since
given with from in on at by we it is are was were let thus hence here note see
""".split()


def _text(t: Column) -> Column:
    return F.coalesce(t, F.lit(""))


def _count(t: Column, pattern: str) -> Column:
    return F.regexp_count(_text(t), F.lit(pattern))


def _all(t: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_text(t), F.lit(pattern), F.lit(group))


def stripped(t: Column) -> Column:
    return F.regexp_replace(_text(t), "(?U)^\\s+|\\s+$", "")


# Length measures.
def han_chars(t: Column) -> Column:
    return _count(t, HAN)


def en_words(t: Column) -> Column:
    return _count(t, WORDISH)


def zh_mass(t: Column, k: Column | float = 1.85, weight: float = 1.0) -> Column:
    """Han characters, plus k for each other word-like token (formulas, Latin, digits)."""
    k = F.lit(k) if isinstance(k, float | int) else k
    return han_chars(t) + weight * k * _count(F.regexp_replace(_text(t), HAN, " "), WORDISH)


def mass(t: Column, lang: Column) -> Column:
    """Length of a text in its language's own unit."""
    return F.when(lang == "zh", han_chars(t)).otherwise(en_words(t))


def estimate_k(target_mass: Column, source_words: Column, low: float = 1.25, high: float = 2.25, default: float = 1.85) -> Column:
    """Aggregate: target mass for each source word, clamped."""
    a, b = F.sum(target_mass), F.sum(source_words)
    return F.when((a > 0) & (b > 0), F.least(F.greatest(a / b, F.lit(low)), F.lit(high))).otherwise(F.lit(default))


# anchors and tokens.
def numbers(t: Column) -> Column:
    """Distinct numbers of two digits or more; trailing zeros go from decimals only."""
    plain = F.transform(_all(t, "[0-9][0-9,]*(?:\\.[0-9]+)?"), lambda x: F.replace(x, F.lit(","), F.lit("")))
    long = F.filter(plain, lambda x: F.length(F.replace(x, F.lit("."), F.lit(""))) >= 2)
    return F.array_distinct(F.transform(long, lambda x: F.when(F.contains(x, F.lit(".")), F.regexp_replace(F.regexp_replace(x, "0+$", ""), "\\.$", "")).otherwise(x)))


def _without(tokens: Column, stop: list[str]) -> Column:
    return F.array_except(tokens, F.array(*[F.lit(w) for w in stop]))


def en_tokens(t: Column) -> Column:
    """Words of four ASCII letters or more that aren't stop words, each as often as it occurs."""
    stop = F.array(*[F.lit(w) for w in LEXICON_STOP])
    return F.filter(F.transform(_all(t, "[A-Za-z]{4,}"), F.lower), lambda w: ~F.array_contains(stop, w))


def zh_bigrams(t: Column) -> Column:
    han = F.array_join(_all(t, HAN), "")
    n = F.length(han)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(han, i, F.lit(2)))))


def sentence_lengths(t: Column, lang: str = "en", most: int = 14) -> Column:
    """Lengths, one at least, of the first sentences."""
    parts = F.filter(F.split(_text(t), "[。！？；!?;]+"), lambda s: F.length(stripped(s)) > 0)
    measure = en_words if lang == "en" else han_chars
    return F.transform(F.slice(parts, 1, most), lambda s: F.greatest(F.lit(1), measure(s)))


def lexicon_score(targets: Column, bigrams: Column, n_tokens: Column) -> Column:
    """Share of a source paragraph's tokens whose known counterparts occur; tokens count with multiplicity."""
    return F.when((F.size(targets) == 0) | (F.size(bigrams) == 0) | (n_tokens == 0), 0.0).otherwise(F.size(F.array_intersect(targets, bigrams)) / n_tokens)


# Kinds of paragraphs.
def note_likeness(t: Column) -> Column:
    """From 0 (running text) to 1 (note or reference)."""
    t = _text(t)
    share = _count(t, "[A-Za-z]") / F.greatest(F.lit(1), F.length(t))
    latin = F.when(share > 0.30, 1.0).when(share > 0.18, 0.6).otherwise(0.0)
    cue = F.when(F.substring(t, 1, 12).rlike("参见|请参见|延伸阅读|注释|参考书目"), 0.8).otherwise(0.0)
    cited = F.when(t.rlike("\\((?:19|20)[0-9]{2}\\)|\\bwww\\.|\\bhttps?://|accessed|Press,|\\bed[s]?\\."), 0.9).otherwise(0.0)
    return F.when(F.length(t) == 0, 0.0).otherwise(F.greatest(latin, cue, cited))


# The shape of a reference.
REFERENCE = (
    "\\([0-9]{4}[a-z]?\\)|\\b(?:pp?\\.|Vol\\.|No\\.|doi:|https?://|Retrieved from|eds?\\.|In [A-Z][a-z]+,)\\b|^\\s*[A-Z][A-Za-z'\\-]+,\\s+[A-Z]\\."
)


def no_translate_reason(t: Column) -> Column:
    """'empty', 'symbolic', 'reference', or '' where a counterpart is expected."""
    s = stripped(t)
    words, letters = _count(s, "[A-Za-z]{3,}"), _count(s, "[A-Za-z]")
    return F.when(s == "", "empty").when((words <= 3) & (letters <= 16), "symbolic").when(s.rlike(REFERENCE) & (words <= 60), "reference").otherwise("")


def is_note(t: Column, strong_only: bool = True) -> Column:
    strong = _text(t).rlike("^\\s*\\[\\s*[0-9]{1,3}\\s*\\]\\s+\\S")
    return strong if strong_only else strong | _text(t).rlike("^\\s*(?:\\(\\s*[0-9]{1,3}\\s*\\)|[0-9]{1,3}\\s*[.、])\\s+\\S")


def is_footnote(t: Column) -> Column:
    return _text(t).rlike("^\\s*\\[[0-9]{1,3}\\]|^\\s*[\\u2460-\\u2473]")


# Connectives between formulas.
CONNECTIVE_EN = (
    "(?i)^\\W*(where|we have|and|or|but|then|so|thus|hence|if|for|with|is|are|is equal to|or, equally well|likewise|namely|that is|i\\.?e\\.?"
    "|it follows|the proposition|we find that|and, after some rather tedious algebra,[\\s\\w]*we find that|first we note that|in this case|in general|note that"
    "|to see this|more generally|for example|in other words)\\W*$"
)
CONNECTIVE_ZH = (
    "^[\\s，。、；：（）]*(也可以|最后，?我们有|则|所以|因此|即|并且|而|但是|于是|首先计算|由此|这表明|于是有|故|其中|此时|接下来|另一方面|历史题外话|同样的|一般地"
    "|注意|例如|换言之|也就是说|在这种情况下|可以看到|不难看出)[\\s，。、；：（）]*$"
)


def is_connective(t: Column) -> Column:
    """A short scrap between formulas."""
    s = stripped(t)
    listed = s.rlike(CONNECTIVE_EN) | s.rlike(CONNECTIVE_ZH)
    return (F.length(s) > 0) & (F.length(s) <= 40) & (listed | (F.length(s) <= 12) & (F.size(content_signals(s)) == 0))


def is_untranslated_section(title: Column, chapter_title: Column, key: Column) -> Column:
    kinds = "(?i)bibliograph|references?|subject index|name index|index of names|引用文献|参考文献|书目|人名索引|主题索引|索引"
    return _text(title).rlike(kinds) | _text(chapter_title).rlike(kinds) | _text(key).rlike("(?i)^(bibliography|references?|index|subjectindex|nameindex)$")


# What counts as mathematics and as code.
MATHY = "\\$[^$]{2,}\\$|\\\\[a-zA-Z]{2,}|\\\\frac|\\\\sum|\\\\int|\\\\tag"
CODEY = "(?m)(?:^\\s*>>>|^\\s*(?:import|from|def|class|plt\\.|np\\.|tf\\.)|\\w+\\s*=\\s*\\w+\\(|\\{\\s*\\w+\\s*:)"


def formulaish(t: Column) -> Column:
    """Over 15 % of it is mathematics, or it looks like code."""
    t = _text(t)
    math = F.aggregate(_all(t, MATHY), F.lit(0), lambda n, x: n + F.length(x))
    return (math / F.greatest(F.lit(1), F.length(t)) > 0.15) | t.rlike(CODEY)


def struct_kind(t: Column) -> Column:
    """'note', 'frag' or '' for running text."""
    s = stripped(t)
    return F.when(s == "", "frag").when(s.rlike("^\\s*[\\[（(]?\\s*[0-9]{1,3}\\s*[\\]）)]?\\s+\\S"), "note").when(F.length(s) <= 12, "frag").otherwise("")


# enumerations and definitions.
def enum_key(t: Column) -> Column:
    """The enumerator that opens a paragraph, '' if there is none or nothing follows it."""
    opening = "^[\\s\\u3000]*[（(]\\s*([IVXLC]{1,5}[a-z]?|[a-z]{1,3}|[0-9]{1,2}[a-z]?)\\s*[)）][\\s\\u3000]*"
    rest = stripped(F.regexp_replace(_text(t), opening, ""))
    return F.when(F.length(rest) >= 4, F.regexp_extract(_text(t), opening, 1)).otherwise("")


def enum_family(keys: Column) -> Column:
    """Whether an array of enumerators is one family: one Roman prefix, tails of one kind, none twice."""
    shape = "^([IVXLC]*)([a-z]*|[0-9]*)$"
    head = F.transform(keys, lambda k: F.regexp_extract(k, shape, 1))
    tail = F.filter(F.transform(keys, lambda k: F.regexp_extract(k, shape, 2)), lambda x: x != "")
    first = F.lower(F.element_at(head, 1))
    roman = F.forall(tail, lambda x: x.rlike("^[ivxl]+$") | F.concat(first, x).rlike("^[ivxl]+$"))
    kinds = roman | F.forall(tail, lambda x: x.rlike("^[a-z]$")) | F.forall(tail, lambda x: x.rlike("^[0-9]+$"))
    return (
        (F.size(keys) >= 2) & F.forall(keys, lambda k: k.rlike(shape)) & (F.size(F.array_distinct(head)) == 1) & kinds & (F.size(F.array_distinct(keys)) == F.size(keys))
    )


def is_definition(t: Column) -> Column:
    """A short line whose equals sign stands early, after one compact symbol."""
    s = stripped(t)
    sign = "≡|:=|(?<![<>≤≥≠=!+\\-*/])=(?!=)"
    at = F.regexp_instr(s, F.lit(sign))
    left = stripped(F.substring(s, F.lit(1), at - 1))
    symbol = F.regexp_replace(left, "^[\\(\\[\\{]\\s*([0-9]{1,2}|[A-Za-z]′?|[ivxIVX]{1,4})\\s*[\\)\\]\\}]\\s*", "")
    symbol = stripped(F.regexp_replace(symbol, "^[.,，。:：;；]+", ""))
    compact = (F.length(symbol) > 0) & (F.length(symbol) <= 12) & ~symbol.rlike("(?U)\\s") & ~symbol.rlike("^[a-z]{3,}$")
    return (F.length(s) > 0) & (F.length(s) <= 64) & (at > 0) & (at <= 19) & (left != "") & compact & ~F.lower(symbol).isin(DEFINITION_STOP)


# signals that survive translation.
def content_signals(t: Column) -> Column:
    """Numbered anchors, quoted Latin (q:) and long Latin words (w:), without repeats."""
    anchors = _all(t, "(?<![0-9.])[0-9]{1,2}\\.[0-9]{1,2}(?:\\.[0-9]{1,2})?(?![0-9.])|(?U)(?<![\\w.])[A-Z]\\.[0-9]{1,2}(?:\\.[0-9]{1,2})?(?![\\w.])")
    quoted = F.transform(_all(t, "[「『\"“‘(（]([A-Za-z][A-Za-z0-9 .'\\-]{3,})[」』\"”’）)]", 1), lambda x: F.lower(F.trim(x)))
    quoted = F.transform(F.filter(quoted, lambda x: F.length(x) >= 4), lambda x: F.concat(F.lit("q:"), x))
    words = _without(F.transform(_all(t, "[A-Za-z]{4,}"), F.lower), SIGNAL_STOP)
    return F.array_distinct(F.concat(anchors, quoted, F.transform(words, lambda w: F.concat(F.lit("w:"), w))))


def numbered_anchors(t: Column) -> Column:
    """Equation, figure, chapter and exercise numbers as kind:number."""
    half = F.translate(_text(t), "０１２３４５６７８９（）．－", "0123456789().-")
    two = "([0-9]{1,2})[-.]?([0-9]{1,3})?"
    kinds = [("eqn", f"(?:式|(?i:eq(?:uation|n)?s?\\.?))\\s*\\(?\\s*{two}"), ("fig", f"(?:图|(?i:fig(?:ure)?s?\\.?))\\s*{two}"), ("chap", "(?:第\\s*|(?i:chapters?)\\s*)([0-9]{1,2})()"), ("ex", f"(?:练习|(?i:exercises?))\\s*{two}")]
    label = lambda kind: lambda x, y: F.concat(F.lit(f"{kind}:"), x, F.when(y == "", "").otherwise(F.concat(F.lit("-"), y)))
    found = [F.zip_with(_all(half, pattern, 1), _all(half, pattern, 2), label(kind)) for kind, pattern in kinds]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def normalised(t: Column) -> Column:
    """For equality: lower case, letters and digits only."""
    return F.regexp_replace(F.lower(_text(t)), "(?U)[^\\p{L}\\p{N}]+", "")


def signal_map(t: Column) -> Column:
    """Signals by kind: num, int, quot, eq, word."""
    dotted = F.translate(_text(t), "–—−‐-", ".....")
    return F.create_map(
        F.lit("num"), F.array_distinct(_all(dotted, "[0-9]+\\.[0-9]+")),
        F.lit("int"), F.array_distinct(_all(dotted, "(?<![0-9.])[0-9]{2,}(?![0-9.])")),
        F.lit("quot"), F.array_distinct(F.transform(_all(t, "[“\"「]([^”\"」]{4,})[”\"」]", 1), F.lower)),
        F.lit("eq"), F.array_distinct(_all(dotted, "[（(]([0-9]{1,2}\\.[0-9]{1,3}[a-z]?)[)）]", 1)),
        F.lit("word"), _without(F.transform(_all(t, "[A-Za-z]{4,}"), F.lower), SIGNAL_STOP),
    )


# shapes of titles, captions and scraps.
def is_codeish(t: Column) -> Column:
    return (F.length(_text(t)) > 0) & (han_chars(t) / F.greatest(F.lit(1), F.length(_text(t))) < 0.15)


def too_short_to_translate(t: Column) -> Column:
    """Two words at most, no end of sentence, and no index entry."""
    s = stripped(t)
    return (F.length(s) > 0) & (_count(s, "(?U)\\S+") <= 2) & ~s.rlike("[.!?。！？]$") & ~s.rlike(",\\s*[0-9]")


def looks_like_title(t: Column, most: int = 40) -> Column:
    s = stripped(t)
    return (F.length(s) > 0) & (F.length(s) <= most) & ~s.rlike("[。！？；.!?;，,：:]$")


def looks_like_fragment(t: Column) -> Column:
    s = stripped(t)
    return (F.length(s) > 0) & (F.length(s) <= 30) & ~s.rlike("[。！？.!?”\"]$")


def looks_like_prose(t: Column) -> Column:
    s = stripped(t)
    return (en_words(s) >= 12) & s.rlike("[a-z]{2,} [a-z]{2,}") & s.rlike("[.!?][\"”')]?$")


def is_caption(t: Column) -> Column:
    s = stripped(t)
    label = s.rlike("(?i)^(?:[图表]\\s*[0-9]+|(?:fig(?:ure)?|table|equation|eq)\\.?\\s*[0-9]+)")
    return label & (F.length(s) <= 110) & (_count(s, "[。.!?！？](?:\\s|$)") <= 2)


# A label that stands alone.
CAPTION_ONLY = "(?i)^(?:[图表]\\s*[0-9]+\\s*[-–—]\\s*[0-9]+|(?:Figure|Table|Fig\\.?|Equation|Eq\\.?)\\s*[0-9]+(?:[.\\-–—][0-9]+)?)\\s*[.．:：·、,，\\-–—]?\\s*$"


def is_caption_label(t: Column) -> Column:
    s = stripped(t)
    return (F.length(s) > 0) & (F.length(s) <= 60) & s.rlike(CAPTION_ONLY)


# numbers of figures and equations.
def figure_refs(t: Column) -> Column:
    return F.array_distinct(F.transform(_all(t, "(?:图|(?i:fig(?:ure)?\\.?))\\s*([0-9]{1,2}\\s*[-–—.]\\s*[0-9]{1,3})", 1), lambda x: F.regexp_replace(x, "\\s*[-–—.]\\s*", "-")))


def equation_tag(t: Column) -> Column:
    return F.regexp_extract(_text(t), "\\\\tag\\*?\\s*\\{\\s*\\(?\\s*([^{}()]+?)\\s*\\)?\\s*\\}", 1)


def equation_key(no: Column) -> Column:
    """Leading zeros don't matter, trailing ones do: 2.07 is 2.7 and 2.100 isn't 2.1."""
    parts = F.split(F.translate(stripped(no), "-–—", "..."), "\\.")
    return F.array_join(F.transform(parts, lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")), ".")


# F25, F27, F29, F30.
def map_position(pos: Column, length: Column, target: Column, reach: int = 40) -> Column:
    """A place in proportion, moved after the next end of sentence within reach, else to the end."""
    n = F.length(_text(target))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), pos / length))
    at = F.bround(share * n).cast("int")
    step = F.regexp_instr(F.substring(_text(target), at + 1, F.lit(reach)), F.lit("[。！？；.!?;]"))
    return F.when(n == 0, 0).when(length <= 0, n).when(step > 0, at + step).otherwise(n)


def strip_fill_prefix(t: Column) -> Column:
    """Drops up to four line-number prefixes."""
    return F.regexp_replace(_text(t), "^(?:\\s*(?:\\[[0-9]{1,4}\\]|[0-9]{1,4}[.)、:：|]|\\([0-9]{1,4}\\))\\s*){1,4}", "")


def escaped(t: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def clean_display(tex: Column) -> Column:
    """Display mathematics without its delimiters, tag and labels."""
    out = F.regexp_replace(_text(tex), "\\\\(?:tag\\*?|label)\\s*\\{[^{}]*\\}", "")
    return stripped(F.regexp_replace(out, "^\\s*(?:\\$\\$|\\\\\\[)|(?:\\$\\$|\\\\\\])\\s*$", ""))


def slugify(t: Column, most: int = 60) -> Column:
    s = F.regexp_replace(F.lower(stripped(t)), "(?U)[^\\w\\u4e00-\\u9fff]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, most), "-+$", "")


def formatted_count(n: Column) -> Column:
    return F.format_number(n, 0)


# Blocks and lines.
# Classes of headings, titles and quotes.
HEAD_CLASS = "(?i)(?:^|[\\s_-])h([1-6])(?:[a-z])?(?:[\\s_-]|$)"
TITLE_CLASS = "(?i)(?:^|[\\s_-])(?:chapter|section|part)[\\s_-]?title(?:[\\s_-]|$)"
FRONT_TITLE_CLASS = "(?i)(?:^|[\\s_-])fm[\\s_-]?title[0-9]*(?:[\\s_-]|$)"
QUOTE_CLASS = "(?i)(?:^|[\\s_-])(?:disp[\\s_-]?(?:quote|para|source)|epigraph|extract)(?:[\\s_-]|$)"


def class_level(cls: Column) -> Column:
    level = F.regexp_extract(_text(cls), HEAD_CLASS, 1)
    return F.when(level == "", 1).otherwise(level.cast("int"))


def looks_like_heading(t: Column) -> Column:
    s = stripped(t)
    return (F.length(s) > 0) & (F.length(s) <= 120) & ~s.rlike("[.。,，;；]$")


def semantic_type(tag: Column, cls: Column, kind: Column, text: Column) -> Column:
    """Type of a block from its tag, class, epub:type and text; the order of the rules matters."""
    cls, kind = F.lower(_text(cls)), F.lower(_text(kind))
    return (
        F.when(tag.rlike("^h[1-6]$"), "heading")
        .when(cls.rlike(QUOTE_CLASS), "quote")
        .when((cls.rlike(HEAD_CLASS) | cls.rlike(TITLE_CLASS) | cls.rlike(FRONT_TITLE_CLASS)) & looks_like_heading(text), "heading")
        .when(tag == "blockquote", "quote")
        .when(tag == "li", "li")
        .when(tag == "pre", "code")
        .when(tag.isin("figure", "table"), tag)
        .when(F.contains(kind, F.lit("pagebreak")), "sep")
        .when(tag == "figcaption", "caption")
        .when(tag == "hr", "sep")
        .otherwise("para")
    )


def norm_cjk_spacing(t: Column) -> Column:
    """No blanks between Han characters, or between them and digits or CJK punctuation."""
    wide, gap = "0-9\\u3000-\\u303f\\uff01-\\uff65", "[ \\t\\u00a0]+"
    out = _text(t)
    for pattern in (f"(?<={HAN}){gap}(?=[\\u4e00-\\u9fff{wide}])", f"(?<=[{wide}]){gap}(?={HAN})", f"(?<=[0-9]){gap}(?=[0-9])"):
        out = F.regexp_replace(out, pattern, "")
    return F.when(_text(t).rlike(HAN), out).otherwise(_text(t))


def is_split_heading(html: Column, text: Column) -> Column:
    """All visible text in two or more <b>, short, without punctuation."""
    rest = stripped(F.regexp_replace(F.regexp_replace(_text(html), "(?is)<b\\b[^>]*>.*?</b>", ""), "<[^>]+>", ""))
    s = stripped(text)
    return (_count(html, "(?i)<b\\b") >= 2) & (rest == "") & (F.length(s) > 0) & (F.length(s) <= 24) & ~s.rlike("[。！？；：，、.!?;:,]")


def is_note_item(tag: Column, cls: Column) -> Column:
    return _text(cls).rlike("(?i)\\b(?:duokan-footnote-item|footnote-item|duokan-footnote|footnote|noteref)\\b") | (F.lower(_text(tag)) == "aside")


def is_inline_note_img(html: Column) -> Column:
    return _text(html).rlike("(?i)<img\\b[^>]*(?:class\\s*=\\s*\"[^\"]*footnote[^\"]*\"|zy-footnote\\s*=)")


def without_tags(html: Column) -> Column:
    """Drops tags and common entities; for all entities see markup.unescaped."""
    out = F.regexp_replace(_text(html), "<[^>]+>", "")
    for entity, char in (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return stripped(F.regexp_replace(out, "(?U)\\s+", " "))


def visual_counts(html: Column) -> dict[str, Column]:
    """Images, note marks, figures, svg, tables and decorative rules of a page."""
    body = F.coalesce(F.nullif(F.regexp_extract(_text(html), "(?is)<body[^>]*>(.*)</body>", 1), F.lit("")), _text(html))
    marks = _count(body, "(?i)<img\\b[^>]*(?:class\\s*=\\s*\"[^\"]*footnote[^\"]*\"|zy-footnote\\s*=)")
    rules = _count(body, "(?i)<p\\b[^>]*class=\"[^\"]*\\bline_img[0-9]?\\b[^\"]*\"[^>]*>\\s*(?:<img\\b[^>]*>\\s*)+</p>")
    rules = rules + _count(body, "(?i)<p\\b[^>]*>\\s*<img\\b[^>]*\\bheight\\s*=\\s*\"[1-4]\"[^>]*\\bwidth\\s*=\\s*\"[0-9]{3,}\"[^>]*>\\s*</p>")
    return {"img": _count(body, "(?i)<img\\b[^>]*>") - marks, "img_note_mark": marks, "rule": rules} | {
        tag: _count(body, f"(?i)<{tag}\\b") for tag in ("figure", "svg", "table")
    }


def is_heading_line(line: Column, lang: str = "en", most: int = 80) -> Column:
    """A plain-text line that opens a unit."""
    s = stripped(line)
    named = "(?i)^(?:chapter|part|book|section|appendix|prologue|epilogue|preface|introduction|contents|index|notes|acknowledg\\w*)\\b" if lang != "zh" else "^(?:第[0-9一二三四五六七八九十百千]+[章节部分篇卷]|序言|前言|结语|后记|致谢|附录|目录|索引|注释)"
    return (F.length(s) > 0) & (F.length(s) <= most) & s.rlike(named) & ~s.rlike("[.。,，;；]$")


def norm_md_inline(t: Column) -> Column:
    """Markdown without images, emphasis and links; <eq> becomes dollars."""
    out = F.regexp_replace(_text(t), "!\\[[^\\]]*\\]\\([^)]*\\)", "")
    out = F.regexp_replace(F.regexp_replace(out, "\\[([^\\]]*)\\]\\([^)]*\\)", "$1"), "</?eq>", "\\$")
    return stripped(F.regexp_replace(out, "(\\*\\*|__|\\*|`)(?=\\S)(.+?)(?<=\\S)\\1", "$2"))


def strip_front_matter(t: Column) -> Column:
    return F.regexp_replace(_text(t), "(?s)\\A---\\n.*?\\n---\\n", "")


# Numerals and keys.
def roman(s: Column) -> Column:
    """Value of a Roman numeral."""
    digit = lambda c: F.when(c == "i", 1).when(c == "v", 5).when(c == "x", 10).when(c == "l", 50).when(c == "c", 100).otherwise(0)
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("most"))
    step = lambda a, c: F.struct((a["total"] + F.when(digit(c) >= a["most"], digit(c)).otherwise(-digit(c))).alias("total"), F.greatest(a["most"], digit(c)).alias("most"))
    return F.aggregate(F.reverse(F.split(F.lower(_text(s)), "")), start, step, lambda a: a["total"])


def cn_int(s: Column) -> Column:
    """Value of a Chinese numeral up to 99, or of digits; -1 for others."""
    s = stripped(s)
    one = lambda c: F.when(F.length(c) == 1, F.position(c, F.lit("一二三四五六七八九"))).otherwise(F.lit(0))
    tens, ones = F.substring_index(s, "十", 1), F.substring_index(s, "十", -1)
    return (
        F.when(s == "", -1)
        .when(s.rlike("^[0-9]+$"), s.cast("int"))
        .when(s.rlike("^[一二三四五六七八九]$"), one(s))
        .when(s.startswith("十"), 10 + one(F.substring(s, 2, 1)))
        .when(F.contains(s, F.lit("十")), one(tens) * 10 + one(ones))
        .otherwise(-1)
    )


def section_number(title: Column) -> Column:
    """Number at a title's start, with dots; '' if there is none. The first matching form counts."""
    s = stripped(title)
    forms = [
        "^\\s*([0-9]+(?:[.\\-][0-9]+)+)",
        "^\\s*第\\s*([0-9]+)\\s*章",
        "(?i)^\\s*(?:Chapter|Chap\\.?|Ch\\.)\\s*([0-9]+)",
        "(?i)^\\s*(?:Appendix|App\\.?)\\s*([A-Z](?:[.\\-][0-9]+)?)",
        "^\\s*([A-Z](?:[.\\-][0-9]+)+)\\s",
        "^\\s*([0-9]+)\\s*[.、)]",
        "^\\s*([0-9]+)\\s*$",
    ]
    found = [F.nullif(F.regexp_extract(s, f, 1), F.lit("")) for f in forms]
    return F.coalesce(F.replace(F.coalesce(*found), F.lit("-"), F.lit(".")), F.lit(""))


def normalised_path(p: Column) -> Column:
    """A relative path without '.', '..' and backslashes."""
    parts = F.split(F.replace(_text(p), F.lit("\\"), F.lit("/")), "/")
    empty = F.array().cast("array<string>")
    step = lambda a, x: F.when((x == "") | (x == "."), a).when(x == "..", F.when(F.size(a) > 0, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)).otherwise(F.concat(a, F.array(x)))
    return F.array_join(F.aggregate(parts, empty, step), "/")
