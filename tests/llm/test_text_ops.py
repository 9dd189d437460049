"""HTML, chat, classifiers, lines, near copies and the pipeline against plain definitions."""

import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from duolith.llm import chat, common, html_text, langid, linededup, omh, quality


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


# ---------------------------------------------------------------- HTML

PAGES = [
    ("<p>One <b>two<br>three<p>four &amp; five", "One two\nthree\n\nfour & five"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>end", "- a\n- b\n\n  - c\n\nend"),
    ("<ol start=3><li>x</li><li>y</ol>", "3. x\n4. y"),
    ("<table><caption>Cap</caption><tr><th>Name<th>N<tr><td>alpha<td>10</table>tail", "Cap\nName   N\nalpha  10\n\ntail"),
    ("<pre>\n a  b\n   c</pre>x  y", " a  b\n   c\n\nx y"),
    ("<style>.no{display:none}</style><div class=no>gone</div><span hidden>no</span><p style='display: none'>no</p>yes", "yes"),
    ("<script>var t='</p>';</script><!-- x --><p>shown</p>", "shown"),
    ("<head><title>t</title></head><body>b</body>", "b"),
    ("", ""),
    ("plain", "plain"),
    ("<table><tr>stray<td>x</table>", "stray\nx"),
    ("<style>@media print{.x{display:none}} @media screen and (max-width:600px){p{display:none}}</style><p class=x>shown", "shown"),
    ("<style>@media screen{.x{display:none}}.y{display:none}.y{display:block}#z{display:inline}.z{display:none}</style><p class=x>gone<p class=y>on<p id=z class=z>id", "on\n\nid"),
    ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b>c</div>", "b"),
    ("<div style='display:none'><b style='display:block;visibility:visible'>b</b></div>x", "x"),
    ("<table><tr><td rowspan=2>A<td>b<tr><td>c</table>", "A  b\n   c"),
    ("<table><tr><th colspan=2>long heading<th>n<tr><td>a<td>b<td>1<tr><td rowspan=0>d<td>e</table>", "long heading  n\na  b          1\nd  e"),
    ("<a title='x > y'>t</a><a b=\">u</a>", "tu"),
    ("1 < 2 <b", "1 < 2 <b"),
    ("<svg><title>no</title><text>in a drawing</text><path d='M0'/></svg><math><mi>x</mi></math><dialog>no</dialog>", "in a drawing x"),
]


@pytest.mark.parametrize("html,text", PAGES)
def test_visible_text(html, text):
    assert html_text.visible_text(html) == text


def test_deep_and_broken_html_loses_no_text():
    assert "deep" in html_text.visible_text("<div>" * 5000 + "deep")
    assert "x" in html_text.visible_text("<table><tr><td>" * 3000 + "x")
    dice = random.Random(2)
    bits = "< > / p div \" ' = td table a & &lt; <p> </p> <li> <ul> <table> <tr> <td> <pre> <!-- --> <script> </script>".split() + ["\n", " "]
    for _ in range(500):
        html_text.visible_text("".join(dice.choice(bits) for _ in range(40)))


@pytest.mark.parametrize("bit", ["<a ", "<a b='", "<a =\">\" ", "<!-", "<", "<p", "<table>", "&", "<style>{"])
def test_time_is_linear_in_broken_pages(bit):
    import time

    began = time.process_time()
    html_text.visible_text(bit * (300_000 // len(bit)))
    assert time.process_time() - began < 5


def page(dice, words, depth=0, seen=True, shown=True):
    """A random page and the words of it that show, by a direct reading of the rules."""
    parts, out = [], []
    for _ in range(dice.randint(1, 4)):
        kind = dice.choice(["text", "text", "text", "block", "inline", "none", "hidden", "visible", "list", "table", "comment", "script"])
        if kind == "text" or depth > 4:
            w = f"w{next(words)}"
            parts.append(f" {w} ")
            out += [w] * (seen and shown)
        elif kind in ("comment", "script"):
            parts.append(f"<!-- x{next(words)} -->" if kind == "comment" else f"<script>var x = '</p>{next(words)}'</script>")
        else:
            inside = lambda s=seen, sh=shown: page(dice, words, depth + 1, s, sh)
            if kind == "block":
                h, o = inside()
                t = dice.choice(["div", "section", "blockquote", "h2"])
                h = f"<{t}>{h}</{t}>"
            elif kind == "inline":
                h, o = inside()
                h = f"<b>{h}</b>"
            elif kind == "none":
                h, o = inside(sh=False)
                h = dice.choice(["<div hidden>{}</div>", "<div class=no>{}</div>", "<div style='display:none'>{}</div>"]).format(h)
            elif kind in ("hidden", "visible"):
                h, o = inside(s=kind == "visible")
                h = f"<div style='visibility: {kind}'>{h}</div>"
            else:
                each = [inside() for _ in range(dice.randint(1, 3))]
                o = [w for _, ws in each for w in ws]
                close = dice.random() < 0.5
                tag = "li" if kind == "list" else "td"
                h = "".join(f"<{tag}>{x}" + f"</{tag}>" * close for x, _ in each)
                h = f"<ul>{h}</ul>" if kind == "list" else "<table>" + h.replace("<td>", "<tr><td>") + "</table>" if depth == 0 else f"<ul>{h.replace('td>', 'li>')}</ul>"
            parts.append(h)
            out += o
    return "".join(parts), out


def test_visible_words_equal_a_direct_reading():
    import itertools

    for seed in range(400):
        html, want = page(random.Random(seed), itertools.count())
        got = html_text.visible_text("<style>.no { display: none }</style>" + html)
        assert [w for w in got.split() if w.startswith("w")] == want, (seed, html)


def test_extract_pages(spark):
    df = spark.createDataFrame([(1, "<p>a", "x"), (2, None, "y"), (2, None, "y")], "page_id bigint, html string, text string")
    assert sorted((r.page_id, r.text, r.n_lines) for r in html_text.extract(df).collect()) == [(1, "a", 1), (2, "", 0), (2, "", 0)]
    assert html_text.extract(df.limit(0)).count() == 0


# ---------------------------------------------------------------- chat


def test_formatting_round_trips_and_finds_spans():
    dice = random.Random(3)
    for _ in range(200):
        turns = [(dice.choice(["user", "assistant", "", "sys<"]), "".join(dice.choice("01[]<>/s\\ \nINST]") for _ in range(dice.randint(0, 20)))) for _ in range(dice.randint(0, 100))]
        out = chat.format_conversation(turns)
        assert chat.read_turns(out["formatted"]) == turns and not out["rewrites_history"]
        assert [chat.unescaped(out["formatted"][a:b]) for a, b in out["loss"]] == [t for r, t in turns if r == "assistant"]


def test_templates_that_rewrite_history_are_found():
    def render(turns):
        return "".join(f"<{r}>{x if i == len(turns) - 1 or r != 'assistant' else x.upper()}" for i, (r, x) in enumerate(turns))

    out = chat.format_conversation([("user", "hi"), ("assistant", "yo"), ("user", "x")], render)
    assert out["rewrites_history"] and [out["formatted"][a:b] for a, b in out["loss"]] == ["YO"]


def test_long_conversations_keep_their_whole_history():
    def numbered(turns):
        return "<bos>" + "".join(f"{i}<{r}>{x}" for i, (r, x) in enumerate(turns))

    def folded(turns):
        return "".join(f"<{r}>{x if len(turns) <= 70 or i else '...'}" for i, (r, x) in enumerate(turns))

    turns = [("assistant" if i % 2 else "user", f"t{i}") for i in range(150)]
    for render, rewrites in ((numbered, False), (folded, True)):
        out = chat.format_conversation(turns, render)
        assert (out["formatted"], out["rewrites_history"]) == (render(turns), rewrites)
        assert [out["formatted"][a:b] for a, b in out["loss"]] == [x for r, x in turns if r == "assistant"]


def test_false_claims_of_a_template_are_found():
    turns = [("user", "a"), ("assistant", "b")] * 60
    for render in (lambda t: "".join(f"{i}<{r}>{x}" for i, (r, x) in enumerate(t)), lambda t: "".join(f"<{r}>{x if i == len(t) - 1 else ''}" for i, (r, x) in enumerate(t))):
        with pytest.raises(ValueError, match="claims"):
            chat.format_conversation(turns, chat.ChatFormat(render, chat.read_turns, chat.unescaped, alone=True))


def test_digests_read_back_a_template_that_rewrites_history(spark):
    """From turn 101 on this one writes the first turn in another way, so no turn's own output can be kept."""

    def render(turns):
        return "".join(f"<s>[{r}] {chat.escaped(x)}{'!' if len(turns) > 100 and i == 0 else ''} [/{r}]</s>\n" for i, (r, x) in enumerate(turns))

    rows = [(k, i, "assistant" if i % 2 else "user", f"t{i}<") for k, n in ((1, 120), (2, 90)) for i in range(n)]
    form = chat.ChatFormat(render, chat.read_turns, chat.unescaped)
    got = {r.conv_id: r for r in chat.digest_conversations(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), form).collect()}
    for k, n in ((1, 120), (2, 90)):
        turns = [(r, x + "!" * (k == 1 and i == 0)) for c, i, r, x in rows if c == k]
        learned = "".join(x for r, x in turns if r == "assistant")
        assert (got[k].n_turns, got[k].loss_sha256, got[k].rewrites_history) == (n, hashlib.sha256(learned.encode()).hexdigest(), k == 1)
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()


def test_digests_of_conversations(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a[1]"), (1, 2, None, None), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (None, 0, "assistant", "z")]
    rows += [(5, i, "assistant", f"t{i}") for i in range(200)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id bigint, turn bigint, role string, text string, n_turns string")
    got = {r.conv_id: r for r in chat.digest_conversations(df).collect()}
    assert len(got) == 4
    for key, r in got.items():
        turns = [(a or "", b or "") for c, _, a, b in rows if c == key]
        learned = "".join(t for a, t in turns if a == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.formatted_chars == len(chat.instruction_template(turns))
    formatted = chat.format_conversations(df).where("conv_id = 5").orderBy("turn").collect()
    assert "".join(r.formatted for r in formatted) == chat.instruction_template([("assistant", f"t{i}") for i in range(200)])
    assert [r.formatted[r.loss_start : r.loss_end] for r in formatted][:3] == ["t0", "t1", "t2"]
    assert chat.digest_conversations(df.limit(0)).count() == 0


# ---------------------------------------------------------------- classifiers


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, d, "documents"), common.table(spark, d, "labels")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.held_out == (fold(i, 5) == 0) and r.predicted == (r.score >= 0.3) for i, r in got.items())
    told = [(got[r.doc_id], r.quality) for r in labels.collect() if fold(r.doc_id, 5) == 0]
    assert np.mean([r.predicted == y for r, y in told]) > 0.97


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (2, "", 9.0), (None, "x y", 9.0)], "doc_id bigint, text string, score double")
    rows = quality.classify(docs, spark.createDataFrame([], "doc_id bigint, quality int")).collect()
    assert [r.score for r in rows] == [0.5] * 4
    assert quality.keep_good(docs.limit(0), spark.createDataFrame([], "doc_id bigint, quality int"), docs).count() == 0


def plain_features(text):
    """The stream of quality.py read word by word, and its hashed one- and two-grams, in dictionaries."""
    stream, last = [], ""
    for word in text.split():
        if word == last:
            stream.append(zlib.crc32(b"\0same"))
            continue
        last = word
        inner = [i for i, c in enumerate(word) if c.isalnum() or c == "_"]
        first, end = (inner[0], inner[-1] + 1) if inner else (len(word), len(word))
        stem = word[first:end]
        stream += [zlib.crc32(x.encode()) for x in (word[:first], stem.lower(), word[end:]) if x]
        if len(stem) > 1 and stem.isupper():
            stream.append(zlib.crc32(b"\0capitals"))
    mask, counts = (1 << 64) - 1, {}
    grams = [a * 0x9E3779B97F4A7C15 & mask for a in stream] + [(a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) & mask for a, b in zip(stream, stream[1:])]
    for g in grams:
        counts[g >> 44] = counts.get(g >> 44, 0) + 1
    return {at: (n / len(grams)) ** 0.5 for at, n in counts.items()}


def test_quality_equals_a_plain_reading(spark):
    """Features, updates and scores in dictionaries and floats."""
    dice = random.Random(6)
    texts = [" ".join(dice.choice(["Good", "text.", "good", "BAD", "bad!!", "and", "and", "(x)", "...", "é"]) for _ in range(dice.randint(0, 30))) for _ in range(60)]
    labels = [int("good" in t) for t in texts]
    z, n = {}, {}

    def weight(at):
        v = z.get(at, 0.0)
        return 0.0 if abs(v) <= 0.02 else -(v - (0.02 if v > 0 else -0.02)) / (1.0 + n.get(at, 0.0) ** 0.5 + 1e-3)

    rows = [plain_features(t) | {"bias": 1.0} for t in texts]
    order = np.random.default_rng(7)
    for _ in range(4):
        for i in order.permutation(len(rows)):
            w = {at: weight(at) for at in rows[i]}
            p = 1 / (1 + np.exp(-sum(w[at] * x for at, x in rows[i].items())))
            for at, x in rows[i].items():
                g = (p - labels[i]) * x
                z[at] = z.get(at, 0.0) + g - ((n.get(at, 0.0) + g * g) ** 0.5 - n.get(at, 0.0) ** 0.5) * w[at]
                n[at] = n.get(at, 0.0) + g * g
    weights = quality.train(texts, labels)
    for t in [*texts, "", "new words Good"]:
        want = 1 / (1 + np.exp(-sum(weight(at) * x for at, x in (plain_features(t) | {"bias": 1.0}).items())))
        assert abs(quality.goodness(weights, t) - want) < 1e-4
    got = quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), weights).collect()
    assert all(abs(r.score - quality.goodness(weights, texts[r.doc_id])) < 1e-9 and r.predicted == int(r.score >= 0.3) for r in got)


def test_repeated_ids_teach_once(spark):
    rows = [(1, "b"), (1, "a"), (1, "a"), (2, None), (3, "c")]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id int, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 0)], "doc_id int, quality int")
    held = lambda i, n, k: fold(i, n) == k
    assert sorted(r.text for r in quality.labelled_sample(docs, labels).collect()) == sorted(t for i, t in ((1, "a"), (2, "")) if not held(i, 5, 0))
    assert sorted(r.text for r in langid.training_sample(docs).collect()) == sorted(t for i, t in ((1, "a"), (3, "c")) if not held(i, 4, 2))


def plain_subwords(text):
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            raw = b" " + word.encode() + b" "
            for n in langid.GRAMS:
                for i in range(len(raw) - n + 1):
                    h = raw[i]
                    for b in raw[i + 1 : i + n]:
                        h = (h * 0x100000001B3 + b) % (1 << 64)
                    out.append(((h * 0x9E3779B97F4A7C15 + n) * 0xD6E8FEB86659FD93) % (1 << 64) >> 64 - langid.BITS)
            word = ""
    return out


def test_language_equals_a_plain_reading():
    """Subwords letter by letter, the mean of their logits, the softmax of it."""
    dice = random.Random(7)
    m = langid.Model(["a", "b", "c"], np.random.default_rng(1).normal(size=(langid.BUCKETS, 3)).astype(np.float32), np.array([0.1, 0.0, -0.1], np.float32), 0.7, 0.2)
    for _ in range(200):
        text = "".join(dice.choice("abcXYZ éßñ漢 ½²①Ⅷ12_-.,\n") for _ in range(dice.randint(0, 40)))
        ids = plain_subwords(text)
        assert sorted(langid.subwords(text).tolist()) == sorted(ids)
        got = langid.predict(m, text)
        if not any(c.isalpha() for c in text):
            assert got == ("und", 0.0)
            continue
        raw = [(sum(float(m.logits[i, k]) for i in ids) / len(ids) + float(m.bias[k])) / m.heat for k in range(3)]
        e = [np.exp(x - max(raw)) for x in raw]
        best = e.index(max(e))
        assert got[0] == m.languages[best] and abs(got[1] - e[best] / sum(e)) < 1e-6


def test_training_follows_the_gradient():
    """A step on the embeddings is the gradient of the mean's loss, by differences."""
    texts, langs = ["hello there you", "bonjour vous"] * 4, ["en", "fr"] * 4
    m = langid.train(texts * 6, langs * 6)
    assert [langid.predict(m, t)[0] for t in texts[:2]] == ["en", "fr"]
    many = [f"l{i}" for i in range(300)]
    model = langid.train([f"{chr(97 + i % 26)}{chr(97 + i // 26)}qx " * 3 for i in range(300) for _ in range(2)], [x for x in many for _ in range(2)], passes=1)
    assert len(model.languages) == 300


def test_language_on_held_out_rows(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    want = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in want if fold(i, 4) == 2]
    assert all(got[i].held_out for i in held) and np.mean([got[i].lang_pred == want[i] for i in held]) > 0.95


def test_language_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "123 !?", "en"), (3, "hello there", "en"), (4, "bonjour là", "fr")], "doc_id bigint, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.accepted) for r in langid.identify(docs, langid.train(["hello there you"] * 9 + ["bonjour là vous"] * 9, ["en"] * 9 + ["fr"] * 9)).collect()}
    assert got[1] == got[2] == ("und", False) and got[3][0] == "en" and got[4][0] == "fr"
    none = docs.select("doc_id", "text").selectExpr("*", "cast(null as string) lang")
    assert {r.lang_pred for r in langid.identify(none).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- lines


@pytest.mark.parametrize("edits", [1, 2, 3, 4])
def test_bit_parallel_distance(spark, edits):
    from pyspark.sql import functions as F

    dice = random.Random(edits)
    pairs = [("", ""), ("", "a"), ("ab", "ab")]
    for _ in range(150):
        a = [dice.choice("abé") for _ in range(dice.randint(0, 20))]
        b = list(a)
        for _ in range(dice.randint(0, 5)):
            at = dice.randint(0, len(b))
            b[at : at + dice.randint(0, 1)] = [dice.choice("abé")] * dice.randint(0, 1)
        pairs.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", linededup.within(F.col("a"), F.col("b"), edits).alias("w")).collect():
        assert r.w == (distance(r.a, r.b) <= edits), r


def test_one_edit_takes_no_step_for_each_character(spark):
    """Long lines are compared by halving, without a step for each character."""
    from pyspark.sql import functions as F

    a = "né" * 20_000
    rows = [(a, a[:k] + x + a[k + cut :]) for k in (0, 1, 20_001, 39_999, 40_000) for x in ("", "z") for cut in (0, 1)] + [(a, "z" + a[:-1] + "y")]
    df = spark.createDataFrame(rows, "a string, b string").select(linededup.within(F.col("a"), F.col("b"), 1).alias("w"))
    assert [r.w for r in df.collect()] == [True] * (len(rows) - 1) + [False]
    assert "arrays_zip" not in df._jdf.queryExecution().optimizedPlan().toString()


def mutated(dice, s, n):
    s = list(s)
    for _ in range(n):
        at = dice.randint(0, len(s))
        s[at : at + dice.randint(0, 1)] = [dice.choice("abcdefgh")] * dice.randint(0, 1)
    return "".join(s)


@pytest.mark.parametrize("edits,bases", [(1, 12), (1, 1), (2, 8)])
def test_line_dedup_equals_brute_force(spark, edits, bases):
    dice = random.Random(bases)
    base = ["".join(dice.choice("abcdefgh ij") for _ in range(dice.randint(18, 60))) for _ in range(bases)]
    rows = []
    for d in range(50):
        kinds = [dice.random() for _ in range(dice.randint(0, 6))]
        rows.append((d, "\n".join("" if k < 0.1 else mutated(dice, dice.choice(base), int(k * 4)) if k < 0.8 else "x" * dice.randint(1, 3) for k in kinds)))
    rows += [(100, None), (101, ""), (102, rows[0][1]), (102, rows[0][1])]
    first = {}
    for d, t in sorted({r for r in rows if r[0] is not None}, key=lambda r: r[0]):
        for i, line in enumerate((t or "").split("\n")):
            if line.strip(" "):
                first.setdefault(line.strip(" "), (d, i))
    links = {f: [g for g in first if g != f and min(len(f), len(g)) >= 20 and distance(f, g) <= edits] for f in first}
    rows += [(None, rows[1][1]), (None, "only here in a row without id")]
    df = spark.createDataFrame([(*r, "e", 0, "f") for r in rows], "doc_id bigint, text string, n_links string, _doc int, n_lines string")
    assert linededup.without_copied_lines(df).columns == df.columns
    df = df.select("doc_id", "text", "n_links", "_doc")
    got = linededup.clean(df, edits=edits).collect()
    assert len(got) == len(rows)
    assert sorted(r.text or "" for r in got if r.doc_id is None)[-1].endswith("without id")
    for r in (r for r in got if r.doc_id is not None):
        t = dict(rows)[r.doc_id]
        keep = []
        for i, line in enumerate((t or "").split("\n")):
            f = line.strip(" ")
            if not f or first[f] == (r.doc_id, i) and not any(first[g] < first[f] for g in links[f]):
                keep.append(line)
        assert r.text == (None if t is None else "\n".join(keep))
    assert linededup.clean(df.limit(0)).count() == 0


def test_hot_long_lines_meet_by_finer_cuts(spark):
    """Forty lines of 700 characters that differ in one place each, and as many that differ in two: only the former link."""
    base = "".join(random.Random(3).choice("abcdefgh ") for _ in range(700))
    one = [base[:k] + "#" + base[k + 1 :] for k in range(100, 140)]
    two = [base[:300] + f"{k % 10}" + base[301:400] + f"{k // 10}" + base[401:] + "!" for k in range(40)]
    lines = [base, *one, *two]
    want = [sum(distance(a[90:150] + a[290:], b[90:150] + b[290:]) == 1 if abs(len(a) - len(b)) <= 1 and a != b else 0 for b in lines) if len(a) < 700 or i < 3 else None for i, a in enumerate(lines)]
    got = {r.doc_id: r for r in linededup.clean(spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")).collect()}
    assert got[0].n_links == 40 and all(got[i].n_links == 1 for i in range(1, 41)) and want[0] == 40
    for i in range(41, 81):
        assert got[i].n_links == sum((i - 41) % 10 == (j - 41) % 10 or (i - 41) // 10 == (j - 41) // 10 for j in range(41, 81) if j != i)


# ---------------------------------------------------------------- near copies


def test_banded_alignment():
    dice = random.Random(1)
    for _ in range(1500):
        a = [dice.choice("abcdef") for _ in range(dice.randint(0, 25))]
        b = list(mutated(dice, a, dice.randint(0, 8)))
        most = dice.randint(0, 8)
        x, y = (omh.word_hashes(omh.plain(" ".join(w))) for w in (a, b))
        assert omh.edits_within(x, y, most) == (distance(a, b) <= most)


def corpus(dice):
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = [dice.choice(words) for _ in range(dice.randint(60, 300))]
        for k in range(dice.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(len(copy) // 60 * (k > 0)):
                copy[dice.randrange(len(copy))] = dice.choice(words)
            texts.append(" ".join(copy))
    hot = [dice.choice(words) for _ in range(120)]
    for _ in range(70):  # a group above MOST
        copy = list(hot)
        copy[dice.randrange(120)] = dice.choice(words)
        texts.append(" ".join(copy))
    shared = " ".join(dice.choice(words) for _ in range(60))
    texts += [shared + " " + " ".join(dice.choice(words) for _ in range(80)) for _ in range(60)]
    return texts


def test_near_classes_equal_brute_force(spark):
    texts = corpus(random.Random(4))
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(900, texts[0].upper(), 0), (901, None, 0), (902, "", 0), (903, "?!", 0), (904, texts[3], 0), (904, texts[3], 0), (None, texts[0], 0)]
    got = omh.near_classes(spark.createDataFrame(rows, "doc_id bigint, text string, class_id int")).collect()
    assert len(got) == len(rows)
    label = {r.doc_id: r.class_id for r in got}
    ids = [i for i, *_ in rows if i is not None]
    text = {i: t or "" for i, t, _ in rows}
    best = {i: i for i in ids}

    def root(i):
        while best[i] != i:
            i = best[i]
        return i

    ordered = sorted(set(ids))
    for n, a in enumerate(ordered):
        for b in ordered[n + 1 :]:
            if root(a) != root(b) and omh.similar(text[a], text[b]):
                lo, hi = sorted((root(a), root(b)))
                best[hi] = lo
    assert {i: label[i] for i in ordered} == {i: root(i) for i in ordered}
    assert label[None] is None


def test_crowded_groups_lose_no_pair(spark):
    """Two hundred texts on one template; their near copies share little but the template's k-mers."""
    dice = random.Random(8)
    word = lambda: f"w{dice.randrange(5000)}"
    shared = " ".join(word() for _ in range(130))
    rows = []
    for i in range(100):
        own = [word() for _ in range(42)]
        copy = [word() if k % 3 == 0 else w for k, w in enumerate(own)]
        rows += [(i, shared + " " + " ".join(own)), (1000 + dice.randrange(10**6) * 100 + i, shared + " " + " ".join(copy))]
    text = dict(rows)
    assert not any(omh.similar(text[0], text[i]) for i in range(1, 100))
    got = {r.doc_id: r.class_id for r in omh.near_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: i if i < 100 else (i - 1000) % 100 for i in text}


def test_near_copies_are_compared_once(spark, monkeypatch):
    """Copies that agree in many bands, under many least nodes, cost a comparison each, not one for each band."""
    dice = random.Random(12)
    base = [f"w{dice.randrange(5000)}" for _ in range(200)]
    rows = [(i, " ".join(f"x{dice.randrange(5000)}" if dice.random() < 0.04 else w for w in base)) for i in range(80)]
    sizes, verified = [], omh.verified
    monkeypatch.setattr(omh, "verified", lambda pairs, *a: sizes.append(pairs.count()) or verified(pairs, *a))
    got = {r.doc_id: r.class_id for r in omh.near_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == dict.fromkeys(range(80), 0)
    assert sum(sizes) < 160


def rows_of_joins(spark, run):
    """What run() gives, and the rows that the joins of its jobs made."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def ids():
        bus.waitUntilEmpty()
        told = store.executionsList()
        return {told.apply(i).executionId() for i in range(told.size())}

    before, out, rows = ids(), run(), 0
    for e in ids() - before:
        values, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for m in (node.metrics().apply(i) for i in range(node.metrics().size()) if "Join" in node.name()):
                told = values.get(m.accumulatorId())
                rows += int(told.get().replace(",", "")) if m.name() == "number of output rows" and told.isDefined() else 0
    return out, rows


def test_components(spark):
    """Chains, hubs with high and low ids and random links, against union-find."""
    dice = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(199, i) for i in range(100, 140)] + [(200, i) for i in range(201, 240)]
    links += [tuple(300 + dice.randrange(200) for _ in "ab") for _ in range(150)]
    order = dice.sample(range(500, 560), 60)
    links += zip(order, order[1:], strict=False)
    root = {i: i for pair in links for i in pair}
    for a, b in links:
        low, high = sorted((root[a], root[b]))
        root = {i: low if r == high else r for i, r in root.items()}
    linked = {i for a, b in links if a != b for i in (a, b)}
    got = omh.components(spark.createDataFrame(links + links[:9], "a bigint, b bigint")).collect()
    assert len(got) == len(linked) and {r.id: r.label for r in got} == {i: root[i] for i in linked}
    assert omh.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_links_of_a_crowd_are_joined_once(spark):
    """Each of 500 ids is linked to the least one and to five others: all links go in the first round."""
    dice = random.Random(5)
    links = {(0, i) for i in range(1, 500)} | {tuple(sorted(dice.sample(range(500), 2))) for _ in range(2500)}
    links = spark.createDataFrame(sorted(links), "a bigint, b bigint")
    got, rows = rows_of_joins(spark, lambda: omh.components(links).collect())
    assert {r.label for r in got} == {0} and 0 < rows <= 2 * links.count()


def test_a_filter_is_not_spelt_out_in_plans(spark):
    ids = spark.range(30_000).select("id")
    test = common.membership(ids.where("id % 3 = 0").select(F.xxhash64("id").alias("h")))(F.xxhash64("id"))
    held, rest = ids.where(test), ids.where(~test)
    assert held.where("id % 3 = 0").count() == 10_000 and held.count() + rest.count() == 30_000 and held.count() < 20_000
    assert len(held.unionByName(rest)._jdf.queryExecution().toString()) < 20_000


def test_staged_files_have_no_checksum_files(spark):
    # For each, Hadoop's local file system would start a process, which has the pages of the whole JVM while it starts.
    rows = spark.range(1000).repartition(3)
    told = common.staged(rows, "plain")
    folder = Path(told.inputFiles()[0].removeprefix("file://")).parent
    assert sorted(p.suffix for p in folder.iterdir()) == [".parquet"] * 3
    assert sorted(r["id"] for r in told.collect()) == list(range(1000))


def test_one_of_each_stays(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, "other words here now", "z"), (3, "other words here now", "z"), (None, "q", "q")], "doc_id bigint, text string, class_id string")
    assert sorted((r.doc_id or 0, r.class_id) for r in omh.keep_one(docs).collect()) == [(0, "q"), (1, "x"), (3, "z")]
    assert omh.keep_one(docs.limit(0)).count() == 0


def test_recall_of_near_copies(spark):
    """All pairs of sf0.001 and sf0.01 within a fifth of edits, found by comparing everything, share a class nearly always."""
    for name, least in (("sf0.001", 0.9), ("sf0.01", 0.9)):
        docs = common.table(spark, f"/root/testdata/{name}", "documents").select("doc_id", "text")
        rows = docs.collect()
        label = {r.doc_id: r.class_id for r in omh.near_classes(docs).collect()}
        words = {r.doc_id: omh.word_hashes(omh.plain(r.text or "")) for r in rows}
        bins = np.array([np.bincount((words[r.doc_id] % np.uint64(64)).astype(int), minlength=64) for r in rows])
        sizes, found, caught = np.array([len(words[r.doc_id]) for r in rows]), 0, 0
        for i in range(len(rows)):
            most = ((np.maximum(sizes[i], sizes[i + 1 :])) * 0.2 + 1e-9).astype(int)
            for j in np.flatnonzero(np.abs(bins[i] - bins[i + 1 :]).sum(1) <= 2 * most) + i + 1:
                a, b = rows[i].doc_id, rows[j].doc_id
                if omh.edits_within(words[a], words[b], omh.most_edits(max(sizes[i], sizes[j]), 0.8)):
                    found += 1
                    caught += label[a] == label[b]
        assert found > 20 and caught >= least * found, (name, found, caught)


# ---------------------------------------------------------------- pipeline


def test_pipeline_equals_plain_versions_of_its_stages(spark, tmp_path):
    """A small corpus with nulls, empty and repeated rows through every stage, against plain Python."""
    import corpus_pipeline

    dice = random.Random(12)
    say = {"en": "the quick brown fox jumps over a lazy dog while children watch from home".split(), "de": "der schnelle braune Fuchs springt über den faulen Hund und alle Kinder sehen zu".split()}
    docs, labels = [], []
    for i in range(240):
        lang, good = dice.choice(["en", "de"]), dice.random() < 0.7
        lines = [" ".join(dice.choice(say[lang]) for _ in range(9)) + ("." if good else " !!! BUY BUY NOW $$$ CLICK") for _ in range(4)]
        docs.append((i, "\n".join(lines), lang, "s", 0))
        labels.append((i, int(good), 0))
    base = docs[0][1].split()
    docs += [(1000 + k, " ".join(base[:20] + [f"w{k}"] + base[21:]), "en", "s", 0) for k in range(3)]
    docs += [(2000, None, None, None, 0), (2001, "", "en", "s", 0), (2002, docs[5][1], "en", "s", 0), (None, "the quick brown fox of nobody", "en", "s", 0), (2003, "123 456", "en", "s", 0), (2004, "the dog " * 3000, "en", "s", 0)]
    docs.append(docs[-1])
    d = str(tmp_path)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(docs, schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    now, key = common.table(spark, d, "documents"), lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    weights, model = quality.fit(now, common.table(spark, d, "labels")), langid.fit(now)

    def lines_kept(rows):
        ordered, first, near = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0)), {}, {}
        for r in ordered:
            for n, line in enumerate((r.text or "").split("\n")):
                if line.strip(" \t\r\f"):
                    first.setdefault(line.strip(" \t\r\f"), (r.doc_id, n))
        known = [f for f, (i, _) in first.items() if i is not None and len(f) >= 20 and len(f) < 2000]
        for f in known:
            near[f] = [g for g in known if g != f and abs(len(f) - len(g)) <= 1 and distance(f, g) <= 1]
        out = []
        for r in rows:
            keep = [x for n, x in enumerate((r.text or "").split("\n")) if not (f := x.strip(" \t\r\f")) or first[f] == (r.doc_id, n) and not any(first[g] < first[f] for g in near.get(f, ()))]
            out.append((r.doc_id, None if r.text is None else "\n".join(keep)))
        return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))

    def least_of_each(rows):
        ids = sorted({r.doc_id for r in rows if r.doc_id is not None})
        text, gone = {r.doc_id: r.text or "" for r in rows}, set()
        root = {i: i for i in ids}
        for n, a in enumerate(ids):
            for b in ids[n + 1 :]:
                if abs(len(text[a]) - len(text[b])) < 400 and omh.similar(text[a], text[b]):
                    x, y = root[a], root[b]
                    root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
        return sorted([i for i in ids if root[i] == i and i not in gone]) + [None] * sum(r.doc_id is None for r in rows)

    for name, stage in corpus_pipeline.STAGES:
        rows = sorted(now.collect(), key=key)
        out = common.staged(stage(spark, now, d), name)
        got = sorted(out.collect(), key=lambda r: key(r) if "text" in r else (0, r.doc_id or -1, r.start))
        if name == "quality":
            assert got == [r for r in rows if quality.goodness(weights, r.text or "") >= quality.THRESHOLD] and len(got) < len(rows)
        elif name == "language":
            sure = [langid.predict(model, r.text or "") for r in rows]
            assert got == [r for r, (lang, p) in zip(rows, sure, strict=True) if lang != "und" and p >= model.least]
        elif name == "lines":
            assert [(r.doc_id, r.text) for r in got] == lines_kept(rows) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
        elif name == "near_duplicates":
            assert [r.doc_id for r in got] == least_of_each(rows) and set(got) <= set(rows)
        else:
            assert {r.doc_id for r in got} == {r.doc_id for r in rows} and sum(r.length for r in got if r.start == 0) <= sum(r.doc_tokens for r in got if r.start == 0)
        now = out


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    d = str(tmp_path)
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = common.table(spark, sf_dir, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "lines", "near_duplicates", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.staged(stage(spark, docs, sf_dir), name)
        assert out.columns == docs.columns and out.select("doc_id").join(docs, "doc_id", "left_anti").count() == 0
        assert name != "lines" or out.count() == docs.count()
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()
