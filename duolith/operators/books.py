"""Whole books: title collectors, document order, section maps, gates, products read back, split requests."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duolith.functions import text as T
from duolith.operators import structure as B
from duolith.operators.groups import by_group
from duolith.operators.matching import first_of

#: Uses of a style class above which it marks no headings, and the longest text that a class makes one.
MOST_USES, LONGEST = 120, 80


def styled_headings(blocks: DataFrame, classes: DataFrame, most: int = MOST_USES) -> DataFrame:
    """Blocks (book, spine_idx, path, pos, type, level, text, cls) that only their style class (book, cls, why) makes headings.

    Of several classes the first known one counts; a class that is used more than
    `most` times marks no headings.
    """
    s = T.stripped(F.col("text"))
    plain = blocks.where((F.col("type") != "heading") & (F.length(s) <= LONGEST) & T.looks_like_heading(F.col("text")))
    each = plain.select("book", "spine_idx", "path", "pos", "level", "text", F.posexplode(F.split("cls", "\\s+")).alias("_n", "cls")).join(classes, ["book", "cls"])
    hits = first_of(each, ["book", "spine_idx", "pos"], ["_n"]).drop("_n")
    return hits.withColumn("_uses", F.count("*").over(Window.partitionBy("book", "cls"))).where(F.col("_uses") <= most).drop("_uses")


def title_candidates(toc: DataFrame, titles: DataFrame, blocks: DataFrame, classes: DataFrame, most: int = MOST_USES) -> DataFrame:
    """Candidate headings of four sources: book, src (S1 contents, S3 title, S4 body), path, level, text, spine.

    toc: book, spine_idx, path, level, title; titles: book, spine_idx, path, title.
    """
    level = F.when(F.col("level") > 0, F.col("level")).otherwise(1)
    row = lambda df, src, lv, text: df.select("book", F.lit(src).alias("src"), "path", lv.cast("int").alias("level"), T.stripped(F.col(text)).alias("text"), F.col("spine_idx").alias("spine"))
    out = row(toc, "S1", F.col("level"), "title").unionByName(row(titles, "S3", F.lit(1), "title"))
    return out.unionByName(row(blocks.where("type = 'heading'"), "S4", level, "text")).unionByName(row(styled_headings(blocks, classes, most), "S4", level, "text"))


def document_order(blocks: DataFrame, classes: DataFrame, most: int = MOST_USES) -> DataFrame:
    """Headings of each book in document order: by document, marked ones before those found by style, then by place: ord from 0."""
    marked = blocks.where("type = 'heading'").withColumns({"_rank": F.lit(0), "why": F.lit("tag")})
    styled = styled_headings(blocks, classes, most).withColumns({"_rank": F.lit(1), "why": F.concat(F.lit("css ."), "cls")})
    columns = ["book", "spine_idx", "path", "pos", F.when(F.col("level") > 0, F.col("level")).otherwise(1).alias("level"), T.stripped(F.col("text")).alias("text"), "why", "_rank"]
    both = marked.select(*columns).unionByName(styled.select(*columns))
    w = Window.partitionBy("book").orderBy("spine_idx", "_rank", "pos")
    return both.withColumn("ord", F.row_number().over(w) - 1).drop("_rank")


# Titles that open a unit though no other rule says so.
LONE_TITLES = ["preface", "foreword", "introduction", "contents", "references", "bibliography", "index", "appendix", "notes", "glossary", "acknowledgments", "前言", "序", "目录", "参考文献", "索引", "附录", "注释"]


def looks_like_unit(title: Column) -> Column:
    """Q10: whether a title looks like a unit of its own, whatever the splitting rules make of it."""
    t = F.regexp_replace(T.stripped(title), "[:：]+$", "")
    known = F.lower(t).isin([*B.FRONT_TITLES, *B.BACK_TITLES, *LONE_TITLES]) | t.rlike(B.SKIPPED)
    return (t != "") & (F.length(t) <= 80) & (T.is_heading_line(t, "zh") | T.is_heading_line(t, "en") | known)


def unopened(heads: DataFrame, opened: DataFrame, key: Sequence[str]) -> DataFrame:
    """Q10: headings that look like units but open none."""
    return heads.where(looks_like_unit(F.col("text"))).join(opened.select(*key).distinct(), list(key), "left_anti")


# ---------------------------------------------------------------- section maps


Unit = tuple[list[int], list[int]]


def with_orphans(units: list[Unit], side: int, n: int) -> list[Unit]:
    """Places of one side that no unit has, as units of their own after the last unit that lies before them."""
    out = list(units)
    have = {x for u in out for x in u[side]}
    for x in range(n):
        if x not in have:
            at = max((i + 1 for i, u in enumerate(out) if u[side] and max(u[side]) < x), default=len(out))
            out.insert(at, ([], [x]) if side else ([x], []))
    return out


def coalesced(units: list[Unit], n: int, m: int) -> list[Unit]:
    """Neighbouring units that share a target become one, without repeats; what is left over is put in order."""
    out: list[Unit] = []
    for a, b in units:
        a, b = list(dict.fromkeys(a)), list(dict.fromkeys(b))
        if out and set(b) & set(out[-1][1]):
            out[-1] = list(dict.fromkeys(out[-1][0] + a)), list(dict.fromkeys(out[-1][1] + b))
        else:
            out.append((a, b))
    return with_orphans(with_orphans(out, 1, m), 0, n)


def one_sided_merged(units: list[Unit]) -> list[Unit]:
    """Units with one side only join the unit before, if that has both."""
    out: list[Unit] = []
    for a, b in units:
        if out and not (a and b) and out[-1][0] and out[-1][1]:
            out[-1] = out[-1][0] + a, out[-1][1] + b
        else:
            out.append((list(a), list(b)))
    return out


def claimed_pairs(wants: Sequence[Sequence[int]], m: int) -> list[Unit]:
    """Each source in order gets the targets it wants that nobody has; targets left alone stand where they are passed."""
    out: list[Unit] = []
    taken: set[int] = set()
    passed = 0
    for i, want in enumerate(wants):
        got = sorted(set(want) - taken)
        if got:
            out += [([], [j]) for j in range(passed, got[0]) if j not in taken]
            taken |= {*range(passed, got[0]), *got}
            passed = max(passed, got[-1] + 1)
        out.append(([i], got))
    return out + [([], [j]) for j in range(m) if j not in taken]


def section_units(links: DataFrame, src: DataFrame, tgt: DataFrame, key: str, *, merge_one_sided: bool = False) -> DataFrame:
    """Paragraph links (key, src, tgt) to units of sections: key, unit, src_secs, tgt_secs.

    src and tgt: key, idx, sec of every paragraph. A source section has the target
    sections that its paragraphs are linked to; neighbours that share one are merged.
    """
    kind = dict(src.dtypes)[key]
    sec = lambda df, name, i: df.select(key, F.col("idx").alias(i), F.col("sec").cast("int").alias(name))
    pairs = links.join(sec(src, "a", "src"), [key, "src"]).join(sec(tgt, "b", "tgt"), [key, "tgt"]).select(key, "a", "b")
    last = lambda df, name: df.groupBy(key).agg(F.max("sec").cast("int").alias(name))
    sizes = last(src, "a").join(last(tgt, "b"), key, "full_outer").select(key, F.lit(0).alias("_part"), "a", "b")
    rows = sizes.unionByName(pairs.distinct().withColumn("_part", F.lit(1)))

    def run(name, found: list[tuple]) -> Iterator[tuple]:
        (_, n, m), *told = found
        n, m = (-1 if n is None else n) + 1, (-1 if m is None else m) + 1
        units = coalesced([([i], sorted(b for _, a, b in told if a == i)) for i in range(n)], n, m)
        for i, (a, b) in enumerate(one_sided_merged(units) if merge_one_sided else units):
            yield name, i, a, b

    return by_group(rows, key, ["_part", "a", "b"], ["_part", "a", "b"], run, f"{key} {kind}, unit int, src_secs array<int>, tgt_secs array<int>")


# ---------------------------------------------------------------- gates


def section_gates(pairs: DataFrame, key: str, *, unit: str = "han", low: float = 1.0, high: float = 3.0, plain: Column | None = None) -> DataFrame:
    """What speaks for a second opinion on a section's pairs (key, src, tgt, src_text, tgt_text).

    slack: targets more than sources; prose_bad: pairs of running text whose length
    ratio is out of range; narrow: so plain that the alignment decides alone; why:
    signs that its structure is wrong. plain says what running text is; without it,
    neither side may look like mathematics or code.
    """
    s, t = F.size("src"), F.size("tgt")
    a, b = (F.coalesce(c, F.lit("")) for c in ("src_text", "tgt_text"))
    mathy = lambda x: x.rlike(T.MATHY)
    codeish = lambda x: T.is_codeish(x) if unit == "han" else x.rlike(T.CODEY)
    mass = T.han_chars(b) if unit == "han" else T.en_words(b)
    plain = ~mathy(a) & ~mathy(b) & ~(a.rlike(T.CODEY) if unit != "han" else T.is_codeish(a)) & ~codeish(b) if plain is None else plain
    bad = (s > 0) & (t > 0) & plain & ~(mass / F.greatest(F.lit(1), T.en_words(a))).between(low, high)
    count = lambda c: F.count_if(c)
    out = pairs.groupBy(key).agg(
        F.count("*").alias("n_pairs"), F.sum(s).alias("n_src"), F.sum(t).alias("n_tgt"), count((s > 0) & (t == 0)).alias("only_src"), count((t > 0) & (s == 0)).alias("only_tgt"),
        count((s > 1) | (t > 1)).alias("multi"), F.sum(F.when(mathy(b), t).otherwise(0)).alias("_mathy"), count(bad).alias("prose_bad"),
    )
    narrow = (F.abs(F.col("n_src") - F.col("n_tgt")) <= 1) & (F.col("multi") == 0) & (F.col("only_src") + F.col("only_tgt") == 0) & (F.col("_mathy") <= 0.3 * F.col("n_tgt"))
    blocks = (F.col("n_src") > 0) & (F.abs(F.col("n_src") - F.col("n_tgt")) / F.greatest(F.lit(1), F.col("n_src")) > 0.08)
    why = F.concat_ws("+", F.when(blocks, "blocks"), F.when(F.col("only_src") > 0, "only_src"), F.when(F.col("only_tgt") > 0, "only_tgt"), F.when(F.col("multi") / F.col("n_pairs") > 0.25, "multi"))
    return out.withColumns({"slack": F.col("n_tgt") - F.col("n_src"), "narrow": narrow, "why": why}).drop("_mathy")


# ---------------------------------------------------------------- products, requests


def product_rows(docs: DataFrame) -> DataFrame:
    """Headings and paragraphs of rendered documents (book, spine_idx, html): book, spine_idx, pos, side (head, src or tgt), text."""
    part = "(?is)<h[1-6]\\b[^>]*>.*?</h[1-6]>|<p class=\"(?:src|tgt)\"[^>]*>.*?</p>"
    rows = docs.select("book", "spine_idx", F.posexplode(F.regexp_extract_all("html", F.lit(part), F.lit(0))).alias("pos", "t"))
    side = F.when(F.col("t").rlike("(?i)^<h"), "head").otherwise(F.regexp_extract("t", "class=\"(src|tgt)\"", 1))
    return rows.select("book", "spine_idx", "pos", side.alias("side"), T.without_tags(F.col("t")).alias("text"))


def bisected(requests: DataFrame, most: int, depth: int = 4) -> DataFrame:
    """Requests (key, n, m) whose n is above `most` in halves of both lists, in proportion: key, src_low, src_high, tgt_low, tgt_high.

    Lists of four or fewer aren't split, nor any more than `depth` times.
    """
    kept = [c for c in requests.columns if c not in ("n", "m")]
    zero = F.lit(0)
    rows = requests.select(*kept, zero.alias("src_low"), F.col("n").cast("int").alias("src_high"), zero.alias("tgt_low"), F.col("m").cast("int").alias("tgt_high"))
    for _ in range(depth):
        n, m = F.col("src_high") - F.col("src_low"), F.col("tgt_high") - F.col("tgt_low")
        a = F.floor(n / 2).cast("int")
        b = F.greatest(F.lit(1), F.least(m - 1, F.bround(m * a / n).cast("int")))
        piece = lambda p, q, r, s: F.struct(p.alias("src_low"), q.alias("src_high"), r.alias("tgt_low"), s.alias("tgt_high"))
        whole = piece(*(F.col(c) for c in ("src_low", "src_high", "tgt_low", "tgt_high")))
        first = piece(F.col("src_low"), F.col("src_low") + a, F.col("tgt_low"), F.col("tgt_low") + b)
        second = piece(F.col("src_low") + a, F.col("src_high"), F.col("tgt_low") + b, F.col("tgt_high"))
        rows = rows.select(*kept, F.explode(F.when((n > most) & (n > 4) & (m > 4), F.array(first, second)).otherwise(F.array(whole))).alias("_p")).select(*kept, "_p.*")
    return rows


def merged_answers(answers: DataFrame, key: str) -> DataFrame:
    """Answers of parts (key, src_low, tgt_low, src, tgt with places of the part) in places of the whole, each once."""
    shift = lambda c, low: F.transform(c, lambda x: x + F.col(low))
    return answers.select(key, shift("src", "src_low").alias("src"), shift("tgt", "tgt_low").alias("tgt")).distinct()


def retry_plan(calls: DataFrame, most_tries: int = 5, most_wait: float = 12.0) -> DataFrame:
    """Calls (…, status, tries) with what comes next: done, retry after a wait that doubles up to most_wait, or failed."""
    again = F.col("status").isin(429) | (F.col("status") >= 500)
    step = F.when(F.col("status") < 400, "done").when(again & (F.col("tries") < most_tries), "retry").otherwise("failed")
    wait = F.when(step == "retry", F.least(F.lit(most_wait), F.pow(F.lit(2.0), F.col("tries") - 1)))
    return calls.withColumns({"next": step, "wait": wait})


def with_known(work: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Results that are stored under a request's key, and the requests that are to be made, each once."""
    results = work.join(known, key, "left_semi").select(key).join(known, key)
    return results, work.join(known.select(key), key, "left_anti").dropDuplicates([key])


def reconciled(expected: DataFrame, made: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that failed (no row, or an error in column `error`) among those expected; the caller refuses to go on if there are any."""
    both = expected.select(*key).distinct().join(made.select(*key, "error", F.lit(1).alias("_made")), list(key), "left")
    why = F.when(F.col("_made").isNull(), "missing").when(F.col("error").isNotNull(), F.col("error"))
    return both.select(*key, why.alias("failure")).where("failure is not null")


def job_states(events: DataFrame, job: str, order: Sequence[str]) -> DataFrame:
    """Of each job's progress events (job, state, done, total) the last, with the share done."""
    last = first_of(events, [job], [F.desc(c) for c in order])
    return last.withColumn("share", F.when(F.col("total") > 0, F.col("done") / F.col("total")).otherwise(0.0))


def top_rows(df: DataFrame, score: str, ties: Sequence[str], n: int) -> DataFrame:
    """K3: the n rows of highest score, in order; ties go by the given columns."""
    return df.orderBy(F.desc(score), *ties).limit(n)


def signal_algebra(a: Column, b: Column) -> dict[str, Column]:
    """Common, lost, new and all signals of two arrays."""
    return {"common": F.array_sort(F.array_intersect(a, b)), "lost": F.array_sort(F.array_except(a, b)), "new": F.array_sort(F.array_except(b, a)), "all": F.array_sort(F.array_union(a, b))}
