"""Registered queries of the engine over the driver's tables, with their SQL where there is one.

Each query applies an operator to whole tables. IDs of the inventory stand in the
docstrings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duolith.functions import kernels
from duolith.functions import text as T
from duolith.operators import alignment, audit, corpus, matching, usage
from duolith.operators import sequences as S
from duolith.operators import structure as B
from duolith.operators.groups import by_group
from duolith.plans import align_corpus as A
from duolith.plans.align_corpus import table
from duolith.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Tables that several statements begin with.
LINES = "lines AS (SELECT doc_id, pos, text FROM (SELECT doc_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)) WHERE trim(text) <> '')"
PARAS = LINES + ", paras AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS idx, text FROM lines)"
COPY = (
    PARAS
    + """, kept AS (SELECT *, CASE WHEN lag(idx) OVER w = idx - 1 AND lag((doc_id * 31 + idx) % 13) OVER w = 1 THEN idx - 1 ELSE idx END AS head
      FROM paras WHERE (doc_id * 31 + idx) % 17 <> 0 WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
    units AS (SELECT doc_id, head, list(idx ORDER BY idx) AS origin, string_agg(text, ' ' ORDER BY idx) AS text FROM kept GROUP BY ALL),
    copy AS (SELECT doc_id, origin, text, row_number() OVER (PARTITION BY doc_id ORDER BY head + CASE WHEN (doc_id * 31 + head) % 19 = 2 THEN 1.5 ELSE 0 END) - 1 AS idx FROM units),
    gold AS (SELECT doc_id, unnest(origin) AS src, idx AS tgt FROM copy)"""
)
WORDS = r"len(regexp_extract_all({}, '[^ \t\n\r\f\v]*[A-Za-z0-9][^ \t\n\r\f\v]*'))"


def words(c: str) -> str:
    return WORDS.format(c)


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def paras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.paragraphs(docs(spark, sf_dir))


# ---------------------------------------------------------------- text measures


@query(f"WITH {PARAS} SELECT doc_id, idx, len(regexp_extract_all(text, '[一-鿿]')) AS han, {words('text')} AS words, length(text) AS chars FROM paras")
def para_measures(spark, sf_dir):
    """lengths of each paragraph."""
    t = F.col("text")
    return paras(spark, sf_dir).select("doc_id", "idx", T.han_chars(t).alias("han"), T.en_words(t).alias("words"), F.length(t).alias("chars"))


NUMBERS = r"list_distinct(list_transform(list_filter(list_transform(regexp_extract_all({}, '[0-9][0-9,]*(?:\.[0-9]+)?'), lambda x: replace(x, ',', '')), lambda x: length(replace(x, '.', '')) >= 2), lambda x: CASE WHEN contains(x, '.') THEN rtrim(rtrim(x, '0'), '.') ELSE x END))"


@query(f"WITH {PARAS} SELECT doc_id, idx, array_to_string(list_sort({NUMBERS.format('text')}), ' ') AS numbers FROM paras")
def number_anchors(spark, sf_dir):
    """number anchors of each paragraph."""
    return paras(spark, sf_dir).select("doc_id", "idx", F.array_join(F.array_sort(T.numbers(F.col("text"))), " ").alias("numbers"))


STOP = "[" + ", ".join(f"'{w}'" for w in T.LEXICON_STOP) + "]"


@query(f"WITH {PARAS} SELECT doc_id, idx, array_to_string(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z]{{4,}}'), lambda x: lower(x)), lambda x: NOT list_contains({STOP}, x)), ' ') AS tokens FROM paras")
def content_tokens(spark, sf_dir):
    """content words with multiplicity."""
    return paras(spark, sf_dir).select("doc_id", "idx", F.array_join(T.en_tokens(F.col("text")), " ").alias("tokens"))


@query(f"""WITH {PARAS}, cut AS (SELECT doc_id, idx, list_filter(string_split_regex(text, '[。！？；!?;]+'), lambda s: trim(s, chr(32) || chr(9) || chr(10) || chr(13)) <> '')[1:14] AS parts FROM paras)
SELECT doc_id, idx, array_to_string(list_transform(parts, lambda s: greatest(1, {words('s')})), ' ') AS lengths FROM cut""")
def sentence_lengths(spark, sf_dir):
    """lengths of the first sentences."""
    return paras(spark, sf_dir).select("doc_id", "idx", F.array_join(T.sentence_lengths(F.col("text")), " ").alias("lengths"))


@query(f"""WITH {COPY}, a AS (SELECT doc_id, sum({words('text')}) AS w FROM paras GROUP BY 1), b AS (SELECT doc_id, sum({words('text')}) AS h FROM copy GROUP BY 1)
SELECT doc_id, cast(round(1000 * CASE WHEN w > 0 AND h > 0 THEN greatest(least(h / w, 2.25), 1.25) ELSE 1.85 END) AS bigint) AS k_thousandth FROM a JOIN b USING (doc_id)""")
def length_ratio(spark, sf_dir):
    """F8: target length for each source word, clamped."""
    a, b = A.editions(docs(spark, sf_dir))
    mass = lambda df, n: df.groupBy("doc_id").agg(F.sum(T.en_words(F.col("text"))).alias(n))
    both = mass(a, "w").join(mass(b, "h"), "doc_id").groupBy("doc_id").agg(T.estimate_k(F.col("h"), F.col("w")).alias("k"))
    return both.select("doc_id", F.round(F.col("k") * 1000).cast("bigint").alias("k_thousandth"))


NOTE = r"CASE WHEN length(text) = 0 THEN 0 ELSE greatest(CASE WHEN len(regexp_extract_all(text, '[A-Za-z]')) / length(text) > 0.30 THEN 1.0 WHEN len(regexp_extract_all(text, '[A-Za-z]')) / length(text) > 0.18 THEN 0.6 ELSE 0.0 END, CASE WHEN regexp_matches(left(text, 12), '参见|请参见|延伸阅读|注释|参考书目') THEN 0.8 ELSE 0 END, CASE WHEN regexp_matches(text, '\((?:19|20)[0-9]{2}\)|\bwww\.|\bhttps?://|accessed|Press,|\bed[s]?\.') THEN 0.9 ELSE 0 END) END"


@query(f"WITH {PARAS} SELECT doc_id, idx, cast(round(10 * ({NOTE})) AS bigint) AS note_tenths FROM paras")
def note_scores(spark, sf_dir):
    """likeness to a note."""
    return paras(spark, sf_dir).select("doc_id", "idx", F.round(10 * T.note_likeness(F.col("text"))).cast("bigint").alias("note_tenths"))


@query(rf"""WITH {PARAS}, s AS (SELECT doc_id, idx, trim(text) AS t FROM paras)
SELECT doc_id, idx,
 CASE WHEN t = '' THEN 'empty' WHEN len(regexp_extract_all(t, '[A-Za-z]{{3,}}')) <= 3 AND len(regexp_extract_all(t, '[A-Za-z]')) <= 16 THEN 'symbolic'
  WHEN regexp_matches(t, '\([0-9]{{4}}[a-z]?\)|\b(?:pp?\.|Vol\.|No\.|doi:|https?://|Retrieved from|eds?\.|In [A-Z][a-z]+,)\b|^\s*[A-Z][A-Za-z''\-]+,\s+[A-Z]\.') AND len(regexp_extract_all(t, '[A-Za-z]{{3,}}')) <= 60 THEN 'reference' ELSE '' END AS reason,
 regexp_matches(t, '^\s*\[\s*[0-9]{{1,3}}\s*\]\s+\S') AS note, regexp_matches(t, '^\s*\[[0-9]{{1,3}}\]|^\s*[①-⑳]') AS footnote,
 CASE WHEN t = '' THEN 'frag' WHEN regexp_matches(t, '^\s*[\[（(]?\s*[0-9]{{1,3}}\s*[\]）)]?\s+\S') THEN 'note' WHEN length(t) <= 12 THEN 'frag' ELSE '' END AS struct_kind FROM s""")
def paragraph_kinds(spark, sf_dir):
    """kinds of paragraphs."""
    t = F.col("text")
    return paras(spark, sf_dir).select("doc_id", "idx", T.no_translate_reason(t).alias("reason"), T.is_note(t).alias("note"), T.is_footnote(t).alias("footnote"), T.struct_kind(t).alias("struct_kind"))


@query(r"""WITH s AS (SELECT doc_id, text FROM documents)
SELECT doc_id, len(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z]{4,}'), lambda x: lower(x)), lambda x: NOT list_contains(""" + "[" + ", ".join(f"'{w}'" for w in T.SIGNAL_STOP) + r"""], x)))) AS n_words,
 len(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[「『"“‘(（]([A-Za-z][A-Za-z0-9 .''\-]{3,})[」』"”’）)]', 1), lambda x: lower(trim(x))), lambda x: length(x) >= 4))) AS n_quoted FROM s""")
def signal_counts(spark, sf_dir):
    """signals of each document by kind."""
    s = T.content_signals(F.col("text"))
    count = lambda p: F.size(F.filter("s", lambda x: x.startswith(p)))
    return docs(spark, sf_dir).select("doc_id", s.alias("s")).select("doc_id", count("w:").alias("n_words"), count("q:").alias("n_quoted"))


@query(rf"""WITH {PARAS} SELECT doc_id, idx,
 coalesce(nullif(replace(coalesce(nullif(regexp_extract(trim(text), '^\s*([0-9]+(?:[.\-][0-9]+)+)', 1), ''), nullif(regexp_extract(trim(text), '(?i)^\s*(?:Chapter|Chap\.?|Ch\.)\s*([0-9]+)', 1), ''),
  nullif(regexp_extract(trim(text), '(?i)^\s*(?:Appendix|App\.?)\s*([A-Z](?:[.\-][0-9]+)?)', 1), ''), nullif(regexp_extract(trim(text), '^\s*([A-Z](?:[.\-][0-9]+)+)\s', 1), ''), nullif(regexp_extract(trim(text), '^\s*([0-9]+)\s*[.、)]', 1), ''), nullif(regexp_extract(trim(text), '^\s*([0-9]+)\s*$', 1), '')), '-', '.'), ''), '') AS number FROM paras""")
def section_numbers(spark, sf_dir):
    """Numbers at the start of lines."""
    return paras(spark, sf_dir).select("doc_id", "idx", T.section_number(F.col("text")).alias("number"))


@query(r"SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS plain FROM documents")
def normalised_texts(spark, sf_dir):
    """texts made comparable."""
    return docs(spark, sf_dir).select("doc_id", T.normalised(F.col("text")).alias("plain"))


@query(f"WITH {PARAS} SELECT doc_id, sum({words('text')}) AS words, count(*) AS paragraphs FROM paras GROUP BY 1")
def word_counts(spark, sf_dir):
    """words of each document."""
    return paras(spark, sf_dir).groupBy("doc_id").agg(F.sum(T.en_words(F.col("text"))).alias("words"), F.count("*").alias("paragraphs"))


# ---------------------------------------------------------------- sequences


@query(f"""WITH {LINES} SELECT text, count(DISTINCT doc_id) AS n_files FROM lines GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3""")
def repeated_lines(spark, sf_dir):
    """Lines in three documents or more."""
    return S.repeated_texts(corpus.lines(docs(spark, sf_dir)), "text", "doc_id")


@query(f"WITH {LINES}, r AS (SELECT text FROM lines GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3) SELECT doc_id, count(*) AS n_lines FROM lines ANTI JOIN r USING (text) GROUP BY 1")
def lines_without_repeats(spark, sf_dir):
    """What the gate on repeated lines leaves of each document."""
    return S.without_repeated(corpus.lines(docs(spark, sf_dir)), "text", "doc_id").groupBy("doc_id").agg(F.count("*").alias("n_lines"))


HEADS = PARAS + r", b AS (SELECT doc_id, idx AS pos, text, CASE WHEN length(trim(text)) <= 40 AND NOT regexp_matches(trim(text), '[.。,，;；]$') THEN 'heading' ELSE 'para' END AS type, 1 + length(trim(text)) % 2 AS level FROM paras)"


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as blocks: short ones that don't end like a sentence are headings of two levels."""
    s = F.trim("text")
    head = (F.length(s) <= 40) & ~s.rlike("[.。,，;；]$")
    return paras(spark, sf_dir).select("doc_id", F.col("idx").alias("pos"), "text", F.when(head, "heading").otherwise("para").alias("type"), (1 + F.length(s) % 2).alias("level"))


@query(HEADS.join(["WITH ", """, n AS (SELECT *, sum(CASE WHEN type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM b),
 c AS (SELECT doc_id, level, count(*) AS k FROM n WHERE type = 'heading' AND nth > 1 GROUP BY ALL), m AS (SELECT doc_id, level AS modal FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, level) = 1),
 o AS (SELECT n.*, coalesce(type = 'heading' AND nth > 1 AND level = modal, false) AS opens FROM n LEFT JOIN m USING (doc_id)),
 p AS (SELECT *, sum(opens::int) OVER (PARTITION BY doc_id ORDER BY pos) AS s FROM o),
 q AS (SELECT *, max((type <> 'heading' OR opens)::int) OVER (PARTITION BY doc_id, s) AS f FROM p),
 r AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS sec FROM q WHERE f = 1)
SELECT doc_id, pos, sec, CASE WHEN type = 'para' THEN sum((type = 'para')::int) OVER (PARTITION BY doc_id, s ORDER BY pos) - 1 END AS para_idx FROM r"""]))
def sections(spark, sf_dir):
    """Sections opened by headings of the modal level."""
    return S.split_sections(blocks(spark, sf_dir)).select("doc_id", "pos", "sec", "para_idx")


@query("WITH " + HEADS + """, n AS (SELECT doc_id, count(*) FILTER (type <> 'heading') AS n FROM b GROUP BY 1) SELECT doc_id, n AS n_in, n AS n_out FROM n WHERE false""")
def section_conservation(spark, sf_dir):
    """Documents that lost blocks when cut into sections; none may."""
    b = blocks(spark, sf_dir)
    return S.conservation(b, S.split_sections(b))


@query("WITH " + HEADS + ", f AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM b WHERE type = 'heading') SELECT doc_id, min(pos) AS first, max(pos) AS last, count(*) AS n FROM f GROUP BY doc_id, g")
def heading_runs(spark, sf_dir):
    """Runs of headings."""
    return S.islands(blocks(spark, sf_dir), ["doc_id"], "pos", F.col("type") == "heading")


@query("WITH " + HEADS + ", f AS (SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= 3 THEN 0 ELSE 1 END AS new FROM b WHERE type = 'heading'), c AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM f) SELECT doc_id, min(pos) AS first, max(pos) AS last, count(*) AS n FROM c GROUP BY doc_id, g")
def heading_chains(spark, sf_dir):
    """Headings merged over short gaps."""
    return S.chains(blocks(spark, sf_dir).where("type = 'heading'").select("doc_id", "pos"), ["doc_id"], "pos", 3)


@query(f"WITH {PARAS} SELECT doc_id, idx, text FROM paras QUALIFY text = lag(text) OVER (PARTITION BY doc_id ORDER BY idx)")
def adjacent_repeats(spark, sf_dir):
    """Paragraphs equal to the one before."""
    return S.adjacent_repeats(paras(spark, sf_dir), ["doc_id"], "idx", "text")


@query(f"""WITH {PARAS}, s AS (SELECT doc_id, idx, CASE WHEN ({NOTE}) >= 0.5 THEN 1 ELSE -1 END AS s, count(*) OVER (PARTITION BY doc_id) AS n FROM paras),
 t AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY idx DESC) AS total FROM s WHERE idx >= n - 10),
 b AS (SELECT doc_id, n, total, idx FROM t QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, idx) = 1) SELECT doc_id, n, CASE WHEN total > 0 THEN idx ELSE n END AS boundary FROM b""")
def note_tails(spark, sf_dir):
    """Where the notes at a document's end begin."""
    return S.note_boundary(paras(spark, sf_dir), ["doc_id"], "idx", "text")


@query(f"WITH {PARAS} SELECT doc_id, idx, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS \"offset\" FROM paras")
def paragraph_offsets(spark, sf_dir):
    """Exclusive running lengths."""
    rows = paras(spark, sf_dir).withColumn("n", F.length("text"))
    return matching.note_offsets(rows, ["doc_id"], "idx", "n").select("doc_id", "idx", "offset")


@query(f"""WITH {PARAS}, l AS (SELECT doc_id, idx, length(text) AS n FROM paras), m AS (SELECT doc_id, quantile_cont(n, 0.5) AS med FROM l GROUP BY 1)
SELECT doc_id, idx, n, cast(med * 2 AS bigint) AS median_twice, NOT (n / med BETWEEN 0.55 AND 1.9) AS skewed FROM l JOIN m USING (doc_id)""")
def length_outliers(spark, sf_dir):
    """Lengths beside the document's median."""
    rows = paras(spark, sf_dir).select("doc_id", "idx", F.length("text").alias("n"))
    return S.median_outliers(rows, ["doc_id"], "n").select("doc_id", "idx", "n", (F.col("median") * 2).cast("bigint").alias("median_twice"), "skewed")


@query("WITH " + HEADS + " SELECT doc_id, pos, coalesce(sum((type <> 'heading')::int) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rank_before FROM b")
def ranks_before(spark, sf_dir):
    """Paragraphs before each block."""
    return S.rank_before(blocks(spark, sf_dir), ["doc_id"], "pos", F.col("type") == "heading").select("doc_id", "pos", "rank_before")


@query(f"""WITH {PARAS}, n AS (SELECT doc_id, count(*) AS n FROM paras GROUP BY 1),
 w AS (SELECT doc_id, n, unnest(CASE WHEN n <= 80 THEN [0] ELSE generate_series(0, cast(greatest(0, ceil((n - 40) / 30)) * 30 AS bigint), 30) END) AS low FROM n)
SELECT doc_id, low, CASE WHEN n <= 80 THEN n ELSE least(low + 40, n) END AS high FROM w""")
def sliding_windows(spark, sf_dir):
    """Windows over long documents."""
    n = paras(spark, sf_dir).groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))
    return n.select("doc_id", F.explode(S.windows(F.col("n"))).alias("w")).select("doc_id", F.col("w.low").alias("low"), F.col("w.high").alias("high"))


@query(rf"""WITH {PARAS}, f AS (SELECT *, length(trim(text)) >= 15 AND NOT regexp_matches(trim(text), '[.!?]$') AS b, regexp_matches(trim(text), '^[A-Z]') AS g FROM paras),
 l AS (SELECT *, b AND coalesce(lead(g) OVER w, false) AS link, row_number() OVER w AS rn FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
 h AS (SELECT *, link AND (rn - coalesce(max(CASE WHEN NOT link THEN rn END) OVER (PARTITION BY doc_id ORDER BY idx), 0)) % 2 = 1 AS head FROM l),
 u AS (SELECT *, CASE WHEN coalesce(lag(head) OVER (PARTITION BY doc_id ORDER BY idx), false) THEN rn - 1 ELSE rn END AS unit FROM h)
SELECT doc_id, min(idx) AS idx, string_agg(text, ' ' ORDER BY idx) AS text, count(*) AS n FROM u GROUP BY doc_id, unit""")
def merged_fragments(spark, sf_dir):
    """Paragraphs broken off joined with the next."""
    s = F.trim("text")
    return S.merge_broken(paras(spark, sf_dir), (F.length(s) >= 15) & ~s.rlike("[.!?]$"), s.rlike("^[A-Z]"))


# ---------------------------------------------------------------- joins


@query("WITH f AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1) SELECT c_custkey, o_orderkey FROM customer LEFT JOIN f ON c_custkey = o_custkey")
def first_match(spark, sf_dir):
    """Left join with the first row of a key."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    return matching.key_join(table(spark, sf_dir, "customer").select("c_custkey"), orders, ["c_custkey"], ["o_orderdate", "o_orderkey"]).select("c_custkey", "o_orderkey")


@query("WITH f AS (SELECT DISTINCT o_custkey FROM orders) SELECT count(*) AS n_rows, count(o_custkey) AS n_hits, count(o_custkey) >= 3 AND count(o_custkey) >= 0.5 * count(*) AS accepted FROM customer LEFT JOIN f ON c_custkey = o_custkey")
def mapping_accepted(spark, sf_dir):
    """Whether a key mapping is used."""
    return matching.accepted(first_match(spark, sf_dir), F.col("o_orderkey").isNotNull())


SIDES = "u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS kth FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS kth FROM conversations WHERE role = 'assistant')"


@query(f"WITH {SIDES} SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, coalesce(u.kth, a.kth) AS kth, u.turn AS user_turn, a.turn AS assistant_turn FROM u FULL JOIN a ON u.conv_id = a.conv_id AND u.kth = a.kth")
def kth_match(spark, sf_dir):
    """The k-th question meets the k-th answer."""
    c = table(spark, sf_dir, "conversations")
    side = lambda role: c.where(F.col("role") == role).select("conv_id", F.col("turn").alias(f"{role}_turn"))
    return matching.kth_join(side("user"), side("assistant"), ["conv_id"], "user_turn", "assistant_turn")


EVENT_SIDES = "l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = (SELECT max(event_type) FROM events)), r AS (SELECT user_id, ts, min(event_id) AS found FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY ALL)"


def event_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    ends = e.agg(F.max("event_type").alias("hi"), F.min("event_type").alias("lo"))
    e = e.join(F.broadcast(ends))  # one row
    right = e.where("event_type = lo").groupBy("user_id", "ts").agg(F.min("event_id").alias("found"))
    return e.where("event_type = hi").select("event_id", "user_id", "ts"), right


@query(f"WITH {EVENT_SIDES} SELECT event_id, (SELECT arg_max(found, r.ts) FROM r WHERE r.user_id = l.user_id AND r.ts < l.ts) AS found FROM l")
def asof_backward(spark, sf_dir):
    """The last event of one kind before each of another."""
    left, right = event_sides(spark, sf_dir)
    return matching.asof_backward(left, right, ["user_id"], "ts", "found").select("event_id", "found")


@query(f"WITH {EVENT_SIDES}, c AS (SELECT event_id, found, r.ts AS moment, abs(epoch_us(r.ts) - epoch_us(l.ts)) AS distance FROM l LEFT JOIN r USING (user_id)) SELECT event_id, found, distance FROM c QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY distance, moment) = 1")
def nearest_event(spark, sf_dir):
    """The nearest event of the other kind, the earlier of equals."""
    left, right = event_sides(spark, sf_dir)
    micros = lambda df: df.withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))
    return matching.nearest(micros(left), micros(right), ["user_id"], "ts", "found").select("event_id", "found", "distance")


@query("WITH e AS (SELECT event_id, user_id, event_type, cast(floor(epoch_us(ts) / 1000000) AS bigint) AS sec FROM events) SELECT a.event_id AS event_a, b.event_id AS event_b FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type < b.event_type AND abs(a.sec - b.sec) <= 3600")
def band_match(spark, sf_dir):
    """Events of two kinds within an hour."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("sec"))
    a, b = (e.select("user_id", F.col("event_id").alias(f"event_{s}"), F.col("event_type").alias(f"type_{s}"), F.col("sec").alias(f"sec_{s}")) for s in "ab")
    return matching.band_join(a, b, ["user_id"], "sec_a", "sec_b", 3600).where("type_a < type_b").select("event_a", "event_b")


TOKENS = "list_distinct(list_filter(list_transform(regexp_extract_all({}, '[A-Za-z]{{4,}}'), lambda x: lower(x)), lambda x: NOT list_contains(" + STOP + ", x)))"


@query(f"""WITH t AS (SELECT a.conv_id, {TOKENS.format('a.text')} AS l, {TOKENS.format('b.text')} AS r FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'),
 nl AS (SELECT w, count(*) AS n_w FROM (SELECT unnest(l) AS w FROM t) GROUP BY 1 HAVING count(*) >= 2), nr AS (SELECT g, count(*) AS n_g FROM (SELECT unnest(r) AS g FROM t) GROUP BY 1),
 p AS (SELECT w, g, count(*) AS n FROM (SELECT w, unnest(r) AS g FROM (SELECT unnest(l) AS w, r FROM t)) GROUP BY ALL HAVING count(*) >= 2)
SELECT w, g, n, cast(round(2.0 * n / (n_w + n_g) * 1000000) AS bigint) AS dice_millionth, row_number() OVER (PARTITION BY w ORDER BY 2.0 * n / (n_w + n_g) DESC, g) AS rank FROM p JOIN nl USING (w) JOIN nr USING (g) QUALIFY rank <= 3""")
def dice_lexicon(spark, sf_dir):
    """Counterparts of highest Dice coefficient between questions and answers."""
    c = table(spark, sf_dir, "conversations")
    a = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), T.en_tokens(F.col("text")).alias("l"))
    b = c.where("role = 'assistant'").select("conv_id", "turn", T.en_tokens(F.col("text")).alias("r"))
    out = matching.dice_lexicon(a.join(b, ["conv_id", "turn"]), "l", "r")
    return out.select("w", "g", "n", F.round(F.col("dice") * 1_000_000).cast("bigint").alias("dice_millionth"), "rank")


@query(f"WITH {COPY} SELECT doc_id, src, tgt FROM gold")
def gold_links(spark, sf_dir):
    """G8 fixture: links of the perturbed edition."""
    return corpus.gold_links(corpus.perturbed(paras(spark, sf_dir)))


@query(f"""WITH {COPY}, found AS (SELECT p.doc_id, p.idx AS src, c.idx AS tgt FROM paras p JOIN copy c ON p.doc_id = c.doc_id AND p.idx = c.idx),
 j AS (SELECT coalesce(f.doc_id, g.doc_id) AS doc_id, f.src AS fs, g.src AS gs FROM found f FULL JOIN gold g ON f.doc_id = g.doc_id AND f.src = g.src AND f.tgt = g.tgt)
SELECT doc_id, count(*) FILTER (fs IS NOT NULL AND gs IS NOT NULL) AS tp, count(*) FILTER (gs IS NULL) AS fp, count(*) FILTER (fs IS NULL) AS fn FROM j GROUP BY 1""")
def diagonal_scores(spark, sf_dir):
    """How well the mere diagonal does against gold."""
    a, b = A.editions(docs(spark, sf_dir))
    found = a.select("doc_id", F.col("idx").alias("src")).join(b.select("doc_id", F.col("idx").alias("src")), ["doc_id", "src"]).withColumn("tgt", F.col("src"))
    return audit.link_scores(found, corpus.gold_links(b), ["doc_id"]).select("doc_id", "tp", "fp", "fn")


@query(f"""WITH {COPY}, d AS (SELECT doc_id FROM paras UNION SELECT doc_id FROM copy)
SELECT doc_id, (SELECT count(*) FROM paras p WHERE p.doc_id = d.doc_id AND NOT EXISTS (SELECT 1 FROM gold g WHERE g.doc_id = p.doc_id AND g.src = p.idx)) AS src_unclaimed, 0 AS tgt_unclaimed, 0 AS src_claimed_twice,
 (SELECT count(*) FROM copy c WHERE c.doc_id = d.doc_id AND len(c.origin) > 1) AS tgt_claimed_twice, 0 AS dangling FROM d""")
def claim_reconciliation(spark, sf_dir):
    """What the gold links leave over or claim twice."""
    a, b = A.editions(docs(spark, sf_dir))
    return audit.reconciliation(corpus.gold_links(b), a, b, "doc_id")


@query(f"""WITH {COPY}, g AS (SELECT doc_id, src, tgt FROM gold), f AS (SELECT doc_id, src, min(tgt) AS v FROM g GROUP BY ALL),
 i AS (SELECT a.doc_id, count(*) AS inversions FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.src < b.src AND a.v > b.v GROUP BY 1) SELECT DISTINCT f.doc_id, coalesce(inversions, 0) AS inversions FROM f LEFT JOIN i USING (doc_id)""")
def inversions(spark, sf_dir):
    """Links of a document that cross."""
    g = gold_links(spark, sf_dir).groupBy("doc_id", "src").agg(F.min("tgt").alias("v"))
    return audit.inversions(g, "doc_id", "src", "v")


@query("WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, value FROM events), i AS (SELECT a.user_id, count(*) AS inversions FROM e a JOIN e b ON a.user_id = b.user_id AND a.n < b.n AND a.value > b.value GROUP BY 1) SELECT DISTINCT e.user_id, coalesce(inversions, 0) AS inversions FROM e LEFT JOIN i USING (user_id)")
def inversions_of_events(spark, sf_dir):
    """G7 for long groups, counted by merging."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return audit.inversions(table(spark, sf_dir, "events").select("user_id", F.row_number().over(w).alias("n"), "value"), "user_id", "n", "value")


# ---------------------------------------------------------------- audits and QA


def diagonal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by place: the k-th paragraph beside the k-th of the copy, with texts and ratio; one side may be missing."""
    a, b = A.editions(docs(spark, sf_dir))
    both = a.select("doc_id", F.col("idx").alias("pair_idx"), F.col("text").alias("src_text")).join(b.select("doc_id", F.col("idx").alias("pair_idx"), F.col("text").alias("tgt_text")), ["doc_id", "pair_idx"], "full_outer")
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(F.col("pair_idx"))).otherwise(F.array().cast("array<int>"))
    r = F.when(F.col("src_text").isNotNull() & F.col("tgt_text").isNotNull(), T.en_words(F.col("tgt_text")) / F.greatest(F.lit(1), T.en_words(F.col("src_text")))).otherwise(0.0)
    return both.withColumns({"src": one("src_text"), "tgt": one("tgt_text"), "r": r})


PAIRS = COPY + f", pairs AS (SELECT coalesce(p.doc_id, c.doc_id) AS doc_id, coalesce(p.idx, c.idx) AS pair_idx, p.text AS st, c.text AS tt, CASE WHEN p.text IS NOT NULL AND c.text IS NOT NULL THEN {words('c.text')} / greatest(1, {words('p.text')}) ELSE 0 END AS r FROM paras p FULL JOIN copy c ON p.doc_id = c.doc_id AND p.idx = c.idx)"


@query(f"""WITH {PAIRS}, a AS (SELECT doc_id, count(*) AS total, count(*) FILTER (tt IS NULL) AS only_src, count(*) FILTER (st IS NULL) AS only_tgt, 0 AS multi, count(*) FILTER (st IS NOT NULL AND tt IS NOT NULL AND NOT (r BETWEEN 1.0 AND 3.0)) AS ratio_bad FROM pairs GROUP BY 1)
SELECT *, only_src + only_tgt + ratio_bad AS bad, CASE WHEN (only_src + only_tgt + ratio_bad) / total > 0.20 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM a""")
def audit_fixed(spark, sf_dir):
    """Pairs by place under the fixed ruler."""
    return audit.audit_fixed(diagonal_pairs(spark, sf_dir), ["doc_id"])


MATH = r"(coalesce(list_sum(list_transform(regexp_extract_all({0}, '\$[^$]{{2,}}\$|\\[a-zA-Z]{{2,}}'), lambda x: length(x))), 0) / greatest(1, length({0})) > 0.15 OR regexp_matches({0}, '(?m)(?:^\s*>>>|^\s*(?:import|from|def|class|plt\.|np\.|tf\.)|\w+\s*=\s*\w+\(|\{{\s*\w+\s*:)'))"
KIND = r"CASE WHEN trim({0}) = '' THEN 'frag' WHEN regexp_matches(trim({0}), '^\s*[\[（(]?\s*[0-9]{{1,3}}\s*[\]）)]?\s+\S') THEN 'note' WHEN length(trim({0})) <= 12 THEN 'frag' ELSE '' END"


@query(f"""WITH {PAIRS}, k AS (SELECT *, st IS NOT NULL AND tt IS NOT NULL AS two, {MATH.format("coalesce(st, '')")} OR {MATH.format("coalesce(tt, '')")} AS formula, {KIND.format("coalesce(st, tt)")} AS kind FROM pairs),
 m AS (SELECT doc_id, count(*) AS n, list_sort(list(r))[cast(floor(count(*) / 2) AS bigint) + 1] AS med FROM k WHERE two AND NOT formula GROUP BY 1),
 j AS (SELECT k.*, CASE WHEN n >= 5 THEN greatest(0.30, 0.45 * med) ELSE 1.0 END AS lo, CASE WHEN n >= 5 THEN least(3.0, 1.8 * med) ELSE 3.0 END AS hi FROM k LEFT JOIN m USING (doc_id)),
 a AS (SELECT doc_id, count(*) AS total, count(*) FILTER (two AND NOT formula AND NOT (r BETWEEN lo AND hi)) AS ratio_bad, count(*) FILTER (NOT two AND kind = '') AS cover_bad, count(*) FILTER (NOT two AND kind <> '') AS struct_diff FROM j GROUP BY 1)
SELECT *, ratio_bad + cover_bad AS bad, CASE WHEN (ratio_bad + cover_bad) / total > 0.20 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM a""")
def audit_calibrated(spark, sf_dir):
    """G1: pairs by place under the calibrated ruler."""
    return audit.audit_calibrated(diagonal_pairs(spark, sf_dir), ["doc_id"]).select("doc_id", "total", "ratio_bad", "cover_bad", "struct_diff", "bad", "verdict")


@query(f"""WITH {PAIRS} SELECT lang, pairs.doc_id, count(*) AS pairs, count(*) FILTER (st IS NOT NULL AND tt IS NOT NULL) AS matched, count(*) FILTER (tt IS NULL) AS missing, count(*) FILTER (st IS NULL) AS surplus FROM pairs JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, pairs.doc_id)""")
def rollup_summary(spark, sf_dir):
    """Counts by document, language and all."""
    pairs = diagonal_pairs(spark, sf_dir).join(docs(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    return audit.rollup(pairs, "lang", "doc_id")


@query(f"""WITH {PAIRS}, a AS (SELECT doc_id, count(*) AS total, count(*) FILTER (tt IS NULL OR st IS NULL OR NOT (r BETWEEN 1.0 AND 3.0)) AS bad FROM pairs GROUP BY 1)
SELECT count(*) AS sections, count(*) FILTER (total < 5) AS small, count(*) FILTER (total >= 5 AND bad > 0.15 * total) AS fired, count(*) FILTER (total >= 5 AND NOT bad > 0.15 * total) AS passed FROM a""")
def gate_funnel(spark, sf_dir):
    """Q1, D3: how many documents the gate stops."""
    return audit.gate_funnel(audit_fixed(spark, sf_dir))


@query(f"""WITH {PAIRS}, f AS (SELECT doc_id, pair_idx, pair_idx - row_number() OVER (PARTITION BY doc_id ORDER BY pair_idx) AS g FROM pairs WHERE st IS NULL OR tt IS NULL), l AS (SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, count(*) AS n FROM f GROUP BY doc_id, g) GROUP BY 1),
 a AS (SELECT doc_id, count(*) AS total, count(st) AS n_src, count(tt) AS n_tgt, count(*) FILTER (tt IS NULL) AS only_src, count(*) FILTER (st IS NULL) AS only_tgt FROM pairs GROUP BY 1)
SELECT doc_id, CASE WHEN abs(n_src - n_tgt) / greatest(1, n_src) > 0.08 OR coalesce(longest, 0) >= 2 THEN 'A' WHEN only_src + only_tgt > 0 THEN 'B' ELSE 'D' END AS tier FROM a LEFT JOIN l USING (doc_id)""")
def strength_tiers(spark, sf_dir):
    """Strength of a document's suspicion."""
    pairs = audit.sided(diagonal_pairs(spark, sf_dir))
    runs = S.longest_run(pairs, ["doc_id"], "pair_idx", F.col("only_src") | F.col("only_tgt"))
    counts = pairs.groupBy("doc_id").agg(
        F.count("*").alias("total"), F.count("src_text").alias("n_src"), F.count("tgt_text").alias("n_tgt"), F.count_if("only_src").alias("only_src"), F.count_if("only_tgt").alias("only_tgt"), F.count_if("multi").alias("multi")
    )
    return audit.strength_tiers(counts.join(runs, "doc_id", "left").fillna(0, ["longest"])).select("doc_id", "tier")


@query(rf"""WITH {PAIRS}, s AS (SELECT doc_id, (st IS NULL) <> (tt IS NULL) AS single, regexp_matches(coalesce(st, tt), '^\s*\[[0-9]{{1,3}}\]|^\s*[①-⑳]') AS foot FROM pairs), a AS (SELECT doc_id, count(*) FILTER (single) AS one_sided, count(*) FILTER (single AND foot) AS footnotes FROM s GROUP BY 1)
SELECT *, CASE WHEN one_sided = 0 THEN 'no one-sided' WHEN footnotes = one_sided THEN 'all' WHEN footnotes > 0 THEN 'part' ELSE 'none' END AS share FROM a""")
def footnote_share(spark, sf_dir):
    """Q3: footnotes among one-sided pairs."""
    return audit.footnote_share(diagonal_pairs(spark, sf_dir), ["doc_id"])


@query(rf"""WITH {PAIRS}, f AS (SELECT *, pair_idx - row_number() OVER (PARTITION BY doc_id ORDER BY pair_idx) AS g FROM pairs WHERE st IS NULL OR tt IS NULL), r AS (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM f),
 k AS (SELECT doc_id, CASE WHEN trim(coalesce(st, tt)) = '' THEN 'empty' WHEN regexp_matches(coalesce(st, tt), '^\s*\[[0-9]{{1,3}}\]|^\s*[①-⑳]') THEN 'footnote' WHEN length(trim(coalesce(st, tt))) <= 30 THEN 'short' ELSE 'prose' END AS kind FROM r WHERE n >= 3) SELECT doc_id, kind, count(*) AS n FROM k GROUP BY ALL""")
def run_kinds(spark, sf_dir):
    """Q5: members of one-sided runs by kind."""
    return audit.run_kinds(diagonal_pairs(spark, sf_dir), ["doc_id"])


#: F14 as SQL: words, quoted Latin and numbered anchors. Anchors are found by their neighbours, as this dialect cannot look around.
SIGNAL_STOP = "[" + ", ".join(f"'{w}'" for w in T.SIGNAL_STOP) + "]"
ANCHORS = r"""list_concat(
  list_transform(list_filter(regexp_extract_all(' ' || regexp_replace({0}, '([0-9.]*[0-9.])', '  \1  ', 'g') || ' ', ' [0-9.]+ '), lambda x: regexp_matches(x, '^ [0-9]{{1,2}}\.[0-9]{{1,2}}(\.[0-9]{{1,2}})? $')), lambda x: trim(x)),
  list_transform(list_filter(regexp_extract_all(' ' || regexp_replace({0}, '([\p{{L}}\p{{M}}\p{{N}}_.]+)', '  \1  ', 'g') || ' ', ' [\p{{L}}\p{{M}}\p{{N}}_.]+ '), lambda x: regexp_matches(x, '^ [A-Z]\.[0-9]{{1,2}}(\.[0-9]{{1,2}})? $')), lambda x: trim(x)))"""
SIGNALS = (
    "list_distinct(list_concat(list_concat(" + ANCHORS + r""", list_transform(list_filter(list_transform(regexp_extract_all({0}, '[「『"“‘(（]([A-Za-z][A-Za-z0-9 .''\-]{{3,}})[」』"”’）)]', 1), lambda x: lower(trim(x))), lambda x: length(x) >= 4), lambda x: 'q:' || x)),"""
    " list_transform(list_filter(list_transform(regexp_extract_all({0}, '[A-Za-z]{{4,}}'), lambda x: lower(x)), lambda x: NOT list_contains(" + SIGNAL_STOP + ", x)), lambda x: 'w:' || x)))"
)


@query(f"""WITH pool AS (SELECT DISTINCT unnest({SIGNALS.format('text')}) AS s FROM benchmark), d AS (SELECT doc_id, unnest({SIGNALS.format('text')}) AS s FROM documents),
 h AS (SELECT doc_id, count(*) AS n_signals, count(pool.s) AS n_hits FROM d LEFT JOIN pool USING (s) GROUP BY 1)
SELECT documents.doc_id, coalesce(n_signals, 0) AS n_signals, coalesce(n_hits, 0) AS n_hits, CASE WHEN coalesce(n_signals, 0) = 0 THEN 'unsure' WHEN n_hits = 0 THEN 'unique' WHEN n_hits / n_signals >= 0.30 THEN 'misplaced' ELSE 'unsure' END AS verdict FROM documents LEFT JOIN h USING (doc_id)""")
def signal_verdicts(spark, sf_dir):
    """documents' signals looked up in the benchmark's pool."""
    pool = audit.signal_pool(table(spark, sf_dir, "benchmark").select(F.lit(0).alias("side"), "text"), "side")
    texts = docs(spark, sf_dir).select(F.lit(0).alias("side"), "doc_id", "text")
    return audit.one_sided_verdicts(texts, pool, "side", "text").drop("side")


@query(f"""WITH {COPY}, a AS (SELECT doc_id, idx AS i, unnest({NUMBERS.format('text')}) AS signal FROM paras), b AS (SELECT doc_id, idx AS j, unnest({NUMBERS.format('text')}) AS signal FROM copy),
 d AS (SELECT a.doc_id, a.i, a.signal, min(abs(i - j)) FILTER (abs(i - j) <= 2) AS d FROM a LEFT JOIN b ON a.doc_id = b.doc_id AND a.signal = b.signal GROUP BY ALL)
SELECT doc_id, i, count(*) FILTER (d = 0) AS own, count(*) FILTER (d > 0) AS moved, count(*) FILTER (d IS NULL) AS lost FROM d GROUP BY ALL""")
def neighbour_drift(spark, sf_dir):
    """Numbers found in place, beside, or not."""
    a, b = A.editions(docs(spark, sf_dir))
    sig = lambda df: df.select("doc_id", F.col("idx").alias("i"), F.explode(T.numbers(F.col("text"))).alias("signal"))
    return audit.neighbour_drift(sig(a), sig(b), "doc_id")


@query(f"""WITH {COPY}, a AS (SELECT doc_id, idx, list_sort({NUMBERS.format('text')}) AS n FROM paras), b AS (SELECT doc_id, idx, list_sort({NUMBERS.format('text')}) AS n FROM copy),
 j AS (SELECT a.n AS x, b.n AS y FROM a JOIN b USING (doc_id, idx) WHERE len(a.n) > 0 AND len(b.n) > 0) SELECT count(*) AS comparable, count(*) FILTER (x = y) AS exact, count(*) FILTER (x <> y AND list_has_any(x, y)) AS partial, count(*) FILTER (NOT list_has_any(x, y)) AS disjoint FROM j""")
def anchor_agreement(spark, sf_dir):
    """Whether anchors of pairs agree."""
    a, b = A.editions(docs(spark, sf_dir))
    n = lambda df, c: df.select("doc_id", "idx", T.numbers(F.col("text")).alias(c))
    return audit.anchor_agreement(n(a, "src_anchors").join(n(b, "tgt_anchors"), ["doc_id", "idx"]))


@query(f"""WITH {COPY}, u AS (SELECT doc_id, text, count(*) OVER (PARTITION BY doc_id, text) AS k, idx FROM paras), a AS (SELECT * FROM u WHERE k = 1), v AS (SELECT doc_id, text, count(*) OVER (PARTITION BY doc_id, text) AS k, idx FROM copy), b AS (SELECT * FROM v WHERE k = 1)
SELECT b.idx - a.idx AS gap, count(*) AS n FROM a JOIN b USING (doc_id, text) GROUP BY 1""")
def gap_histogram(spark, sf_dir):
    """How far paragraphs moved."""
    a, b = A.editions(docs(spark, sf_dir))
    once = lambda df, c: df.groupBy("doc_id", "text").agg(F.count("*").alias("k"), F.min("idx").alias(c)).where("k = 1").drop("k")
    return once(a, "i").join(once(b, "j"), ["doc_id", "text"]).groupBy((F.col("j") - F.col("i")).alias("gap")).agg(F.count("*").alias("n"))


@query(r"""WITH p AS (SELECT regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS plain, doc_id FROM documents) SELECT plain, count(*) AS n, min(doc_id) AS first_doc FROM p GROUP BY 1 HAVING count(*) > 1""")
def duplicate_texts(spark, sf_dir):
    """Texts that are the same once normalised."""
    plain = normalised_texts(spark, sf_dir)
    keys = [F.xxhash64("plain").alias("h1"), F.xxhash64(F.lit("second"), "plain").alias("h2"), F.length("plain").alias("n_chars")]
    # Texts shuffle as digests; of each group one text is fetched by its first document.
    groups = plain.select("doc_id", *keys).groupBy("h1", "h2", "n_chars").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")
    return groups.select("n", "first_doc").join(plain.select(F.col("doc_id").alias("first_doc"), "plain"), "first_doc").select("plain", "n", "first_doc")


@query(f"""WITH {COPY}, a AS (SELECT DISTINCT unnest({NUMBERS.format('text')}) AS n FROM paras), b AS (SELECT DISTINCT unnest({NUMBERS.format('text')}) AS n FROM copy)
SELECT (SELECT count(*) FROM (SELECT n FROM a INTERSECT SELECT n FROM b)) AS common, (SELECT count(*) FROM (SELECT n FROM a EXCEPT SELECT n FROM b)) AS src_only, (SELECT count(*) FROM (SELECT n FROM b EXCEPT SELECT n FROM a)) AS tgt_only""")
def number_sets(spark, sf_dir):
    """Numbers of both editions as sets."""
    a, b = A.editions(docs(spark, sf_dir))
    x, y = (df.select(F.explode(T.numbers(F.col("text"))).alias("n")).distinct() for df in (a, b))
    both = x.withColumn("a", F.lit(1)).join(y.withColumn("b", F.lit(1)), "n", "full_outer")
    return both.agg(F.count(F.col("a") + F.col("b")).alias("common"), F.count_if(F.col("b").isNull()).alias("src_only"), F.count_if(F.col("a").isNull()).alias("tgt_only"))


# ---------------------------------------------------------------- pages


@query(r"""SELECT page_id, len(regexp_extract_all(html, '(?i)<img\b[^>]*>')) AS img, len(regexp_extract_all(html, '(?i)<figure\b')) AS figure, len(regexp_extract_all(html, '(?i)<table\b')) AS "table", len(regexp_extract_all(html, '(?i)<svg\b')) AS svg,
 len(regexp_extract_all(html, '(?i)<p\b')) AS p, len(regexp_extract_all(html, '(?i)<a\b')) AS links FROM pages""")
def page_inventory(spark, sf_dir):
    """Elements of each page."""
    c = T.visual_counts(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", *[c[n].alias(n) for n in ("img", "figure", "table", "svg")], F.regexp_count("html", F.lit("(?i)<p\\b")).alias("p"), F.regexp_count("html", F.lit("(?i)<a\\b")).alias("links"))


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*href="([^"]*)"', 1)) AS href FROM pages) SELECT href, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM l GROUP BY 1""")
def link_counts(spark, sf_dir):
    """Links of the pages."""
    l = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(?i)<a\\b[^>]*href=\"([^\"]*)\""), F.lit(1))).alias("href"))
    return l.groupBy("href").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("n_pages"))


TITLES = r"""t AS (SELECT page_id AS file, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS text, 'title' AS src, 1 AS level, page_id AS spine FROM pages UNION ALL SELECT page_id, trim(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)), 'body', 2, page_id FROM pages)"""


def title_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    row = lambda tag, src, level: p.select(F.col("page_id").alias("file"), F.trim(F.regexp_extract("html", f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)).alias("text"), F.lit(src).alias("src"), F.lit(level).alias("level"), F.col("page_id").alias("spine"))
    return row("title", "title", 1).unionByName(row("h1", "body", 2)).where("text != ''")


@query(f"WITH {TITLES} SELECT file, text, array_to_string(list_sort(list(DISTINCT src)), '+') AS srcs, min(level) AS level, min(spine) AS spine FROM t WHERE text <> '' GROUP BY file, text")
def merged_titles(spark, sf_dir):
    """Title candidates of two sources, merged."""
    return S.merged_titles(title_rows(spark, sf_dir)).withColumn("srcs", F.array_join("srcs", "+"))


@query(f"WITH {TITLES}, m AS (SELECT file, text, array_to_string(list_sort(list(DISTINCT src)), '+') AS srcs FROM t WHERE text <> '' GROUP BY file, text) SELECT srcs, count(*) AS n, count(*) FILTER (length(text) > 45) AS long_ones FROM m GROUP BY 1")
def title_sources(spark, sf_dir):
    """Q6: combinations of sources."""
    return merged_titles(spark, sf_dir).groupBy("srcs").agg(F.count("*").alias("n"), F.count_if(F.length("text") > 45).alias("long_ones"))


@query(r"WITH c AS (SELECT page_id, 'script' AS rule, len(regexp_extract_all(html, '(?i)<script\b')) AS n FROM pages UNION ALL SELECT page_id, 'comment', len(regexp_extract_all(html, '<!--')) FROM pages UNION ALL SELECT page_id, 'entity', len(regexp_extract_all(html, '&[a-z]+;')) FROM pages) SELECT page_id AS doc_id, rule, n FROM c WHERE n > 0")
def leak_counts(spark, sf_dir):
    """Matches of leak rules."""
    p = table(spark, sf_dir, "pages").withColumnRenamed("page_id", "doc_id")
    return audit.leak_counts(p, "html", {"script": "(?i)<script\\b", "comment": "<!--", "entity": "&[a-z]+;"})


#: Leaf blocks of the pages: elements that hold text and inline tags only. Their pages have no other kinds of blocks, and no visuals.
PAGE_BLOCKS = r"""body AS (SELECT page_id, regexp_replace(coalesce(nullif(regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1), ''), html), '(?is)<(?:script|style)\b.*?</(?:script|style)\s*>|<!--.*?-->', ' ', 'g') AS body FROM pages),
 leaf AS (SELECT page_id, regexp_extract_all(body, '(?i)@LEAF@') AS a FROM body),
 told AS (SELECT page_id, generate_subscripts(a, 1) AS n, unnest(a) AS m FROM leaf),
 texts AS (SELECT page_id, n, lower(regexp_extract(m, '^<([a-zA-Z0-9]+)', 1)) AS tag, trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(m, '<[^>]+>', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS text FROM told),
 pb AS (SELECT page_id, cast(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS int) AS pos, tag, CASE tag WHEN 'h1' THEN 'heading' WHEN 'li' THEN 'li' ELSE 'para' END AS type, CASE WHEN tag = 'h1' THEN 1 ELSE 0 END AS level, text FROM texts WHERE text <> '')""".replace("@LEAF@", "|".join(rf"<{t}(?:\s[^>]*)?>(?:[^<]|<(?:/?a|/?b|br)(?:\s[^>]*)?>)*</{t}>" for t in ("p", "li", "h1", "div", "footer")))


@query(f"WITH {PAGE_BLOCKS} SELECT * FROM pb")
def page_blocks(spark, sf_dir):
    """Pages as blocks."""
    return readers.html_blocks(table(spark, sf_dir, "pages"), ["page_id"], "html").select("page_id", "pos", "tag", "type", "level", "text")


@query(f"""WITH {PAGE_BLOCKS}, t AS (SELECT *, first_value(CASE WHEN type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS title, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM pb),
 k AS (SELECT * FROM t WHERE NOT coalesce(n <= 10 AND type = 'para' AND (regexp_matches(text, '(?i)^(?:[0-9]{{1,4}}|[ivxlcdm]{{1,7}})$') OR text = title), false)), c AS (SELECT *, sum((type <> 'heading')::int) OVER (PARTITION BY page_id) AS rest FROM k)
SELECT page_id AS doc_id, pos, type, 0 AS sec, CASE WHEN type <> 'heading' THEN sum((type <> 'heading')::int) OVER (PARTITION BY page_id ORDER BY pos) - 1 END AS para_idx FROM c WHERE rest > 0""")
def page_sections(spark, sf_dir):
    """T7, T8, T9, T20 over parsed pages."""
    b = readers.html_blocks(table(spark, sf_dir, "pages").withColumnRenamed("page_id", "doc_id"), ["doc_id"], "html")
    return S.split_sections(S.fold_head_noise(S.fill_captions(S.promote_first(b)))).select("doc_id", "pos", "type", "sec", "para_idx")


# ---------------------------------------------------------------- structure


@query("WITH " + HEADS + f""", l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) <= 10 AS tail FROM b)
SELECT doc_id, count(*) FILTER (type = 'heading') AS headings, count(*) FILTER (type = 'para') AS paras, 0 AS visuals, cast(sum(len(regexp_extract_all(text, '\\[[0-9]{{1,3}}\\]'))) AS bigint) AS note_marks,
 cast(round(1000 * avg(CASE WHEN tail THEN {NOTE} END)) AS bigint) AS note_thousandth FROM l GROUP BY 1""")
def chapter_stats(spark, sf_dir):
    """Invariants of each document."""
    out = B.chapter_stats(blocks(spark, sf_dir), "doc_id")
    return out.withColumn("note_thousandth", F.round(F.col("note_likeness") * 1000).cast("bigint")).drop("note_likeness")


@query(f"""WITH {COPY}, a AS (SELECT DISTINCT doc_id, idx, unnest(list_transform(list_concat(regexp_extract_all(text, '[A-Za-z]{{4,}}'), list_transform(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) BETWEEN 3 AND 4), lambda x: x)), lambda x: lower(x))) AS h FROM paras),
 b AS (SELECT DISTINCT doc_id, unnest(list_transform(list_concat(regexp_extract_all(text, '[A-Za-z]{{4,}}'), list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) BETWEEN 3 AND 4)), lambda x: lower(x))) AS h FROM copy)
SELECT a.doc_id, a.idx, count(*) AS n_hints, count(b.h) AS n_found FROM a LEFT JOIN b ON a.doc_id = b.doc_id AND a.h = b.h GROUP BY ALL""")
def hint_hits(spark, sf_dir):
    """Q13: hints of each paragraph that the other edition has."""
    a, b = A.editions(docs(spark, sf_dir))
    return B.hint_hits(a, b, "doc_id")


@query("SELECT count(*) AS refs, count(DISTINCT l_orderkey) AS distinct_refs, count(*) FILTER (o_orderkey IS NULL) AS dead FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def reference_check(spark, sf_dir):
    """References, different ones, and those without target."""
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    dead = matching.dead_references(refs, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), "k")
    return refs.agg(F.count("*").alias("refs"), F.count_distinct("k").alias("distinct_refs")).join(dead.agg(F.count("*").alias("dead")))


@query(f"""WITH {COPY}, n AS (SELECT doc_id, count(*) AS n FROM paras GROUP BY 1), g AS (SELECT *, tgt < lag(tgt) OVER (PARTITION BY doc_id ORDER BY src) AS back FROM gold)
SELECT g.doc_id AS key, count(*) = count(DISTINCT tgt) AS unique_targets, NOT coalesce(bool_or(back), false) AS monotone, cast(floor(1000 * count(DISTINCT src) / max(n)) AS bigint) AS covered_thousandth FROM g JOIN n USING (doc_id) GROUP BY 1""")
def map_integrity(spark, sf_dir):
    """Checks of the gold mapping."""
    a, b = A.editions(docs(spark, sf_dir))
    n = a.groupBy("doc_id").agg(F.count("*").alias("n"))
    g = corpus.gold_links(b).join(n, "doc_id").withColumnRenamed("doc_id", "key").withColumn("ord", F.col("src"))
    out = matching.mapping_integrity(g, F.col("n"), F.col("n"))
    return out.select("key", "unique_targets", "monotone", F.floor(F.col("coverage") * 1000).cast("bigint").alias("covered_thousandth"))


@query(f"""WITH {COPY}, s AS (SELECT trim(text) AS t FROM paras p WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.doc_id = p.doc_id AND g.src = p.idx)),
 k AS (SELECT CASE WHEN t = '' THEN 'empty' WHEN regexp_matches(t, '(?i)^(?:[图表]\\s*[0-9]+|(?:fig(?:ure)?|table|equation|eq)\\.?\\s*[0-9]+)') AND length(t) <= 110 THEN 'caption' WHEN regexp_matches(t, '^\\s*\\[[0-9]{{1,3}}\\]|^\\s*[①-⑳]') THEN 'footnote'
  WHEN length(t) <= 24 AND NOT regexp_matches(t, '[。！？；，、.!?;:,]') THEN 'metadata' WHEN length(t) <= 40 AND NOT regexp_matches(t, '[。！？；，、.!?;:,]') THEN 'lead-in' WHEN regexp_matches(t, '\\$|\\\\[a-zA-Z]{{2,}}') AND length(t) <= 80 THEN 'formula' ELSE 'prose' END AS kind FROM s) SELECT kind, count(*) AS n FROM k GROUP BY 1""")
def one_sided_kinds(spark, sf_dir):
    """Kinds of paragraphs that the copy lacks."""
    a, b = A.editions(docs(spark, sf_dir))
    lone = a.join(corpus.gold_links(b).select("doc_id", F.col("src").alias("idx")), ["doc_id", "idx"], "left_anti")
    return lone.groupBy(B.one_sided_kind(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


@query()
def fuzzy_paragraphs(spark, sf_dir):
    """Paragraphs of a document that nearly repeat one another."""
    return B.fuzzy_duplicates(paras(spark, sf_dir), "doc_id")


# ---------------------------------------------------------------- alignment


@query()
def aligned_pairs(spark, sf_dir):
    """Paragraphs of both editions aligned, skewed spans repaired."""
    return A.aligned(docs(spark, sf_dir), repair=True)[0]


@query(f"""WITH {PARAS} SELECT doc_id, count(*) AS n_links, sum((len([idx]) = 1)::int) AS n_certain, 0 AS n_skewed FROM paras GROUP BY 1""")
def alignment_of_copies(spark, sf_dir):
    """Documents aligned with unchanged copies: every paragraph meets itself with certainty, and nothing is skewed."""
    p = paras(spark, sf_dir)
    links = alignment.align(p, p, unit="words", k=1.0, repair=True)
    skew = (F.col("r") < 0.65) | (F.col("r") > 1.62)
    counted = lambda flag: F.count_if(flag & (F.col("src") == F.col("tgt")))
    return links.groupBy("doc_id").agg(F.count("*").alias("n_links"), counted(F.col("c") == 1.0).alias("n_certain"), F.count_if(skew & (F.col("c") < 1)).alias("n_skewed"))


@query()
def alignment_scores(spark, sf_dir):
    """Alignment against gold by language."""
    return A.scores_by_language(docs(spark, sf_dir))


@query()
def alignment_audit(spark, sf_dir):
    """Alignment under the calibrated ruler."""
    return A.audited(docs(spark, sf_dir))


@query()
def probe_votes(spark, sf_dir):
    """Votes on surplus paragraphs, where the copy is the source."""
    a, b = A.editions(docs(spark, sf_dir))
    return alignment.probe_votes(b, a, unit="words", k=1.0)


@query(f"""WITH {PARAS}, a AS (SELECT doc_id AS book, idx AS i, {words('text')} AS w FROM paras) SELECT book, i AS src_ord, i AS tgt_ord FROM a""")
def document_match(spark, sf_dir):
    """Documents of each book matched in order by length; here the books are documents and their chapters are paragraphs, against themselves."""
    d = paras(spark, sf_dir).select(F.col("doc_id").alias("book"), F.col("idx").cast("bigint").alias("doc_ord"), T.en_words(F.col("text")).cast("double").alias("mass"))
    return alignment.match_documents(d, d, "book")


@query(f"""WITH {PARAS}, s AS (SELECT DISTINCT doc_id, idx // 4 AS sec FROM paras) SELECT doc_id, count(*) AS n_pairs, sum((src = tgt)::int) AS n_same FROM (SELECT doc_id, sec AS src, sec AS tgt FROM s) GROUP BY 1""")
def section_match(spark, sf_dir):
    """Sections matched by their paragraphs; here of documents with themselves, where every section must meet itself."""
    cut = paras(spark, sf_dir).withColumn("sec", F.floor(F.col("idx") / 4).cast("int"))
    found = alignment.match_sections(cut, cut, "doc_id", unit="words", k=1.0)
    return found.groupBy("doc_id").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("src_secs") == F.col("tgt_secs")).alias("n_same"))


@query()
def section_links(spark, sf_dir):
    """Sections of both editions."""
    a, b = A.editions(docs(spark, sf_dir))
    cut = lambda df: df.withColumn("sec", F.floor(F.col("idx") / 4).cast("int"))
    return alignment.match_sections(cut(a), cut(b), "doc_id", unit="words", k=1.0)


@query(f"""WITH RECURSIVE {COPY}, a AS (SELECT doc_id, min(idx) AS i, length(text) % 100 AS mark FROM paras WHERE length(text) >= 4 GROUP BY doc_id, mark HAVING count(*) = 1),
 b AS (SELECT doc_id, min(idx) AS j, length(text) % 100 AS mark FROM copy WHERE length(text) >= 4 GROUP BY doc_id, mark HAVING count(*) = 1),
 p AS (SELECT doc_id, i, j, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS n FROM a JOIN b USING (doc_id, mark)),
 g AS (SELECT doc_id, n, i, j, j AS top, true AS kept FROM p WHERE n = 1 UNION ALL SELECT p.doc_id, p.n, p.i, p.j, greatest(g.top, p.j), p.j > g.top FROM g JOIN p ON p.doc_id = g.doc_id AND p.n = g.n + 1)
SELECT doc_id, i, j FROM g WHERE kept""")
def unique_anchors(spark, sf_dir):
    """Enumerators that occur once on each side, kept while they increase."""
    a, b = A.editions(docs(spark, sf_dir))
    marked = lambda df: df.withColumn("text", F.concat(F.lit("("), (F.length("text") % 100).cast("string"), F.lit(") "), "text"))
    return alignment.unique_anchors(marked(a), marked(b), "doc_id")


@query(f"""WITH {COPY}, a AS (SELECT doc_id, idx AS i, {words('text')} AS w, {NUMBERS.format('text')} AS s FROM paras), b AS (SELECT doc_id, idx AS j, {words('text')} AS w, {NUMBERS.format('text')} AS s FROM copy)
SELECT a.doc_id, i, j, len(list_intersect(a.s, b.s)) AS shared FROM a JOIN b ON a.doc_id = b.doc_id AND abs(i - j) <= 3 WHERE abs(ln((b.w + 1) / (a.w + 1))) <= 0.30 AND len(list_intersect(a.s, b.s)) > 0""")
def anchor_candidates(spark, sf_dir):
    """Pairs in the band with like lengths and a number in common, before any choice."""
    a, b = A.editions(docs(spark, sf_dir))
    return alignment.anchor_candidates(corpus.measured(a), corpus.measured(b), "doc_id")


@query()
def soft_anchors(spark, sf_dir):
    """Increasing anchors by lengths and numbers, Latin words or sentence curves; tests hold them against the rule read directly."""
    a, b = A.editions(docs(spark, sf_dir))
    return alignment.soft_anchors(a, b, "doc_id", unit="words", k=1.0)


@query(f"""WITH RECURSIVE {PARAS}, p AS (SELECT doc_id, idx, octet_length(encode(text)) AS n FROM paras),
 b AS (SELECT doc_id, idx, n AS held, 0 AS bin FROM p WHERE idx = 0 UNION ALL SELECT p.doc_id, p.idx, CASE WHEN b.held > 0 AND b.held + p.n > 4096 THEN p.n ELSE b.held + p.n END, CASE WHEN b.held > 0 AND b.held + p.n > 4096 THEN b.bin + 1 ELSE b.bin END FROM b JOIN p ON p.doc_id = b.doc_id AND p.idx = b.idx + 1),
 l AS (SELECT doc_id, max(bin) AS last, arg_max(held, idx) AS tail FROM b GROUP BY 1)
SELECT doc_id, idx, CASE WHEN last > 0 AND tail < 1024 AND bin = last THEN bin - 1 ELSE bin END AS bin FROM b JOIN l USING (doc_id)""")
def byte_bins(spark, sf_dir):
    """K4: lines of each document packed in order into bins of bytes."""
    rows = paras(spark, sf_dir).select("doc_id", "idx", F.octet_length("text").alias("n"))
    step = lambda name, found: ((name, r[0], b) for r, b in zip(found, kernels.pack_next([r[1] for r in found], 4096, 1024), strict=True))
    return by_group(rows, "doc_id", ["idx"], ["idx", "n"], step, "doc_id bigint, idx int, bin int")


# ---------------------------------------------------------------- usage


@query("""WITH u AS (SELECT event_id, event_type, ts, cast(floor(value) AS bigint) AS prompt, cast(floor(value / 2) AS bigint) AS cached, cast(floor(value / 4) AS bigint) AS completion FROM events),
 p AS (SELECT *, CASE WHEN isodow(ts) <= 5 AND (hour(ts) BETWEEN 9 AND 11 OR hour(ts) BETWEEN 14 AND 17) THEN 2 ELSE 1 END AS f FROM u)
SELECT event_type, count(*) AS calls, sum(prompt) AS prompt, cast(sum(f * (cached * 2 + greatest(0, prompt - cached) * 100 + completion * 400)) AS bigint) AS cost_units FROM p GROUP BY 1""")
def token_cost(spark, sf_dir):
    """Priced usage by kind; a unit is a hundredth of a millionth."""
    e = table(spark, sf_dir, "events")
    tokens = lambda d: F.floor(F.col("value") / d).cast("bigint")
    u = e.select("event_type", "ts", F.lit("deepseek-chat").alias("model"), tokens(1).alias("prompt"), tokens(2).alias("cached"), tokens(4).alias("completion"))
    p = usage.is_peak(F.col("ts"))
    units = F.when(p, 2).otherwise(1) * (F.col("cached") * 2 + F.greatest(F.lit(0), F.col("prompt") - F.col("cached")) * 100 + F.col("completion") * 400)
    priced = usage.with_cost(u)
    return priced.groupBy("event_type").agg(F.count("*").alias("calls"), F.sum("prompt").alias("prompt"), F.sum(units).cast("bigint").alias("cost_units"))


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events), w AS (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS in_window FROM e) SELECT event_id, in_window, in_window > 20 AS over FROM w""")
def sliding_rate(spark, sf_dir):
    """Events of a user in the hour that ends at each."""
    return usage.sliding_rate(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["user_id"], "ts", 3600).select("event_id", "in_window", "over")


@query("""WITH s AS (SELECT event_id, sum(cast(floor(value) AS bigint)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events) SELECT event_id, spent, CASE WHEN spent >= 2500 THEN 'stop' WHEN spent >= 1500 THEN 'mapping' ELSE 'all' END AS state FROM s""")
def budget_states(spark, sf_dir):
    """Running cost of each user and what it allows."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.floor("value").cast("bigint").alias("cost"))
    return usage.budget_states(e, ["user_id"], ["ts", "event_id"], "cost", 1500, 2500).select("event_id", "spent", "state")


@query("SELECT doc_id, left(sha256(concat_ws(chr(10), lang, source, text)), 32) AS key FROM documents")
def request_keys(spark, sf_dir):
    """Content addresses."""
    return docs(spark, sf_dir).select("doc_id", usage.request_key(F.col("lang"), F.col("source"), F.col("text")).alias("key"))
