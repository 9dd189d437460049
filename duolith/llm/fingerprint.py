"""Exact digests of a text's canonical form, with byte comparison inside equal buckets.

DataFrame functions only. A canonical form is the compatibility composition
(NFKC) of the case-folded text with each run of white space as one space and
none at the ends. Its 128-bit fingerprint is two xxhash64 values with different
seeds. Forms that share a fingerprint are compared byte by byte; were two of
them to differ, the later ones in byte order would get a number after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duolith.llm.common import digest_keys, membership, staged

#: Rows that a bucket of neighbouring ids should hold, and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 2000, 8192
SPACES = "[\\s\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def canonical(text: Column) -> Column:
    """NFKC, case folding, white space folding; null counts as empty.

    Spark has no function for the first two; the ICU library that it ships is
    called in the JVM by java_method. ASCII texts need neither.
    """
    text = F.coalesce(text, F.lit(""))
    compose = lambda x: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    fold = lambda x: F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), x, F.lit(True))
    plain = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(compose(fold(compose(text))))
    return F.btrim(F.regexp_replace(plain, SPACES, " "))


def printed(h1: Column, h2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0")))


def clashes(forms: DataFrame) -> DataFrame:
    """Of forms (h1, h2, form): those whose digest stands for several byte strings, as h1, h2, sha, nth (from 1).

    A bucket is summed up as its least and greatest form, map-side, so a hot one
    costs a row for each task.
    """
    mixed = forms.groupBy("h1", "h2").agg(F.min("form").alias("lo"), F.max("form").alias("hi")).where("lo != hi").select("h1", "h2")
    each = forms.join(mixed, ["h1", "h2"]).groupBy("h1", "h2", "form").agg(F.lit(1).alias("one"))
    return each.select("h1", "h2", F.sha2("form", 256).alias("sha"), F.row_number().over(Window.partitionBy("h1", "h2").orderBy("form")).alias("nth"))


def settled(df: DataFrame, odd: DataFrame, name: str, h: str) -> DataFrame:
    """Puts the fingerprint of digest columns {h}1, {h}2, {h}s into a column."""
    right = odd.select(F.col("h1").alias(f"{h}1"), F.col("h2").alias(f"{h}2"), F.col("sha").alias(f"{h}s"), F.col("nth").alias(f"{h}n"))
    more = F.when(F.col(f"{h}n") > 1, F.concat(F.lit("-"), F.col(f"{h}n").cast("string"))).otherwise("")
    return df.join(right, [f"{h}1", f"{h}2", f"{h}s"], "left").withColumn(name, F.concat(printed(F.col(f"{h}1"), F.col(f"{h}2")), more))


def digested(df: DataFrame, text: Column, h: str) -> DataFrame:
    """Adds {h}1, {h}2 and {h}s (sha256, which only tells clashing forms apart) of a text's canonical form."""
    df = df.withColumn("_form", canonical(text))
    h1, h2 = digest_keys(F.col("_form"))
    return df.withColumns({f"{h}1": h1, f"{h}2": h2, f"{h}s": F.sha2("_form", 256)}).drop("_form")


def shared(digests: DataFrame) -> DataFrame:
    return digests.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")


def formed(df: DataFrame, text: Column) -> DataFrame:
    df = df.select(canonical(text).alias("form"))
    h1, h2 = digest_keys(F.col("form"))
    return df.select(h1.alias("h1"), h2.alias("h2"), "form")


def fingerprint(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, fingerprint, group_rows.

    Null text counts as empty; repeated rows stay; an empty table gives an empty
    table; other columns are not read. group_rows counts the rows of the
    fingerprint. Null ids are compared with each other's.
    """
    docs = docs.select("doc_id", "text")
    rows = staged(digested(docs, F.col("text"), "h").drop("text"), "digests")
    held = formed(docs, F.col("text")).where(membership(shared(rows).select("h1"))(F.col("h1")))
    out = settled(rows, clashes(held), "fingerprint", "h")
    sizes = out.groupBy("fingerprint").agg(F.count("*").alias("group_rows"))
    return out.join(sizes, "fingerprint").select("doc_id", "fingerprint", "group_rows")


def beside_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the next document's id and text, by ascending id; after the last comes the first.

    Ids are cut at approximate quantiles, which are ids themselves, into buckets
    of neighbours. The row at which a bucket begins also goes to the bucket before
    it, the first of all to the last, so that each bucket knows all its followers
    and no task holds more than a bucket. Ties of id go by text, null ids first.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    n, least = rows.agg(F.count("*"), F.min(key)).first()
    if not n:
        return rows.select("doc_id", "text", F.col("doc_id").alias("next_id"), F.col("text").alias("next_text"))
    many = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    found = rows.agg(F.percentile_approx(key, [i / many for i in range(1, many)], 10 * many)).first()[0] if many > 1 else []
    starts = sorted({least, *found})
    step = max(1, int(len(starts) ** 0.5))
    array_of = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs])
    coarse = F.size(F.filter(array_of(starts[::step]), lambda s: s <= F.col("_key"))) - 1
    fine = F.size(F.filter(F.slice(array_of(starts), F.col("_coarse") * step + 1, F.lit(step)), lambda s: s <= F.col("_key")))
    rows = rows.withColumn("_key", key).withColumn("_coarse", coarse).withColumn("_bucket", F.col("_coarse") * step + fine - 1)
    begins = F.element_at(array_of(starts), F.col("_bucket") + 1) == F.col("_key")
    own = F.struct(F.col("_bucket").alias("bucket"), F.lit(0).alias("guard"))
    guard = F.struct(F.when(F.col("_bucket") > 0, F.col("_bucket") - 1).otherwise(len(starts) - 1).alias("bucket"), F.lit(1).alias("guard"))
    dealt = rows.withColumn("_at", F.explode(F.when(begins, F.array(own, guard)).otherwise(F.array(own))))
    w = Window.partitionBy("_at.bucket").orderBy("_at.guard", "_key", "text")
    dealt = dealt.select("doc_id", "text", "_at", "_key").withColumns({"next_id": F.lead("doc_id").over(w), "next_text": F.lead("text").over(w)})
    return dealt.where("_at.guard = 0").select("doc_id", "text", "next_id", "next_text")


def edited(text: Column, following: Column) -> Column:
    """The last quarter of a text's code points, rounded down, replaced by the first as many of the following text."""
    n = F.length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text (see edited and beside_next).

    Returns a row for each row of docs: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. An exact digest knows equal and
    different only, so likeness is 1 or 0. Null text counts as empty; a single
    document follows itself; an empty table gives an empty table.
    """
    pairs = beside_next(docs)
    change = edited(F.col("text"), F.col("next_text"))
    rows = digested(digested(pairs.withColumn("_edited", change), F.col("text"), "h"), F.col("_edited"), "e")
    following = digested(rows.withColumn("edited_sha256", F.sha2("_edited", 256)), F.col("next_text"), "f")
    rows = staged(following.withColumn("n_chars", F.length("text").cast("bigint")).drop("text", "next_text", "_edited"), "digests")

    stacked = rows.select(F.explode(F.array(*[F.struct(F.col(f"{h}1").alias("h1"), F.col(f"{h}2").alias("h2")) for h in "he"])).alias("d")).select("d.*")
    twice = staged(shared(stacked).toDF("_k1", "_k2"), "shared")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    plain = formed(texts, F.col("text")).where(membership(twice.select("_k1"))(F.col("h1")))
    altered_ids = rows.join(twice, (F.col("e1") == F.col("_k1")) & (F.col("e2") == F.col("_k2")), "left_semi").select(F.col("doc_id").alias("_id"), "next_id").distinct()
    needed = membership(altered_ids.select(F.explode(F.array(F.xxhash64("_id"), F.xxhash64("next_id"))).alias("h")))
    some = texts.where(needed(F.xxhash64("doc_id")))
    after = some.select(F.col("doc_id").alias("_then"), F.col("text").alias("_following"))
    altered = some.join(altered_ids, same("doc_id", "_id")).join(after, same("next_id", "_then"))
    forms = plain.unionByName(formed(altered, edited(F.col("text"), F.col("_following"))))
    odd = clashes(forms)
    for name, h in (("fingerprint", "h"), ("edited_fingerprint", "e"), ("_next_fingerprint", "f")):
        rows = settled(rows, odd, name, h)
    alike = lambda name: F.when(F.col("fingerprint") == F.col(name), 1.0).otherwise(0.0)
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", alike("edited_fingerprint").alias("near_edited"), alike("_next_fingerprint").alias("near_next")
    )
