"""Relational joins: keys, k-th of a number, as-of, nearest, bands, dictionaries (J, K, U)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def key_join(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Left join with the first right row of each key."""
    return left.join(first_of(right, keys, order), list(keys), "left")


def accepted(joined: DataFrame, hit: Column, least: int = 3, share: float = 0.5) -> DataFrame:
    """Whether a mapping is used: enough hits, and enough of all rows."""
    n = F.count(F.when(hit, 1))
    return joined.agg(F.count("*").alias("n_rows"), n.alias("n_hits"), ((n >= least) & (n >= share * F.count("*"))).alias("accepted"))


def kth_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: str, right_order: str) -> DataFrame:
    """The k-th row of a key meets the k-th; unmatched rows of both sides stay."""
    a = left.withColumn("kth", F.row_number().over(Window.partitionBy(*keys).orderBy(left_order)))
    b = right.withColumn("kth", F.row_number().over(Window.partitionBy(*keys).orderBy(right_order)))
    return a.join(b, [*keys, "kth"], "full_outer")


def asof_backward(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, value: str, *, strict: bool = True) -> DataFrame:
    """For each left row the value of the last right row before it (or at it, if not strict).

    One sort of the union by key: no pairs are made. right has by, on, value.
    """
    a = left.withColumns({"_side": F.lit(0 if strict else 2), value: F.lit(None).cast(dict(right.dtypes)[value])})
    b = right.select(*by, on, value).withColumn("_side", F.lit(1))
    w = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(value, F.last(F.when(F.col("_side") == 1, F.col(value)), ignorenulls=True).over(w)).where("_side != 1").drop("_side")


def nearest(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, value: str) -> DataFrame:
    """For each left row the right row at the least distance; ties go to the lower one."""
    kind = dict(right.dtypes)
    a = left.withColumns({"_right": F.lit(False), value: F.lit(None).cast(kind[value])})
    b = right.select(*by, on, value).withColumn("_right", F.lit(True))
    seen = F.when(F.col("_right"), F.struct(F.col(on).alias("at"), F.col(value).alias("v")))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(on, F.desc("_right"))
    both = both.withColumns(
        {
            "_low": F.last(seen, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "_high": F.first(seen, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
        }
    ).where("not _right")
    low = F.col("_low").isNotNull() & (F.col("_high").isNull() | (F.col(on) - F.col("_low.at") <= F.col("_high.at") - F.col(on)))
    best = F.when(low, F.col("_low")).otherwise(F.col("_high"))
    return both.withColumns({value: best["v"], "distance": F.abs(best["at"] - F.col(on))}).drop("_right", "_low", "_high")


def cells_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_at: str, right_at: str, width: int) -> DataFrame:
    """Pairs whose places differ by `width` at most, through cells of that width."""
    cell = lambda c: F.floor(F.col(c) / (width + 1))
    a = left.withColumn("_cell", F.explode(F.array(cell(left_at) - 1, cell(left_at), cell(left_at) + 1)))
    b = right.withColumn("_cell", cell(right_at))
    return a.join(b, [*by, "_cell"]).where(F.abs(F.col(left_at) - F.col(right_at)) <= width).drop("_cell")


band_join = cells_join


def dice_lexicon(pairs: DataFrame, left: str, right: str, *, least: int = 2, keep: int = 3) -> DataFrame:
    """From rows with two token arrays, the `keep` counterparts of highest Dice coefficient of each left token.

    Ties go to the smaller token. Counts are pre-aggregated before they are shuffled.
    """
    a, b = F.array_distinct(left), F.array_distinct(right)
    n_left = pairs.select(F.explode(a).alias("w")).groupBy("w").agg(F.count("*").alias("n_w")).where(F.col("n_w") >= least)
    n_right = pairs.select(F.explode(b).alias("g")).groupBy("g").agg(F.count("*").alias("n_g"))
    both = pairs.select(F.explode(a).alias("w"), b.alias("_g")).select("w", F.explode("_g").alias("g")).groupBy("w", "g").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    scored = both.join(n_left, "w").join(n_right, "g").withColumn("dice", 2.0 * F.col("n") / (F.col("n_w") + F.col("n_g")))
    w = Window.partitionBy("w").orderBy(F.desc("dice"), "g")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep).select("w", "g", "n", "dice", "rank")


def toc_titles(docs: DataFrame, toc: DataFrame) -> DataFrame:
    """A document's title from the table of contents by its file name, where it has one."""
    names = first_of(toc.select(F.substring_index("path", "/", -1).alias("_name"), F.col("title").alias("_toc")), ["_name"], ["_toc"])
    out = docs.withColumn("_name", F.substring_index("path", "/", -1)).join(names, "_name", "left")
    return out.withColumn("title", F.coalesce(F.nullif("_toc", F.lit("")), "title")).drop("_name", "_toc")


def fold_acknowledgments(units: DataFrame, source_has_own: bool, source_preface_has: bool) -> DataFrame:
    """An acknowledgments unit right after a preface joins it, if the source keeps its own inside the preface.

    units: book, ord, title. Returns them with target_ord, the unit that each belongs to.
    """
    w = Window.partitionBy("book").orderBy("ord")
    thanks = F.col("title").rlike("(?i)^(致谢|鸣谢|acknowledg\\w*)")
    preface = F.lag("title").over(w).rlike("(?i)^(前言|序言|自序|preface|foreword)")
    if source_has_own or not source_preface_has:
        return units.withColumn("target_ord", F.col("ord"))
    return units.withColumn("target_ord", F.when(thanks & F.coalesce(preface, F.lit(False)), F.lag("ord").over(w)).otherwise(F.col("ord")))


def mapping_integrity(maps: DataFrame, n_src: Column, n_tgt: Column, *, coverage: float = 0.8) -> DataFrame:
    """Checks of a mapping (key, ord, src, tgt): bounds, uniqueness, order, coverage; one row for each key."""
    w = Window.partitionBy("key").orderBy("ord")
    rows = maps.withColumns({"_back": F.col("tgt") < F.lag("tgt").over(w), "_n_src": n_src, "_n_tgt": n_tgt})
    inside = F.coalesce(F.col("src").between(0, F.col("_n_src") - 1) & F.col("tgt").between(0, F.col("_n_tgt") - 1), F.lit(True))
    out = rows.groupBy("key").agg(
        F.bool_and(inside).alias("in_bounds"),
        (F.count("tgt") == F.count_distinct("tgt")).alias("unique_targets"),
        (~F.coalesce(F.bool_or("_back"), F.lit(False))).alias("monotone"),
        (F.count_distinct("src") / F.max("_n_src")).alias("coverage"),
    )
    return out.withColumn("valid", F.col("in_bounds") & F.col("unique_targets") & F.col("monotone") & (F.col("coverage") >= coverage))


def dead_references(refs: DataFrame, anchors: DataFrame, name: str) -> DataFrame:
    """References whose anchor doesn't exist."""
    return refs.join(anchors.select(name).distinct(), name, "left_anti")


def is_refinement(candidate: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """U4: whether every group (array `src`) of a candidate lies within a current group and no source is lost."""
    inside = candidate.alias("c").join(current.alias("u"), (F.col(f"c.{key}") == F.col(f"u.{key}")) & (F.size(F.array_except("c.src", "u.src")) == 0), "left_anti")
    outside = inside.groupBy(key).agg(F.count("*").alias("outside"))
    lost = current.select(key, F.explode("src").alias("i")).exceptAll(candidate.select(key, F.explode("src").alias("i")).distinct()).groupBy(key).agg(F.count("*").alias("lost"))
    out = current.select(key).distinct().join(outside, key, "left").join(lost, key, "left").fillna(0, ["outside", "lost"])
    return out.withColumn("refines", (F.col("outside") == 0) & (F.col("lost") == 0))


def proportional_place(after: Column, n: Column, n_pairs: Column) -> Column:
    """A paragraph's place among pairs, in proportion, rounded half to even."""
    at = F.bround((after + 1) / n * n_pairs) - 1
    return F.greatest(F.lit(0), F.least(at, n_pairs - 1)).cast("int")


def note_offsets(pairs: DataFrame, key: Sequence[str], order: str, length: str) -> DataFrame:
    """Exclusive running sums of lengths, the offset of each part in its group."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return pairs.withColumn("offset", F.coalesce(F.sum(length).over(w), F.lit(0)))


def owners(places: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """The span (key, span_id, low, high) that owns each place (key, at); the narrowest one, then the first.

    Spans are laid over cells whose width doubles up to their own, so a place meets
    at most the spans of its own cell at each width, not all of its group.
    """
    width = F.greatest(F.lit(0), F.ceil(F.log2(F.col("high") - F.col("low") + 1))).cast("int")
    shift = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_w"))).cast("bigint")
    laid = spans.withColumn("_w", width).withColumn("_cell", F.explode(F.array_distinct(F.array(shift("low"), shift("high")))))
    widths = laid.select(key, "_w").distinct()
    near = places.join(widths, key).withColumn("_cell", shift("at")).join(laid, [key, "_w", "_cell"]).where(F.col("at").between(F.col("low"), F.col("high")))
    return first_of(near.drop("_w", "_cell"), [key, "at"], [F.col("high") - F.col("low"), "span_id"])
