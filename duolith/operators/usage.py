"""Cost, rates and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Prices for a million tokens (cached input, other input, output), and other names of models.
PRICES = {
    "qwen3.7-flash": ("0.04", "0.20", "0.80"),
    "deepseek-flash": ("0.02", "1.00", "4.00"),
    "deepseek-v4-pro": ("0.15", "4.50", "13.5"),
    "deepseek-reasoner": ("0.02", "1.00", "4.00"),
}
DEFAULT_MODEL = "deepseek-flash"
ALIASES = {"deepseek-v4-flash": "deepseek-flash", "deepseek-v4-flash-vision-exp": "deepseek-flash", "deepseek-chat": "deepseek-flash"}


def price_table(spark: SparkSession) -> DataFrame:
    """The price dimension; a handful of rows."""
    rows = [(m, *p) for m, p in PRICES.items()]
    out = spark.createDataFrame(rows, "model string, p_hit string, p_miss string, p_out string")
    return out.select("model", *[F.col(c).cast("decimal(18,6)").alias(c) for c in ("p_hit", "p_miss", "p_out")])


def priced_model(model: Column) -> Column:
    """The price list's name of a model: itself, its alias, the first name it contains, or the default."""
    m = F.lower(F.trim(F.coalesce(model, F.lit(""))))
    for a, b in ALIASES.items():
        m = F.when(m == a, b).otherwise(m)
    out = F.when(m.isin(list(PRICES)), m)
    for name in PRICES:
        out = out.when(F.contains(m, F.lit(name)), name)
    return out.otherwise(DEFAULT_MODEL)


def is_peak(ts: Column) -> Column:
    """Weekdays from 9 to 12 and from 14 to 18, in the session's time zone."""
    h = F.hour(ts)
    return (F.weekday(ts) < 5) & (h.between(9, 11) | h.between(14, 17))


def with_cost(usage: DataFrame) -> DataFrame:
    """usage (model, ts, prompt, cached, completion) with cost and saved as decimals; peak hours cost double."""
    prices = F.broadcast(price_table(usage.sparkSession))  # as many rows as PRICES
    rows = usage.withColumn("_model", priced_model(F.col("model"))).join(prices.withColumnRenamed("model", "_model"), "_model")
    factor = F.when(is_peak(F.col("ts")), 2).otherwise(1)
    miss = F.greatest(F.lit(0), F.col("prompt") - F.col("cached"))
    cost = factor * (F.col("cached") * F.col("p_hit") + miss * F.col("p_miss") + F.col("completion") * F.col("p_out")) / 1_000_000
    saved = factor * F.col("cached") * (F.col("p_miss") - F.col("p_hit")) / 1_000_000
    return rows.withColumns({"cost": cost.cast("decimal(18,6)"), "saved": saved.cast("decimal(18,6)")}).drop("_model", "p_hit", "p_miss", "p_out")


def estimated_tokens(n_pairs: Column, n_chapters: Column) -> dict[str, Column]:
    """F32: tokens that a run would take, by batches of 20 pairs and a part for each chapter."""
    batches = F.ceil(n_pairs / 20)
    return {"tokens_in": batches * 5600 + n_chapters * 200, "tokens_out": batches * 400 + n_chapters * 200}


def candidate_tokens(chars_src: Column, chars_tgt: Column, paras: Column) -> dict[str, Column]:
    """Q15: tokens of a section's annotation, times its windows of 40."""
    windows = F.when(paras > 80, F.ceil(paras / 40)).otherwise(1)
    return {"tokens_in": (chars_src / 4 + chars_tgt + 260) * windows, "tokens_out": (6 * paras + 60) * windows}


def sliding_rate(events: DataFrame, by: list[str], ts: str, seconds: int = 60, most: int = 20) -> DataFrame:
    """Events in the window that ends at each one, and whether there are more than allowed."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(*by).orderBy(at).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("in_window", F.count("*").over(w)).withColumn("over", F.col("in_window") > most)


def budget_states(spending: DataFrame, by: list[str], order: list[str], cost: str, soft: float, hard: float) -> DataFrame:
    """Running cost and what it allows: all, mapping only above the soft limit, nothing above the hard one."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum(cost).over(w)
    return spending.withColumn("spent", run).withColumn("state", F.when(F.col("spent") >= hard, "stop").when(F.col("spent") >= soft, "mapping").otherwise("all"))


def request_key(*parts: Column) -> Column:
    """Content address of a request."""
    return F.left(F.sha2(F.concat_ws("\n", *parts), 256), F.lit(32))
