"""Paragraph tables: documents to paragraphs, measures, perturbed copies with gold links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duolith.functions import text as T


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos, text of every line that isn't blank (spaces of Unicode only, as SQL's trim has it); pos counts all lines."""
    cut = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return cut.where(F.col("text").rlike("[^\\p{Zs}]"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, idx (from 0), text: the lines that aren't blank, counted anew.

    Rows with one doc_id, or without, are one document; its lines of one place stand by text.
    """
    w = Window.partitionBy("doc_id").orderBy("pos", "text")
    return lines(docs).select("doc_id", (F.row_number().over(w) - 1).alias("idx"), "text")


def rule(mod: int) -> Column:
    return (F.col("doc_id") * 31 + F.col("idx")) % mod


def perturbed(paras: DataFrame) -> DataFrame:
    """A second edition by fixed rules: some paragraphs dropped, some merged with the next, some swapped with it.

    Returns doc_id, idx (place in the copy), origin (array of source places), text.
    The origin carries identity through every change, so gold links are exact.
    """
    kept = paras.where(rule(17) != 0)
    w = Window.partitionBy("doc_id").orderBy("idx")
    joins = (F.lag("idx").over(w) == F.col("idx") - 1) & (F.lag(rule(13)).over(w) == 1)
    kept = kept.withColumn("head", F.when(F.coalesce(joins, F.lit(False)), F.col("idx") - 1).otherwise(F.col("idx")))
    parts = F.sort_array(F.collect_list(F.struct("idx", "text")))
    units = kept.groupBy("doc_id", "head").agg(parts.alias("parts"))
    key = F.col("head") + F.when((F.col("doc_id") * 31 + F.col("head")) % 19 == 2, 1.5).otherwise(0.0)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("key")) - 1
    units = units.withColumn("key", key)
    return units.select(
        "doc_id", place.alias("idx"), F.transform("parts", lambda p: p["idx"]).alias("origin"), F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("text")
    )


def gold_links(copy: DataFrame) -> DataFrame:
    """doc_id, src, tgt for every source paragraph that a copy carries."""
    return copy.select("doc_id", F.explode("origin").alias("src"), F.col("idx").alias("tgt"))


def measured(paras: DataFrame) -> DataFrame:
    """paras with their measures, taken once: han, words, loose, numbers, note, kind."""
    t = F.col("text")
    return paras.withColumns(
        {
            "han": T.han_chars(t),
            "words": T.en_words(t),
            "loose": F.regexp_count(F.regexp_replace(t, T.HAN, " "), F.lit(T.WORDISH)),
            "numbers": T.numbers(t),
            "note": T.note_likeness(t),
            "formulaish": T.formulaish(t),
            "struct_kind": T.struct_kind(t),
        }
    )
