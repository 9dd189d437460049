"""The flagship plan: documents, their perturbed edition, aligned paragraph by paragraph, audited and scored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duolith.operators import alignment, audit, corpus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def editions(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Measured paragraphs of the documents and of their copies."""
    source = corpus.paragraphs(docs)
    return source, corpus.perturbed(source)


def aligned(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links, with a lexicon learned from a first alignment, and both editions."""
    source, copy = editions(docs)
    links = alignment.align(corpus.measured(source), corpus.measured(copy), unit="words", k=1.0, **({"lexicon": True} | options))
    return links, source, copy


def audited(docs: DataFrame) -> DataFrame:
    """Each document's alignment under the calibrated ruler."""
    links, source, copy = aligned(docs)
    return audit.audit_calibrated(audit.paired_texts(links, source, copy, "doc_id"), ["doc_id"])


def scores_by_language(docs: DataFrame, **options) -> DataFrame:
    """Precision, recall and F1 of found links against gold, by language."""
    links, _, copy = aligned(docs, **options)
    langs = docs.select("doc_id", "lang")
    found = audit.exploded_links(links, "doc_id").join(langs, "doc_id").select("lang", F.concat_ws("/", "doc_id", "src").alias("src"), "tgt")
    gold = corpus.gold_links(copy).join(langs, "doc_id").select("lang", F.concat_ws("/", "doc_id", "src").alias("src"), "tgt")
    return audit.link_scores(found, gold, ["lang"])
