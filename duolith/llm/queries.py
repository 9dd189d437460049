"""Queries of the training-data operators over the synthetic tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duolith.llm import bpe, chat, fingerprint, html_text, langid, linededup, media, omh, packing, quality
from duolith.llm.common import staged, table


def op1_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.near_classes(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.clean(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts look like control marks."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], rows.schema)
    return chat.digest_conversations(rows.unionByName(own))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op4: the payloads that are read back."""
    return op4_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes")


def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op9: decoding gives the text."""
    return op9_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op10: the edited texts."""
    return op10_fingerprint(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def packing_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op3: documents whose pieces leave out or repeat a token, and sequences with gaps or too many tokens; none may."""
    pieces = staged(op3_packing(spark, sf_dir), "pieces")
    ends = lambda at, by: (F.col(at) != F.coalesce(F.lag(F.col(at) + F.col("length")).over(Window.partitionBy(*by).orderBy(at)), F.lit(0))).cast("int")
    docs = pieces.withColumn("_gap", ends("start", ["doc_id"])).groupBy("doc_id").agg(((F.sum("_gap") > 0) | (F.sum("length") != F.max("doc_tokens"))).alias("bad"))
    seqs = pieces.withColumn("_gap", ends("offset", ["sequence_id"])).groupBy("sequence_id").agg(((F.sum("_gap") > 0) | (F.sum("length") > 2048)).alias("bad"))
    sums = docs.agg(F.count("*").alias("documents"), F.count_if("bad").alias("broken_documents"))
    return sums.join(seqs.agg(F.count_if("bad").alias("broken_sequences")))  # one row each


QUERIES = {f.__name__: f for f in (op1_near, op2_quality, op3_packing, op4_media, op5_language, op6_html, op7_lines, op8_chat, op9_bpe, op10_fingerprint, media_payloads, decoded_texts, edited_texts, packing_checks)}

MARKS = "length(regexp_replace({0}, '[^\\\\<\\[]', '', 'g'))"
ORACLE_SQL: dict[str, str] = {
    "op8_chat": f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS bigint) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  cast(sum(15 + 2 * (length(role) + {MARKS.format('role')}) + length(text) + {MARKS.format('text')}) AS bigint) AS formatted_chars, false AS rewrites_history
FROM c GROUP BY conv_id""",
    "media_payloads": r"""WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), n AS (SELECT doc_id, b, octet_length(b) AS n_bytes FROM d),
  p AS (SELECT *, CASE WHEN n_bytes = 0 THEN 64 ELSE (64 - n_bytes % 64) % 64 END AS pad FROM n)
SELECT doc_id, n_bytes, n_bytes + pad AS payload_bytes, sha256(b || repeat('\x00'::BLOB, pad)) AS payload_sha256, n_bytes + pad + 44 AS media_bytes FROM p""",
    "decoded_texts": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents",
    "edited_texts": """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
  f AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id, text), first_value(text) OVER (ORDER BY doc_id, text)) AS following FROM d)
SELECT doc_id, n AS n_chars, sha256(substring(text, 1, n - n // 4) || substring(following, 1, n // 4)) AS edited_sha256 FROM f""",
    "packing_checks": "SELECT count(DISTINCT doc_id) AS documents, 0 AS broken_documents, 0 AS broken_sequences FROM documents",
}
