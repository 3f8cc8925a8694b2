"""The queries of the text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmosaic.llm import bpe, digests, mixing, page_text, pseudo_likelihood, repeat_spans, repetition, secret_scan, simhash, toxic_segments

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_quality(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxic_segments.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    held_out = F.expr("coalesce(crc32(CAST(doc_id AS string)) % 5 = 0, false)")
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), F.size("passages").alias("n_passages"))


def op3_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.with_edits(_table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(_table(spark, sf_dir, "pages"))


def op6_repeat_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_spans.remove_repeats(_table(spark, sf_dir, "documents"), keep_first=False, digests=True).withColumnRenamed("kept", "kept_sha256")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents")).drop("found")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(_table(spark, sf_dir, "documents"), size=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def op9_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.score(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_repetition, op2_toxicity, op3_canonical_digest, op4_bpe, op5_page_text, op6_repeat_spans, op7_secrets, op8_simhash, op9_pseudo_likelihood, op10_mixing)
    return {f.__name__: f for f in own}


#: The mix in SQL; runs of bytes outside the blanks are words.
OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM sources),
leveled AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
      - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight::DOUBLE, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER (ORDER BY source_size::DOUBLE / weight::DOUBLE, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM weighed),
capped AS (SELECT *, 2.0::DOUBLE * source_size::DOUBLE <= level * weight::DOUBLE AS full_up FROM leveled),
free AS (SELECT arg_min(level, source_size::DOUBLE / weight::DOUBLE) AS level FROM capped WHERE NOT full_up),
targets AS (
  SELECT source, source_size, CASE WHEN full_up THEN 2.0::DOUBLE * source_size::DOUBLE ELSE (SELECT level FROM free) * weight::DOUBLE END AS target FROM capped),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5('mix-1:' || coalesce(s.doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE AS draw
  FROM sized s LEFT JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_mixing": OP10_SQL}
