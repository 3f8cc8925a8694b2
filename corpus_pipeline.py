"""A corpus pipeline of five stages over ``documents``.

Every stage works on all that its predecessor kept.  Stages are written as
Parquet to the folder that the cluster shares and read again as the next stage's
documents.  Toxic documents go; of each group of near copies one stays; secrets
are replaced; sources are mixed to their targets; what is left is encoded.

Null and empty texts are clean, are one group of near copies, hold no secret, have
size 0 in the mix and encode to no tokens.  Of repeated
rows one stays; ties between near copies go to the smallest doc_id, null last.
Empty tables give empty results.  Extra columns of ``documents``, whatever their
names, go along to the last stage, which returns its own columns.  Very long
texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmosaic.llm import bpe, mixing, secret_scan, simhash, toxic_segments
from cellmosaic.llm.common import Shared
from cellmosaic.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5.  Rows without a doc_id cannot be told apart and are judged by their text as all others."""
    model = toxic_segments.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxic_segments.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by their kind; n_chars follows."""
    redacted = secret_scan.redact(docs)
    if "n_chars" not in docs.columns:
        return redacted
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token ids of every copy."""
    return bpe.encode(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("secrets", redact_secrets), ("mixing", mix_sources), ("bpe", encode)]

#: Toxicity, secrets and BPE cannot be put into SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, shared = spark.read.parquet(f"{sf_dir}/documents.parquet"), Shared(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return made
        docs = shared.put(made)
    return docs
