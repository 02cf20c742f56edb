"""The corpus pipeline: documents of poor quality go, one of each group of near copies stays, benchmark leaks go, secrets are masked, what is left is packed.

Each stage takes (spark, docs, sf_dir), where docs has the columns of documents, and works on all that the stage before kept. All but the
last return those columns. Rows without a doc_id pass through all stages; a null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import decontaminate, packing, prob_minhash, quality, secrets
from voxloom.llm.common import table, written

#: Documents that score less are rejected.
QUALITY = 0.7
MASK = "[SECRET]"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score, by a field trained on the labels of these documents, is QUALITY or more."""
    field = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.with_scores(docs, field, "_quality").where(F.col("_quality") >= QUALITY).drop("_quality")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, that of the smallest doc_id. Texts are judged, not ids: different texts under one doc_id all stay."""
    return prob_minhash.representatives(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each stretch of secrets in their texts replaced by MASK."""
    masked = secrets.redact(docs, MASK)
    return masked.withColumn("n_chars", F.char_length("text").cast(masked.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("benchmark_leaks", drop_leaks),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]
#: A trained field, signatures and a tokenizer are beyond SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
