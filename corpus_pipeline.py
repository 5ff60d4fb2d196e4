"""The corpus pipeline: each stage is written and read again by the next one.

Toxic documents go, boilerplate lines go, of near copies one stays, documents that hold a passage
of the benchmark go, and the rest is encoded and decoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resurvey.llm import bpe, decontam, line_dedup, near_dedup, toxicity
from resurvey.llm.base import DOCUMENT_COLUMNS, fresh_path, only, table

RANKS = "byte_bpe_multi_50k.tiktoken"
# Smaller blocks than the operator's own: executors have held four other stages before this one.
BLOCK_BYTES = 3 << 20


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic go."""
    return toxicity.without_toxic(only(docs, *DOCUMENT_COLUMNS), table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, except from copies of whole documents; documents stay; n_chars follows the text."""
    cleaned = line_dedup.remove_boilerplate(only(docs, *DOCUMENT_COLUMNS))
    return line_dedup.with_length(only(cleaned, *DOCUMENT_COLUMNS))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.without_copies(only(docs, *DOCUMENT_COLUMNS))


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontam.without_leaks(only(docs, *DOCUMENT_COLUMNS), table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document and what they decode to: doc_id, n_tokens, ids, text."""
    ranks = public_tokenizers.path(RANKS)
    return bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, block_bytes=BLOCK_BYTES, decode=True).select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.decode("decoded", "UTF-8").alias("text")
    )


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("decontamination", leak_stage),
    ("byte bpe", token_stage),
]
# A fitted classifier and BPE merges are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
