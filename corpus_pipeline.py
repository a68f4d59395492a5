"""A corpus pipeline: quality, exact copies, near copies, personal data, packing.

Each stage takes the rows that the one before kept, as ``documents``; all but the last return the columns
of ``documents``. ``run`` writes every stage as Parquet in the shared folder and reads it back, so a
lost executor costs a stage's tasks, never the stages before.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelake.llm import exact_dedup, packing, privacy, quality, simhash
from treelake.llm.common import cut


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives at least even odds of being good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.classify(docs, labels, keep=True)
    return scored.where(F.col("__score") >= 0.5).drop("__score")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class at a similarity of 0.8 or more on five-word shingles."""
    return simhash.drop_near_copies(docs, words=5, similarity=0.8)


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return privacy.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("pii", privacy_stage),
          ("packing", packing_stage)]
#: A trained classifier and a tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
