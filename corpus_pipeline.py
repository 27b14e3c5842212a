"""The training-data pipeline: five stages over documents, each written and read again as the next one's input.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one the pieces of packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.llm import leaks, near_duplicates, packing, privacy, quality
from sylvan.llm.common import documents, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; the machine learns from the documents it is given."""
    machine = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.with_score(docs.select(*COLUMNS), machine, "_score")
    return scored.where(quality.predicted(F.col("_score")) == 1).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more)."""
    return near_duplicates.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = leaks.with_hits(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), name="_hits")
    return found.where(F.size("_hits") == 0).select(*COLUMNS)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by surrogates and n_chars counted again."""
    replaced = privacy.replace(docs.select(*COLUMNS), "surrogates-1")
    return replaced.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("PII", replace_personal_data),
    ("best-fit packing", pack),
]

#: No stage but decontamination by exact match could be said in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i}")
    return docs
