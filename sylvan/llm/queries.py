"""The operators as registered queries, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, leaks, licences, near_duplicates, packing, privacy, quality, secrets, sharding, tokens
from .common import documents, new_path

TOKENIZER = "word_bpe_49k.json"
PRIVACY_KEY = "surrogates-1"
SHARDS = 24


def _tokenizer() -> str:
    return public_tokenizers.path(TOKENIZER)


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_likeness(documents(spark, sf_dir))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_tokens(spark, tokens.write_tokens(documents(spark, sf_dir), _tokenizer(), end_id=2))


def op3_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.simhash_components(documents(spark, sf_dir), size=3, bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_virtual_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    path = new_path(spark, "slot-map")
    sharding.write_map(spark, sharding.build_map(docs, SHARDS), path)
    edited = sharding.rebalance(docs, sharding.read_map(spark, path))
    if edited.moved:
        sharding.write_map(spark, edited, path)
    placed = sharding.assign(docs, sharding.read_map(spark, path))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    machine = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.with_score(docs.select("doc_id", "text"), machine)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", quality.predicted(F.col("score")).alias("predicted"))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = privacy.replace(documents(spark, sf_dir).select("doc_id", "text"), PRIVACY_KEY)
    counts = [F.size(F.filter("entities", _is(kind))).alias(f"n_{kind}") for kind in privacy.PATTERNS]
    return replaced.select("doc_id", "text", *counts)


def _is(kind: str):
    return lambda e: e == kind


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), _tokenizer(), end_id=0)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_document_fingerprints, op2_token_output, op3_simhash_components, op4_virtual_slot_shards, op5_quality_classifier, op6_pii_surrogates, op7_benchmark_decontamination, op8_licence_scan, op9_best_fit_packing, op10_secret_scan, pipeline)}

#: The licence scan only: the others need hashes, models, tokenizers or automata that SQL hasn't; tests/llm holds each against brute force.
ORACLE_SQL: dict[str, str] = {"op8_licence_scan": licences.oracle_sql()}
