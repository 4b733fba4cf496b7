"""The registered queries of this package: one for each operator, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipewright.llm import clusters, decontaminate, id_store, licenses, negatives, oracle, packing, ppm, quality, rules, simhash, suffix_dedup, token_counts, toxicity
from pipewright.llm.common import recorded, swept, table
from pipewright.session import checkpoint_dir

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), end_id=0)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", F.round("_weight", 6).alias("weight"), F.col("_key").alias("gumbel_key"), F.col("_kept").alias("kept"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    id_store.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_BPE), end_id=2)
    return id_store.read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _tidy(query: Callable[[], DataFrame]) -> DataFrame:
    """The query's result; tables put aside on the way that it doesn't read are deleted."""
    made: list[str] = []
    with recorded(made):
        result = query()
    swept(made, result)
    return result


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = _tidy(lambda: toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "held_out", "score", "predicted")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(lambda: clusters.cluster(table(spark, sf_dir, "embeddings")))


def op13_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(lambda: negatives.mine(table(spark, sf_dir, "embeddings")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_quality_classifier, op3_license_scans, op4_suffix_array_dedup, op5_lm_scoring, op6_simhash_near_dedup, op7_benchmark_decontamination, op8_token_id_output, op9_token_counts, op10_quality_rules, op11_toxicity, op12_centroid_clustering, op13_hard_negative_mining)}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.QUERIES)
