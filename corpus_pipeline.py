"""The training-data pipeline: stages over `documents`, each reading what its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from pipewright.llm import decontaminate, packing, quality, simhash, suffix_dedup
from pipewright.llm.common import recorded, saved, swept, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Tables that stages put aside in the shared folder.
_aside: list[str] = []


def stage(function: Stage) -> Stage:
    """A stage's input was written by then, so what earlier stages put aside, and `docs` doesn't read, is deleted."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        swept(_aside, docs)
        with recorded(_aside):
            return function(spark, docs, sf_dir)

    return run_stage


@stage
def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling doesn't draw go."""
    return quality.drawn(docs, table(spark, sf_dir, "labels"))


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays: the one of smallest doc_id."""
    return simhash.keep_one(docs)


@stage
def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that start earlier too are cut out of the texts; every document stays."""
    return suffix_dedup.remove(docs)


@stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as pieces of token sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [("quality_filter", quality_filter), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("decontamination", decontaminated), ("packing", pack)]

#: Fingerprints, suffix sorting and token ids can't be said in SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
