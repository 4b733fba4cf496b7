"""Readers for the input tables and the event intake (SRC-8, SRC-9)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
                 "lineitem", "events", "documents", "embeddings", "pages",
                 "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory (column pruning and filter
    pushdown reach the scan because nothing is materialised here)."""
    configure(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_events(spark: SparkSession, path: str, fmt: str = "parquet",
                schema=None, **options) -> DataFrame:
    """SRC-8: batch intake of events, any number of topics in one frame.

    ``fmt`` is any Spark batch source: parquet, json (JSON lines), or kafka
    when the connector is on the classpath (``value`` is cast from BINARY).
    """
    configure(spark)
    if fmt == "kafka":
        options = {"includeHeaders": "true", **options}
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    if fmt == "kafka":
        df = kafka_to_events(df)
    return df


def read_event_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                      max_files_per_trigger: int | None = None, **options) -> DataFrame:
    """SRC-9: streaming intake (file source by default, Kafka when present)."""
    configure(spark)
    if fmt == "kafka":
        options = {"includeHeaders": "true", **options}
    reader = spark.readStream.format(fmt).options(**options)
    if fmt != "kafka":
        reader = reader.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    df = reader.load(path) if path else reader.load()
    if fmt == "kafka":
        df = kafka_to_events(df)
    return df


def kafka_to_events(df: DataFrame) -> DataFrame:
    """Log source rows -> the event_log shape (BINARY cast at the edge).

    ``event_id`` is the row's position, unique over partitions:
    ``topic/partition/offset``. A header key that comes again keeps its last value.
    """
    headers = F.coalesce(F.col("headers"), F.array())
    last = F.filter(headers, lambda h, i: ~F.exists(
        F.slice(headers, i + 2, F.greatest(F.size(headers), F.lit(1))), lambda x: x["key"] == h["key"]))
    return df.select(
        F.concat_ws("/", "topic", F.col("partition").cast("string"), F.col("offset").cast("string")).alias("event_id"),
        F.col("topic"),
        F.col("partition").cast("int").alias("partition_id"),
        F.col("offset").cast("bigint").alias("kafka_offset"),
        F.col("key").cast("string").alias("msg_key"),
        F.col("value").cast("string").alias("payload"),
        F.col("timestamp").cast("timestamp_ntz").alias("ts"),
        F.map_from_entries(F.transform(
            F.filter(last, lambda h: h["key"].isNotNull()),
            lambda h: F.struct(h["key"], h["value"].cast("string")))).alias("headers"),
    ).withColumn("producer_id", F.col("headers")[F.lit("pw-producer-id")])
