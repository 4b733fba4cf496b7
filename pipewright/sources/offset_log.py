"""A topic log in files with a sparse offset index (SRC-2, SRC-4, SRC-9).

Each append writes its rows in ranges of (topic, partition, offset) and one index
row for every file and partition in it: the least and greatest offset. Both
become visible in one commit. A reader that starts at committed offsets joins
them with the index, takes the files that hold offsets at or after them and reads
only those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as M
from . import commits

INDEX = "file string, topic string, partition_id int, low bigint, high bigint, n bigint"


def append(log: DataFrame, root: str, batch: int, rows_per_file: int = 1_000_000, writer: str = "log") -> int:
    """Appends a batch of the log (topic, partition_id, kafka_offset, ...); once for each (writer, batch)."""
    spark, keys = log.sparkSession, ["topic", "partition_id", "kafka_offset"]

    def write(folder):
        place = folder("log")
        ranged = log.repartitionByRange(*keys).sortWithinPartitions(*keys)
        ranged.write.option("maxRecordsPerFile", rows_per_file).parquet(place)
        held = spark.read.schema(log.schema).parquet(place).groupBy(F.col("_metadata.file_path").alias("file"), "topic", "partition_id")
        held.agg(F.min("kafka_offset").alias("low"), F.max("kafka_offset").alias("high"), F.count("*").alias("n")).write.parquet(folder("index"))

    return commits.publish_batch(spark, root, writer, batch, write)


def index(spark: SparkSession, root: str) -> DataFrame:
    return commits.read_table(spark, root, "index", INDEX)


def latest_offsets(spark: SparkSession, root: str) -> DataFrame:
    """SRC-2 from the index alone."""
    return index(spark, root).groupBy("topic", "partition_id").agg((F.max("high") + 1).alias("latest_offset"))


def files_from(spark: SparkSession, root: str, positions: DataFrame) -> list[str]:
    """Files with offsets at or after some position (topic, partition_id, from_offset): names only."""
    met = index(spark, root).join(positions, ["topic", "partition_id"]).where(F.col("high") >= F.col("from_offset"))
    return sorted(r.file for r in met.select("file").distinct().collect())


def read_from(spark: SparkSession, root: str, positions: DataFrame, schema=M.EVENT_LOG) -> DataFrame:
    """SRC-9: the rows at or after each position, with the other columns of ``positions`` (a row
    comes once for every position it follows)."""
    files = files_from(spark, root, positions)
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return rows.join(positions, ["topic", "partition_id"]).where(F.col("kafka_offset") >= F.col("from_offset"))


def positions(committed: DataFrame, grid: DataFrame) -> DataFrame:
    """Where each group of ``grid`` (topic, partition_id, consumer_group) reads on: its commit, or 0."""
    j = grid.join(committed, ["consumer_group", "topic", "partition_id"], "left")
    return j.select("consumer_group", "topic", "partition_id", F.coalesce("committed_offset", F.lit(0)).cast("bigint").alias("from_offset"))


def unread(spark: SparkSession, root: str, committed: DataFrame, grid: DataFrame, schema=M.EVENT_LOG) -> DataFrame:
    """The messages each group has not read."""
    return read_from(spark, root, positions(committed, grid), schema)
