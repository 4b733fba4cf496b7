"""DLQ rows laid out for lookups by id (SRC-6, SRC-7).

Each append writes folders of id buckets (a hash of the id), rows sorted by id within,
and Parquet Bloom filters on the id. A lookup names its bucket, so the other folders aren't
listed, and inside the bucket row groups whose statistics or filter exclude
the id aren't read. Appends are commits (``commits.publish_batch``): whole, and once
for each batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import model as M
from . import commits

BUCKETS, ROWS_PER_GROUP = 64, 20_000


def _bucket(event_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(event_id), F.lit(buckets)).cast("int")


def append(dlq: DataFrame, root: str, batch: int, buckets: int = BUCKETS, writer: str = "dlq") -> int:
    """Appends DLQ rows; the number of buckets is kept for each append, so it can grow with the data."""
    def write(folder):
        rows = dlq.withColumn("id_bucket", _bucket(F.col("id"), buckets)).repartition("id_bucket").sortWithinPartitions("id_bucket", "id")
        (rows.write.partitionBy("id_bucket").option("parquet.bloom.filter.enabled#id", "true")
         .option("parquet.block.row.count.limit", str(ROWS_PER_GROUP)).parquet(folder(f"dlq-{buckets}")))

    return commits.publish_batch(dlq.sparkSession, root, writer, batch, write)


def _parts(spark: SparkSession, root: str) -> list[tuple[int, list[str]]]:
    """(buckets, folders) of all appends."""
    found: dict[int, list[str]] = {}
    for e in commits.entries(spark, root).values():
        for table, folders in e["tables"].items():
            found.setdefault(int(table.rpartition("-")[2]), []).extend(f"{root}/{f}" for f in folders)
    return sorted(found.items())


def _read(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.read.schema(T.StructType([*M.DLQ_EVENTS.fields, T.StructField("id_bucket", T.IntegerType())])).parquet(*folders)


def by_id(spark: SparkSession, root: str, event_id: str) -> DataFrame:
    """SRC-6: the rows of one id, from its bucket of each append."""
    out = spark.createDataFrame([], M.DLQ_EVENTS)
    for buckets, folders in _parts(spark, root):
        for folder in folders:
            hit = _read(spark, [folder]).where((F.col("id_bucket") == _bucket(F.lit(event_id), buckets)) & (F.col("id") == event_id))
            out = out.unionByName(hit.drop("id_bucket"))
    return out


def by_ids(spark: SparkSession, root: str, ids: DataFrame) -> DataFrame:
    """SRC-7: the rows of many ids, joined bucket by bucket (a left semi join that keeps to
    the buckets named)."""
    out = spark.createDataFrame([], M.DLQ_EVENTS)
    for buckets, folders in _parts(spark, root):
        wanted = ids.select("id", _bucket(F.col("id"), buckets).alias("id_bucket")).distinct()
        for folder in folders:
            out = out.unionByName(_read(spark, [folder]).join(wanted, ["id_bucket", "id"], "left_semi").drop("id_bucket"))
    return out
