"""Small-table snapshots and append-only logs on any Hadoop file system.

No ACID table format is available, so (SURVEY 7.3):

* registry-like tables are written as a new ``v=N+1`` folder, then a
  one-line pointer file ``_CURRENT`` is replaced; readers resolve the
  pointer, so a change is all-or-nothing (RTE-4);
* logs (events, DLQ rows, DLQ transitions) are append-only and written per
  micro-batch into ``batch_id=N`` partitions with dynamic overwrite, so a
  rerun of the same batch replaces its own output and nothing else.

Paths are whatever shared file system the cluster uses (HDFS, object store,
or a local folder in tests).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "_CURRENT"


def jvm_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return jvm, fs, p


def current_version(spark: SparkSession, root: str) -> int | None:
    """The version the pointer names, or None before the first write."""
    jvm, fs, p = jvm_path(spark, f"{root}/{POINTER}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        line = reader.readLine()
    finally:
        stream.close()
    return int(line.strip().split("=", 1)[1].split("/")[0])


def _current_folder(spark: SparkSession, root: str, version: int | None) -> str | None:
    jvm, fs, p = jvm_path(spark, f"{root}/{POINTER}{'' if version is None else f'.{version}'}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        stream.close()
    return line.strip()


def write_snapshot(df: DataFrame, root: str) -> int:
    """Write ``df`` as the next version and switch the pointer to it.

    Each write has a folder of its own, ``v=N/<unique name>``, and the pointer
    names it, so a failed write leaves the previous version current and the
    next attempt isn't in its way. For one writer per table; several use
    ``commits.update_table``.
    """
    spark = df.sparkSession
    cur = current_version(spark, root)
    nxt = (cur or 0) + 1
    folder = f"v={nxt}/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{root}/{folder}")
    for name in (f"{POINTER}.{nxt}", POINTER):  # the version's own pointer, then the current one
        _point(spark, f"{root}/{name}", f"{root}/.{POINTER}.{uuid.uuid4().hex}", folder)
    return nxt


def _point(spark: SparkSession, path: str, scratch: str, folder: str) -> None:
    jvm, fs, final = jvm_path(spark, path)
    tmp = jvm.org.apache.hadoop.fs.Path(scratch)
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(f"{folder}\n", "utf-8"))
    finally:
        out.close()
    fc = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        final.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    opts = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    opts[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    fc.rename(tmp, final, opts)


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The current (or a given) version of a snapshot table."""
    folder = _current_folder(spark, root, version)
    if folder is None:
        raise FileNotFoundError(f"no snapshot under {root}")
    return spark.read.parquet(f"{root}/{folder}")


def append_batch(df: DataFrame, root: str, batch_id: int, partition_by: tuple[str, ...] = ()) -> None:
    """Append one micro-batch to a log; a rerun of the batch replaces only
    its own ``batch_id`` partition (dynamic partition overwrite)."""
    (df.withColumn("batch_id", F.lit(int(batch_id))).write.option("partitionOverwriteMode", "dynamic")
     .mode("overwrite").partitionBy("batch_id", *partition_by).parquet(root))


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Materialise ``df`` in the cluster's shared checkpoint folder
    (``spark.checkpoint.dir``; a scratch folder only when unset, as in
    tests) so long iterative plans stop growing and survive executor loss."""
    from ..session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
