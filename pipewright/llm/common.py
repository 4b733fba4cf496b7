"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipewright.session import checkpoint_dir, remove_path

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """`df` written to a new folder of the shared checkpoint directory and read again: cuts lineage."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _recording:
        _recording[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the folders that `saved` made for a table no longer read."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        remove_path(df.sparkSession, folder)


_recording: list[list[str]] = []


@contextmanager
def recorded(into: list[str]) -> Iterator[None]:
    """Notes the folders that `saved` makes meanwhile."""
    _recording.append(into)
    try:
        yield
    finally:
        _recording.pop()


def swept(made: list[str], docs: DataFrame) -> None:
    """Deletes the noted folders that `docs` doesn't read."""
    if made:
        read = docs.inputFiles()
        gone = [p for p in made if not any(p.rpartition("/")[2] in f for f in read)]
        made[:] = [p for p in made if p not in gone]
        for path in gone:
            remove_path(docs.sparkSession, path)


def input_parts(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions of the session, but at least `least`."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def documents(df: DataFrame) -> DataFrame:
    """doc_id and text of a documents table, whatever other columns it has."""
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def apart(docs: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run(docs), with columns that `run` doesn't know out of the way of its own names; the columns of `docs`."""
    known, names = {"doc_id", "text", "n_chars"}, docs.columns
    aside = [c if c in known else f"_c{i}" for i, c in enumerate(names)]
    return run(docs.toDF(*aside)).select(*aside).toDF(*names)


def held_out(doc_id: str | Column = "doc_id", folds: int = 7, fold: int = 2) -> Column:
    """crc32(doc_id as text) mod `folds` is `fold`; null ids aren't held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds == fold, F.lit(False))


def ascii_lower(c: Column) -> Column:
    """A-Z lowered, every other character as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts laid end to end and the offset of each (null: empty)."""
    a = texts.cast(pa.large_binary())
    a = a.fill_null(b"") if a.null_count else a
    buf, n = a.buffers(), len(a)
    off = np.frombuffer(buf[1], np.int64)[a.offset : a.offset + n + 1]
    data = np.frombuffer(buf[2], np.uint8) if buf[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def compact(b: pa.RecordBatch) -> pa.RecordBatch:
    """A copy whose buffers begin with its first row: some Arrow string kernels misread slices."""
    return b.take(pa.array(np.arange(b.num_rows)))


def sampled(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """The rows of least `key` (a 64-bit hash), at most `rows`: few more are sent to one task."""
    share = min(1.0, 2.0 * rows / max(df.count(), 1))
    low = df if share == 1.0 else df.where(key < int(-(2**63) + share * 2**64))
    return low.orderBy(key).limit(rows)


def by_bytes(batches: Iterable[pa.RecordBatch], most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches joined and cut so that each holds about `most` bytes of a column (a longer value stays whole)."""
    held, size = [], 0
    for b in batches:
        sizes = np.diff(flat_bytes(b[column])[1])
        at = 0
        while at < b.num_rows:
            room = np.cumsum(sizes[at:])
            take = int(np.searchsorted(room, most - size, "right"))
            if take == 0 and not held:
                take = 1
            if take:
                held.append(b.slice(at, take))
                size += int(room[take - 1])
                at += take
            if at < b.num_rows or size >= most:
                yield compact(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held, size = [], 0
    if held:
        yield compact(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
