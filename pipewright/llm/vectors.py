"""Integer vectors of an embeddings table, as the vector operators share them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, DIM = 256, 64
#: Larger components would let a squared distance or an inner product leave a long.
MOST = 1 << 27


def whole(vector: Column, dim: int = DIM) -> Column:
    """Has `dim` components, all of them numbers whose integer form is at most MOST; false for null."""
    number = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) <= F.lit(MOST / SCALE))
    return F.coalesce((F.size(vector) == dim) & F.forall(vector, number), F.lit(False))


def integers(vector: Column) -> Column:
    """floor(256 * x) of each component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))


def matrix(column: pa.Array, dim: int = DIM) -> np.ndarray:
    """A list column as rows of 64-bit integers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def rows(df: DataFrame, dim: int, *others: str) -> DataFrame:
    """vec_id, the other columns named and x, the integer vector, of rows whose vector is whole."""
    keep = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), *others, F.col("embedding").alias("_e"))
    return keep.where(whole(F.col("_e"), dim)).select("vec_id", *others, integers(F.col("_e")).alias("x"))
