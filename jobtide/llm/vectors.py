"""What the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches


def finite(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part: an id, finite components, and the table's most frequent length (the larger of equals)."""
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(finite(F.col("embedding")), F.lit(False)) & (F.size("embedding") > 0))
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("embedding") == (common["n"] if common else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def sampled(rows: DataFrame, column: str, most: int) -> np.ndarray:
    """At most ``most`` vectors by hash of their id, as a matrix on the driver."""
    key = "vec_id"
    picked = rows.select(key, column).orderBy(F.xxhash64(key, F.lit(7)), key).limit(most).toArrow()
    return matrix(picked[column])


def rows_of(column: np.ndarray) -> pa.Array:
    """A matrix as an Arrow column of lists."""
    n, d = column.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d, dtype=np.int32)), pa.array(column.reshape(-1)))
