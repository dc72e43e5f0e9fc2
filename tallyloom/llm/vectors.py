"""Vectors as rows: which take part, their length, and tiles of a query set against all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the index that one task holds at most, and queries that meet them at once.
SHARD_ROWS = 16_384
TILE_QUERIES = 4_096
#: Small inputs are cut finer, for as many tasks as this.
LEAST_SHARDS = 16


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds neither null nor non-finite components."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))), F.lit(False))  # NaN is greater than all


def floors(vector: Column, scale: int) -> Column:
    """Components times `scale`, in double precision, rounded down to array<long>."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def width_of(vectors: DataFrame, column: str, *more: Column) -> tuple[int, int, list]:
    """(components of each vector, rows, values of the aggregates `more`); vectors of several lengths are an error."""
    least, most, rows, *rest = vectors.agg(F.min(F.size(column)), F.max(F.size(column)), F.count("*"), *more).first()
    if least != most:
        raise ValueError(f"vectors have between {least} and {most} components")
    return least or 0, rows, rest


def matrix(values: pa.Array | pa.ChunkedArray, width: int, kind: type = np.float64) -> np.ndarray:
    """An Arrow list column without nulls as rows of a numpy matrix."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def shard_count(rows: int) -> int:
    """Shards of an index of so many rows."""
    return max(-(-rows // SHARD_ROWS), min(LEAST_SHARDS, -(-rows // 1024)), 1)


def spread(n: int) -> Column:
    """A number under n for each row, by its place in the input: no key can be hot, and a task that runs again gives the same."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")


def tiles(index: DataFrame, queries: DataFrame, n_rows: int, n_queries: int) -> tuple[DataFrame, DataFrame]:
    """`index` and `queries` with columns (shard, tile), for a cogroup in which every query meets every row once.

    The query set lies in tiles of about TILE_QUERIES, the index in shards of about SHARD_ROWS; a shard is sent
    to each tile and a tile to each shard, so that a task holds one of both at a time, whatever the input.
    """
    n, m = shard_count(n_rows), max(1, -(-n_queries // TILE_QUERIES))
    numbers = lambda k: F.sequence(F.lit(0), F.lit(k - 1))
    return (
        index.withColumn("shard", spread(n)).withColumn("tile", F.explode(numbers(m))),
        queries.withColumn("tile", spread(m)).withColumn("shard", F.explode(numbers(n))),
    )
