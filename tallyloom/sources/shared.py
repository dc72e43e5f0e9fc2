"""Tables between the steps of a job: a shared folder, lineage cuts, and broadcasts bounded in bytes."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast only when its measured bytes stay within this bound.
BROADCAST_BYTES = 16 << 20
#: Rows of a table that `dealt` gives to one task, about.
TASK_ROWS = 1 << 15
#: Bytes that a row takes in a broadcast table beside its values.
_ROW_BYTES = 32


@functools.cache
def _own_dir() -> tempfile.TemporaryDirectory:
    return tempfile.TemporaryDirectory(prefix="tallyloom-")  # removed when the process ends


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; where none is set, a temporary one in local mode and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own_dir().name


#: Folders written in the runs under way, innermost last.
_runs: list[list[str]] = []


@contextmanager
def run_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes the folders that `materialize` wrote within it when it ends: write or collect results inside."""
    folders: list[str] = []
    _runs.append(folders)
    try:
        yield
    finally:
        _runs.remove(folders)
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)  # noqa: SLF001
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)  # noqa: SLF001


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _runs:
        _runs[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """`rows` dealt by `keys` to so many tasks that each gets about `TASK_ROWS`, however many rows there are.

    Groups and windows by these keys need no other shuffle, and all that is made of a row stays in its task; tasks joined by the
    bytes of the shuffled rows would not know how much that is. Reads `rows` once to count them, which a scan answers from its footers.
    """
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    return rows.repartition(tasks, *keys)


def _bytes(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value)
    elif isinstance(kind, T.ArrayType):
        fixed = isinstance(kind.elementType, (T.NumericType, T.BooleanType))
        size = F.size(value) * 8 if fixed else F.aggregate(value, F.lit(0), lambda n, x: n + _bytes(x, kind.elementType).cast("int"))
    elif isinstance(kind, T.StructType):
        size = sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(0))
    else:
        size = F.lit(16 if isinstance(kind, T.DecimalType) else 0)
    return 8 + F.coalesce(size, F.lit(0))


def table_bytes(df: DataFrame) -> int:
    """Bytes that `df` takes in memory, about; reads it once."""
    row = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(_ROW_BYTES))
    return df.agg(F.sum(row.cast("long"))).first()[0] or 0


def shuffled(df: DataFrame) -> DataFrame:
    """`df` with a hint to sort and merge, so that Spark broadcasts no side of an equi-join with it.

    Spark sizes a table by its compressed files and takes an explode for one row each, so it may broadcast what the driver can't hold.
    """
    return df.hint("merge")


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if its measured bytes are within `limit`; else `shuffled`.

    `df` should be cheap to read (a scan or a materialized table).
    """
    return F.broadcast(df) if table_bytes(df) <= limit else shuffled(df)
