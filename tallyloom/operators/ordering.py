"""Places in a global order without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.sources.shared import materialize


def ranked(rows: DataFrame, order: list[Column], limit: int | None = None, name: str = "rank") -> DataFrame:
    """`rows` with `name`, the place of each row from 1 in a total `order`; the first `limit` rows, if there is one.

    Rows are sorted by ranges and written once; a row's place is its place within its range plus the rows of the
    ranges before it. Only the counts of the ranges, one for each partition, meet in one task.
    """
    if limit:
        return rows.orderBy(*order).limit(limit).withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    placed = materialize(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftrightunsigned("_at", 33)  # the id holds the partition above 33 bits of the row's place in it
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    joined = placed.join(F.broadcast(before), part == F.col("_part"))
    return joined.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_before")
