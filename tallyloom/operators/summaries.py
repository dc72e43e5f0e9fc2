"""Summaries of days that merge: quantiles within a relative error, and distinct counts.

A summary is rows, (keys, kind, cell, value), so merging is a grouped sum or maximum and any level of the keys and any set of
days comes from the same stored rows; the log is not read again.

Quantiles (kind q): a value x is counted in cell ceil(log x) to the base (1 + ERROR) / (1 - ERROR). Cells keep the order of values, so
the cell of the wanted rank is known exactly, and its middle is within ERROR of the value at that rank, relatively.
Values up to 0 have a cell of their own and count as 0.

Distinct counts (kind d): the first bits of a digest name one of REGISTERS cells, which keeps the longest run of zeros in the rest.
Their harmonic mean gives the count with a standard error of 1.04 / sqrt(REGISTERS); few members are counted by the cells that stay empty.

A key has some thousand cells at most, however many rows it has, and every task folds its rows to cells before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ERROR = 0.01
BASE = (1 + ERROR) / (1 - ERROR)
#: Cell of values up to 0; ceil(log x) of whole numbers is never below 0.
ZERO = -1
REGISTER_BITS = 12
REGISTERS = 1 << REGISTER_BITS
#: Bits of a digest: 15 hexadecimal digits.
BITS = 60


def value_cell(value: Column) -> Column:
    return F.when(value <= 0, ZERO).otherwise(F.ceil(F.log(value.cast("double")) / F.log(F.lit(BASE)))).cast("int")


def cell_value(cell: Column) -> Column:
    """Middle of a cell in the sense of relative errors."""
    return F.when(cell == ZERO, 0.0).otherwise(2 * F.pow(F.lit(BASE), cell) / (F.lit(BASE) + 1))


def digest(member: Column) -> Column:
    return F.conv(F.substring(F.md5(member.cast("string")), 1, BITS // 4), 16, 10).cast("bigint")


def summarize(rows: DataFrame, keys: list[str], value: str, member: str) -> DataFrame:
    """(keys, kind, cell, value) of `rows`: quantiles of the whole-number column `value`, distinct `member`s; nulls count in neither."""
    hashed, rest_bits = digest(F.col(member)), BITS - REGISTER_BITS
    rest = hashed.bitwiseAND(F.lit((1 << rest_bits) - 1))
    zeros = F.when(rest == 0, rest_bits + 1).otherwise(rest_bits + 1 - F.length(F.bin(rest)))
    made = lambda kind, cell, v: F.struct(F.lit(kind).alias("kind"), cell.cast("int").alias("cell"), v.cast("bigint").alias("value"))
    parts = F.array(
        F.when(F.col(value).isNotNull(), made("q", value_cell(F.col(value)), F.lit(1))),
        F.when(F.col(member).isNotNull(), made("d", F.shiftright(hashed, rest_bits), zeros)),
    )
    return merge(rows.select(*keys, F.explode(F.array_compact(parts)).alias("_p")).select(*keys, "_p.*"), keys)


def merge(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Summaries by `keys`, which may be fewer than they have."""
    value = F.when(F.col("kind") == "q", F.sum("value")).otherwise(F.max("value"))
    return summaries.groupBy(*keys, "kind", "cell").agg(value.alias("value"))


def quantiles(merged: DataFrame, keys: list[str], hundredths: list[int]) -> DataFrame:
    """(keys, n, p<h> of each of `hundredths`): the value at rank floor(h * (n - 1) / 100) + 1, within ERROR."""
    counts = merged.where("kind = 'q'")
    upto = F.sum("value").over(Window.partitionBy(*keys).orderBy("cell"))
    placed = counts.withColumn("_upto", upto).withColumn("_n", F.sum("value").over(Window.partitionBy(*keys)))
    rank = lambda h: F.expr(f"({h} * (_n - 1)) div 100 + 1")
    return placed.groupBy(*keys).agg(F.max("_n").alias("n"), *[cell_value(F.min(F.when(F.col("_upto") >= rank(h), F.col("cell")))).alias(f"p{h}") for h in hundredths])


def distinct_counts(merged: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, members): estimated distinct members."""
    m = float(REGISTERS)
    held = merged.where("kind = 'd'").groupBy(*keys).agg(F.sum(F.pow(F.lit(2.0), -F.col("value"))).alias("_sum"), F.count("*").alias("_held"))
    empty = F.lit(m) - F.col("_held")
    raw = F.lit(0.7213 / (1 + 1.079 / m) * m * m) / (F.col("_sum") + empty)
    few = F.lit(m) * F.log(F.lit(m) / empty)
    return held.select(*keys, F.floor(F.when((raw <= 2.5 * m) & (empty > 0), few).otherwise(raw) + 0.5).alias("members"))


def report(stored: DataFrame, levels: list[list[str]], windows: dict[str, Column], hundredths: list[int]) -> DataFrame:
    """(window, all levels' keys, n, p.., members) for every window (a condition on the stored rows) and level of the keys; keys that a level lacks are null."""
    names = list(dict.fromkeys(k for level in levels for k in level))
    kinds = {k: stored.schema[k].dataType for k in names}
    in_windows = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in windows.items()]))
    levelled = F.array(*[F.struct(F.lit(i).alias("_level"), *[(F.col(k) if k in level else F.lit(None).cast(kinds[k])).alias(k) for k in names]) for i, level in enumerate(levels)])
    rows = stored.select(F.explode(in_windows).alias("window"), levelled.alias("_l"), "kind", "cell", "value").select("window", F.inline("_l"), "kind", "cell", "value")
    keys = ["window", "_level", *names]
    merged = merge(rows, keys)
    counts, members = quantiles(merged, keys, hundredths).alias("q"), distinct_counts(merged, keys).alias("d")
    same = [F.col(f"q.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys]
    both = counts.join(members, same, "full_outer")
    first = lambda k: F.coalesce(f"q.{k}", f"d.{k}").alias(k)
    return both.select(first("window"), *[first(k) for k in names], F.coalesce("q.n", F.lit(0)).alias("n"), *[F.col(f"q.p{h}") for h in hundredths], F.coalesce("d.members", F.lit(0)).alias("members"))
