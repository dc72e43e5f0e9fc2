"""Streaks and active days: distinct days, then islands of consecutive days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.operators.analytics import calendar


def local_day(at: Column, zone: str = "UTC") -> Column:
    return F.to_date(F.from_utc_timestamp(at, zone))


def active_days(log: DataFrame, at: str, *keys: str, zone: str = "UTC") -> DataFrame:
    """Distinct local days of each key; rows without a time do not count."""
    return log.where(F.col(at).isNotNull()).select(*keys, local_day(F.col(at), zone).alias("day")).distinct()


def islands(days: DataFrame, *keys: str) -> DataFrame:
    """(keys, first_day, last_day, length) of every run of consecutive days; a key has one row for each of its days at most."""
    order = Window.partitionBy(*keys).orderBy("day")
    marked = days.withColumn("island", F.date_sub("day", F.row_number().over(order)))
    return marked.groupBy(*keys, "island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("length")).drop("island")


def current_streak(days: DataFrame, today: str, *keys: str) -> DataFrame:
    """Length of the run that ends today, or yesterday if today is empty; 0 otherwise."""
    day = F.lit(today).cast("date")
    alive = F.max(F.when(F.col("last_day") >= F.date_sub(day, 1), F.col("length")))
    return islands(days.where(F.col("day") <= day), *keys).groupBy(*keys).agg(F.coalesce(alive, F.lit(0)).alias("streak"))


def longest_streak(days: DataFrame, *keys: str) -> DataFrame:
    return islands(days, *keys).groupBy(*keys).agg(F.max("length").alias("streak"))


def block_summaries(days: DataFrame, *keys: str, block_days: int = 32) -> DataFrame:
    """(keys, block, first_day, last_day, head, tail, longest): the runs of each block of days; `head` and `tail` are those at its first and last active day.

    Blocks are stretches of the calendar, so a new day touches one, and the others are never read again.
    """
    block = F.floor(F.unix_date("day") / block_days)
    runs = islands(days.withColumn("block", block), *keys, "block")
    return runs.groupBy(*keys, "block").agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"), F.min_by("length", "first_day").alias("head"), F.max_by("length", "first_day").alias("tail"), F.max("length").alias("longest"))


def _joined(a: Column, b: Column) -> Column:
    """Summary of two stretches, b after a; a run at the end of one goes on where the other begins on the next day."""
    meets = F.date_add(a["last_day"], 1) == b["first_day"]
    whole = lambda x: F.date_diff(x["last_day"], x["first_day"]) + 1  # noqa: E731  length of a stretch that is one run
    return F.struct(
        a["first_day"].alias("first_day"),
        b["last_day"].alias("last_day"),
        F.when(meets & (a["head"] == whole(a)), a["head"] + b["head"]).otherwise(a["head"]).alias("head"),
        F.when(meets & (b["tail"] == whole(b)), a["tail"] + b["tail"]).otherwise(b["tail"]).alias("tail"),
        F.greatest(a["longest"], b["longest"], F.when(meets, a["tail"] + b["head"])).alias("longest"),
    )


def merged_streaks(summaries: DataFrame, today: str, *keys: str) -> DataFrame:
    """(keys, streak, longest) from summaries of blocks that do not overlap, however the days were cut; days after `today` must not be in them.

    A key has one row for each block of its days, which meet in one list of a dozen a year.
    """
    parts = F.array_sort(F.collect_list(F.struct("first_day", "last_day", "head", "tail", "longest")))
    runs = summaries.groupBy(*keys).agg(parts.alias("parts"))
    whole = runs.withColumn("all", F.aggregate(F.slice("parts", F.lit(2), F.size("parts")), F.element_at("parts", 1), _joined))
    alive = F.col("all.last_day") >= F.date_sub(F.lit(today).cast("date"), 1)
    return whole.select(*keys, F.when(alive, F.col("all.tail")).otherwise(0).alias("streak"), F.col("all.longest").alias("longest"))


def active_calendar(days: DataFrame, today: str, n: int = 30) -> DataFrame:
    """The last `n` days with a flag for activity."""
    marked = days.select("day").distinct().withColumn("active", F.lit(True))
    return calendar(days.sparkSession, today, n).join(marked, "day", "left").select("day", F.coalesce("active", F.lit(False)).alias("active"))
