"""Rounding and rates, as the analytics define them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column) -> Column:
    """Nearest whole number, halves towards plus infinity, as bigint."""
    return F.floor(x + 0.5).cast("bigint")


def percent(part: Column, whole: Column) -> Column:
    """Rounded percentage; 0 where the whole is 0 or null."""
    return F.when(whole > 0, round_half_up(part / whole * 100)).otherwise(F.lit(0)).cast("bigint")


def status_bucket(rate: Column, attempts: Column) -> Column:
    """good from 80, warn from 50, bad below, na without attempts."""
    return F.when(rate >= 80, "good").when(rate >= 50, "warn").when(attempts > 0, "bad").otherwise("na")


def rate_color(rate: Column) -> Column:
    return F.when(rate >= 70, "green").when(rate >= 40, "amber").otherwise("red")


def goal_progress(done: Column, goal: Column) -> Column:
    """Percentage of a daily goal, at most 100; 0 for a goal of 0."""
    return F.least(F.lit(100).cast("bigint"), percent(done, goal))


def goal_color(progress: Column) -> Column:
    return F.when(progress >= 100, "green").when(progress >= 60, "amber").otherwise("grey")


def activity_level(count: Column) -> Column:
    """0 without activity, then levels from 1, 6 and 16 attempts a day."""
    return F.when(count >= 16, 3).when(count >= 6, 2).when(count >= 1, 1).otherwise(0).cast("bigint")


def clock(seconds: Column) -> Column:
    """mm:ss"""
    whole = seconds.cast("bigint")
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("bigint"), whole % 60)
