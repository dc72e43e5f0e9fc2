"""Spaced repetition as column expressions over a question's state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.numbers import round_half_up

#: Days to the next review for mastery 0 to 5; any other mastery: 1.
INTERVAL_DAYS = (1, 1, 3, 7, 14, 30)

#: Points of the review queue.
LOW_MASTERY, MEDIUM_MASTERY, LAST_WRONG, WRONG_FACTOR, REVIEW_DUE, BOOKMARKED = 10, 5, 8, 2, 5, 3


def base_days(mastery: Column) -> Column:
    out = F.lit(1)
    for level, days in enumerate(INTERVAL_DAYS):
        out = F.when(mastery == level, days).otherwise(out) if days != 1 else out
    return out.cast("bigint")


def next_mastery(mastery: Column, correct: Column) -> Column:
    """Mastery after an attempt in normal mode."""
    return F.when(~correct, 1).when(mastery < 1, 2).otherwise(F.least(F.lit(5), mastery + 1)).cast("bigint")


def redo_mastery(mastery: Column) -> Column:
    """Mastery after a correct attempt in redo mode."""
    return F.greatest(F.lit(3), F.least(F.lit(5), mastery + 1)).cast("bigint")


def due_at(last_attempt_at: Column, mastery: Column) -> Column:
    """Review date stored with an attempt: the base interval only."""
    return F.timestamp_seconds(F.unix_micros(last_attempt_at) / 1_000_000 + base_days(mastery) * 86_400)


def consecutive_correct(last_correct: Column, mastery: Column) -> Column:
    """Estimated run of correct answers."""
    return F.when(last_correct, F.greatest(F.lit(1).cast("bigint"), mastery)).otherwise(0).cast("bigint")


def interval_days(attempts: Column, correct: Column, mastery: Column, last_correct: Column) -> Column:
    """Interval adjusted by accuracy and run, for states without a stored date."""
    rate = F.try_divide(correct, attempts)
    run = consecutive_correct(last_correct, mastery)
    ease = F.when(rate >= 0.9, 1.6).when(rate >= 0.7, 1.3).when(rate >= 0.5, 1.0).otherwise(0.6)
    ease = ease * F.when(run >= 5, 1.2).when(run >= 3, 1.1).otherwise(1.0)
    adjusted = F.greatest(F.lit(1).cast("bigint"), round_half_up(base_days(mastery) * ease))
    return F.when(attempts == 0, base_days(mastery)).otherwise(adjusted)


def derived_due_at(stored: Column, last_attempt_at: Column, attempts: Column, correct: Column, mastery: Column, last_correct: Column) -> Column:
    """The stored date, else one from the adjusted interval; null without an attempt."""
    days = interval_days(attempts, correct, mastery, last_correct)
    return F.coalesce(stored, F.timestamp_seconds(F.unix_micros(last_attempt_at) / 1_000_000 + days * 86_400))


def is_wrong(wrong: Column, correct: Column, mastery: Column) -> Column:
    """Answered wrongly and not recovered since."""
    return (wrong > 0) & ((wrong >= correct) | (mastery <= 2))


def review_score(mastery: Column, last_correct: Column, attempts: Column, wrong: Column, due: Column, bookmarked: Column) -> Column:
    """Points of a question in the review queue."""
    return (
        F.when(mastery <= 1, LOW_MASTERY).when(mastery == 2, MEDIUM_MASTERY).otherwise(0)
        + F.when(~last_correct & (attempts > 0), LAST_WRONG).otherwise(0)
        + F.when(wrong >= 2, wrong * WRONG_FACTOR).otherwise(0)
        + F.when(due, REVIEW_DUE).otherwise(0)
        + F.when(bookmarked, BOOKMARKED).otherwise(0)
    ).cast("bigint")
