"""What to learn next: weak tags, review queue, wrong and untouched questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.numbers import percent
from tallyloom.functions.schedule import derived_due_at, is_wrong, review_score


def stored_due(now: Column) -> Column:
    """Whether a state is due at `now`."""
    due = derived_due_at(F.col("review_due_at"), F.col("last_attempt_at"), F.col("attempt_count"), F.col("correct_count"), F.col("mastery"), F.col("last_correct"))
    return F.coalesce(due <= now, F.lit(False))


def weak_tags(tags: DataFrame, questions: DataFrame, n: int = 8) -> DataFrame:
    """The `n` tags of the bank with the greatest priority; equal ones by name."""
    in_bank = questions.select(F.explode(F.array_union("tags", "grammar_points")).alias("tag")).distinct()
    rate = F.col("correct_count") / F.col("attempt_count")
    scored = tags.where("attempt_count > 0").join(in_bank, "tag", "left_semi").select("tag", F.col("attempt_count").alias("questions"), percent(F.col("correct_count"), F.col("attempt_count")).alias("rate"), F.col("wrong_count").alias("wrong"), (F.col("wrong_count") * 3 + (1 - rate) * 10).alias("priority"))
    order = [F.desc("priority"), F.asc("tag")]
    return scored.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def review_queue(stats: DataFrame, now: str) -> DataFrame:
    """(question_id, score, due) of every state with points, for ordering by score; not only those due."""
    due = stored_due(F.lit(now).cast("timestamp"))
    score = review_score(F.col("mastery"), F.col("last_correct"), F.col("attempt_count"), F.col("wrong_count"), due, F.col("bookmarked"))
    return stats.select("question_id", score.alias("score"), due.alias("due")).where("score > 0")


def wrong_questions(stats: DataFrame) -> DataFrame:
    return stats.where(is_wrong(F.col("wrong_count"), F.col("correct_count"), F.col("mastery")))


def untouched(questions: DataFrame, stats: DataFrame) -> DataFrame:
    """Questions without an attempt."""
    done = stats.where("attempt_count > 0").select("question_id")
    return questions.join(done, F.col("id") == F.col("question_id"), "left_anti")
