"""Rollups over questions, their states and the attempt log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.numbers import activity_level, percent, round_half_up


def with_states(questions: DataFrame, stats: DataFrame) -> DataFrame:
    """Every question with its state, if it has one."""
    return questions.join(stats, F.col("id") == F.col("question_id"), "left")


def visible_states(stats: DataFrame, questions: DataFrame) -> DataFrame:
    """States of the questions at hand."""
    return stats.join(questions.select("id"), F.col("question_id") == F.col("id"), "left_semi")


def in_bank(attempts: DataFrame, questions: DataFrame) -> DataFrame:
    return attempts.join(questions.select("id"), F.col("question_id") == F.col("id"), "left_semi")


def group_analysis(questions: DataFrame, stats: DataFrame) -> DataFrame:
    """Of each group: questions, done, correct and wrong answers, rate. Null rate: done, but neither correct nor wrong counted."""
    attempted = F.coalesce("attempt_count", F.lit(0)) > 0
    sums = with_states(questions, stats).groupBy("group_id").agg(
        F.min_by("group_title", "position").alias("title"),
        F.count("*").alias("total"),
        F.count_if(attempted).alias("done"),
        F.coalesce(F.sum(F.when(attempted, F.col("correct_count"))), F.lit(0)).alias("correct"),
        F.coalesce(F.sum(F.when(attempted, F.col("wrong_count"))), F.lit(0)).alias("wrong"),
    )
    rate = F.when(F.col("done") > 0, round_half_up(F.try_divide(F.col("correct"), F.col("correct") + F.col("wrong")) * 100)).otherwise(0)
    return sums.withColumn("rate", rate.cast("bigint"))


def group_cards(questions: DataFrame, stats: DataFrame, visible: DataFrame) -> DataFrame:
    """Of each group: all its questions, and done, attempts, correct and wrong questions among the visible ones."""
    totals = questions.groupBy("group_id").agg(F.count("*").alias("total"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    cards = with_states(visible, stats).groupBy("group_id").agg(
        F.count_if(n("attempt_count") > 0).alias("done"),
        F.sum(n("attempt_count")).alias("attempts"),
        F.sum(n("correct_count")).alias("correct"),
        F.count_if(n("wrong_count") > 0).alias("wrong"),
        F.count_if(n("attempt_count") == 0).alias("untouched"),
    )
    filled = {c: F.coalesce(c, F.lit(0)) for c in ("done", "attempts", "correct", "wrong", "untouched")}
    return totals.join(cards, "group_id", "left").withColumns(filled)


def tag_counts(questions: DataFrame, column: str) -> DataFrame:
    """(name, questions, first): questions of each tag, counted with repeats, and where the tag first occurs."""
    return questions.select("position", F.posexplode(column).alias("i", "name")).groupBy("name").agg(F.count("*").alias("questions"), F.min(F.col("position") * 1000 + F.col("i")).alias("first"))


def top_tags(questions: DataFrame, column: str, n: int) -> DataFrame:
    """The `n` tags with most questions; equal counts in the order of first occurrence."""
    return tag_counts(questions, column).orderBy(F.desc("questions"), "first").limit(n)


def tag_analysis(questions: DataFrame, stats: DataFrame, n: int = 15) -> DataFrame:
    """Questions, attempts and rate of the `n` most frequent grammar points, over both tag lists with repeats."""
    names = top_tags(questions, "grammar_points", n).select("name", F.col("questions").alias("in_points"), "first")
    index = questions.select("id", F.explode(F.concat("grammar_points", "tags")).alias("name")).join(F.broadcast(names), "name")
    state = index.join(stats, F.col("id") == F.col("question_id"), "left")
    sums = state.groupBy("name", "in_points", "first").agg(F.count("*").alias("questions"), F.coalesce(F.sum("attempt_count"), F.lit(0)).alias("attempts"), F.coalesce(F.sum("correct_count"), F.lit(0)).alias("correct"))
    rank = F.row_number().over(Window.orderBy(F.desc("in_points"), "first"))  # at most n rows
    return sums.select(rank.cast("bigint").alias("rank"), "name", "questions", "attempts", percent(F.col("correct"), F.col("attempts")).alias("rate"))


def overall(questions: DataFrame, stats: DataFrame) -> DataFrame:
    sums = stats.agg(F.count_if(F.col("attempt_count") > 0).alias("done"), F.coalesce(F.sum("attempt_count"), F.lit(0)).alias("attempts"), F.coalesce(F.sum("correct_count"), F.lit(0)).alias("correct"), F.count_if(F.col("wrong_count") > 0).alias("wrong_questions"))
    total = questions.agg(F.count("*").alias("total"))
    return total.select("total", F.lit(1).alias("k")).join(sums.withColumn("k", F.lit(1)), "k").select("total", "done", "attempts", "correct", "wrong_questions", percent(F.col("correct"), F.col("attempts")).alias("rate"))


def mastery_summary(questions: DataFrame, stats: DataFrame) -> DataFrame:
    m = F.col("mastery")
    sums = stats.agg(F.count_if(m >= 4).alias("mastered"), F.count_if((m >= 2) & (m < 4)).alias("learning"), F.count_if(m < 2).alias("weak"), F.count_if(F.col("attempt_count") > 0).alias("attempted"), F.lit(1).alias("k"))
    return questions.agg(F.count("*").alias("total"), F.lit(1).alias("k")).join(sums, "k").select("mastered", "learning", "weak", (F.col("total") - F.col("attempted")).alias("untouched"))


def category_progress(questions: DataFrame, stats: DataFrame) -> DataFrame:
    """Per category: questions, done, attempts and rate."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = with_states(questions, stats).groupBy("category").agg(F.count("*").alias("total"), F.count_if(F.col("attempt_count") > 0).alias("done"), n("attempt_count").alias("attempts"), n("correct_count").alias("correct"))
    return sums.select("category", "total", "done", "attempts", percent(F.col("correct"), F.col("attempts")).alias("rate"), percent(F.col("done"), F.col("total")).alias("progress"))


def speed(attempts: DataFrame, longest_ms: int = 300_000) -> DataFrame:
    """Mean answer times in ms, and the fastest (earliest of equals) and slowest (latest of equals) attempt."""
    ms, ok = F.col("elapsed_ms"), F.col("is_correct")
    valid = attempts.where((ms > 0) & (ms < longest_ms))
    mean = lambda c: F.coalesce(round_half_up(F.avg(c)), F.lit(0))
    order = F.struct(ms.alias("ms"), "place", "attempt_id")
    found = valid.agg(mean(ms).alias("avg_ms"), mean(F.when(ok, ms)).alias("avg_correct_ms"), mean(F.when(~ok, ms)).alias("avg_wrong_ms"), F.min(order).alias("lo"), F.max(order).alias("hi"))
    return found.select("avg_ms", "avg_correct_ms", "avg_wrong_ms", F.col("lo.ms").alias("fastest_ms"), F.col("lo.attempt_id").alias("fastest_id"), F.col("hi.ms").alias("slowest_ms"), F.col("hi.attempt_id").alias("slowest_id"))


def last_attempts(attempts: DataFrame, n: int) -> DataFrame:
    """The last `n` attempts of the log."""
    return attempts.orderBy(F.desc("place")).limit(n)


def trend(attempts: DataFrame, n: int = 40) -> DataFrame:
    return last_attempts(attempts, n).agg(F.count("*").alias("total"), F.count_if("is_correct").alias("correct")).withColumn("rate", percent(F.col("correct"), F.col("total")))


def recent_rate(attempts: DataFrame, questions: DataFrame, scan: int = 500, n: int = 30) -> DataFrame:
    """Rate of the last `n` attempts of the bank among the last `scan` of the log (the limit comes before the filter)."""
    return last_attempts(in_bank(last_attempts(attempts, scan), questions), n).agg(percent(F.count_if("is_correct"), F.count("*")).alias("rate"), F.count("*").alias("total"))


def calendar(spark, last_day: str, days: int) -> DataFrame:
    """(day): the `days` days up to `last_day`."""
    return spark.range(days).select(F.date_sub(F.lit(last_day).cast("date"), F.col("id").cast("int")).alias("day"))


def heatmap(attempts: DataFrame, last_day: str, days: int = 30) -> DataFrame:
    """Attempts of each of the last `days` days, and their level."""
    first = F.date_sub(F.lit(last_day).cast("date"), days - 1)
    counts = attempts.where((F.col("created_at") >= first) & (F.col("created_at") < F.date_add(F.lit(last_day).cast("date"), 1))).groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
    filled = F.coalesce("n", F.lit(0))
    return calendar(attempts.sparkSession, last_day, days).join(counts, "day", "left").select("day", filled.alias("attempts"), activity_level(filled).alias("level"))


def heatmap_summary(days: DataFrame) -> DataFrame:
    return days.agg(F.count_if(F.col("attempts") > 0).alias("active_days"), F.max("attempts").alias("max_attempts"))


def attempts_on(attempts: DataFrame, day: str) -> DataFrame:
    """Attempts of one day, both bounds as literals so that they reach the scan."""
    start = F.lit(day).cast("timestamp")
    return attempts.where((F.col("created_at") >= start) & (F.col("created_at") < start + F.expr("INTERVAL 1 DAY"))).agg(F.count("*").alias("attempts"))


def history(attempts: DataFrame, window: str, now: str, result: str = "all", scan: int = 1000) -> DataFrame:
    """The last `scan` attempts, filtered by time (all, today, week, month) and result (all, correct, wrong)."""
    at = F.lit(now).cast("timestamp")
    since = {"all": None, "today": F.date_trunc("day", at), "week": at - F.expr("INTERVAL 7 DAYS"), "month": at - F.expr("INTERVAL 30 DAYS")}[window]
    rows = last_attempts(attempts, scan)
    rows = rows if since is None else rows.where(F.col("created_at") >= since)
    return {"all": rows, "correct": rows.where("is_correct"), "wrong": rows.where("NOT is_correct")}[result]


def history_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count_if("is_correct").alias("correct"), percent(F.count_if("is_correct"), F.count("*")).alias("rate"))


def page(rows: DataFrame, order: list[Column], number: int, size: int = 20) -> DataFrame:
    """Page `number` (from 1) in a total order, with the row's place in the whole list."""
    placed = rows.orderBy(*order).offset((number - 1) * size).limit(size)
    return placed.withColumn("row", (F.row_number().over(Window.orderBy(*order)) + (number - 1) * size).cast("bigint"))


def page_count(rows: DataFrame, size: int = 20) -> DataFrame:
    return rows.agg(F.ceil(F.count("*") / size).alias("pages"))
