"""Registered queries: sessions saved and resumed, made from the attempt log."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.operators import sessions
from tallyloom.sources.tables import ATTEMPTS_SQL, attempts, questions

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def made(spark, sf):
    """(progress, headers, requests): a session is a learner's day; every sixth attempt is a draft, every fourth question is not reached."""
    by = Window.partitionBy("session_id").orderBy("place")
    log = attempts(spark, sf).withColumn("session_id", F.col("learner_id") * 100_000 + F.unix_date(F.to_date("created_at")))
    rows = log.withColumn("position", F.row_number().over(by).cast("bigint") - 1)
    draft = F.col("attempt_id") % 6 == 5
    events = rows.where("attempt_id % 4 <> 3").select("session_id", "position", "place", F.col("attempt_id").cast("string").alias("selected"), F.when(~draft, F.col("is_correct")).alias("is_correct"))
    days = log.groupBy("session_id", "learner_id").agg(F.min("created_at").alias("started_at"), F.max("created_at").alias("saved_at"))
    done = sessions.progress(rows.select("session_id", "position", "question_id"), events)
    entry = F.concat(F.lit("entry"), (F.col("learner_id") % 3).cast("string"))
    saved = sessions.headers(days.withColumn("entry_key", entry), done, events)
    case = F.col("learner_id") % 7
    asked = log.groupBy("learner_id").agg(F.max("created_at").alias("last"))
    requests = asked.select("learner_id", (F.col("last") + F.make_interval(hours=F.col("learner_id") % 30)).alias("at"), F.when(case == 4, "elsewhere").otherwise(entry).alias("entry_key"), case.isin(0, 5).alias("resume"), case.isin(2, 5).alias("fresh"), (case == 3).alias("bare"))
    return done, saved, requests


SAVED_SQL = f"""WITH {ATTEMPTS_SQL}, a AS (
  SELECT *, learner_id * 100000 + date_diff('day', DATE '1970-01-01', created_at::DATE) AS session_id FROM attempts
), r AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, attempt_id) - 1 AS position, attempt_id % 4 <> 3 AS reached, attempt_id % 6 = 5 AS draft FROM a
), saved AS (
  SELECT session_id, learner_id, min(created_at) AS started_at, max(created_at) AS saved_at, 'entry' || learner_id % 3 AS entry_key, count(*) AS total, coalesce(arg_max(position, position) FILTER (reached), 0) AS current_index,
    coalesce(NOT arg_max(draft, position) FILTER (reached), false) AS submitted, count(*) FILTER (reached AND NOT draft AND is_correct) AS correct, count(*) FILTER (reached AND NOT draft AND NOT is_correct) AS wrong
  FROM r GROUP BY session_id, learner_id
), latest AS (
  SELECT * FROM saved QUALIFY row_number() OVER (PARTITION BY learner_id ORDER BY saved_at DESC, session_id DESC) = 1
), asked AS (
  SELECT *, saved_at + to_hours(CAST(learner_id % 30 AS INTEGER)) AS asked_at, learner_id % 7 AS c FROM latest
), decided AS (
  SELECT *, c = 3 OR (c IN (0, 1, 5, 6) AND asked_at - started_at <= INTERVAL 24 HOUR AND current_index + submitted::INTEGER < total) AS goes_on FROM asked
)"""

QUERIES["session_headers"] = lambda spark, sf: made(spark, sf)[1].select("session_id", "total", "current_index", "submitted", "correct", "wrong")
ORACLE_SQL["session_headers"] = f"{SAVED_SQL} SELECT session_id, total, current_index, submitted, correct, wrong FROM saved"


def session_resumed(spark, sf):
    _, saved, requests = made(spark, sf)
    return sessions.resumed(saved, requests).select("learner_id", "session_id", "current_index", "correct", "wrong")


QUERIES["session_resumed"] = session_resumed
ORACLE_SQL["session_resumed"] = f"""{SAVED_SQL} SELECT learner_id, CASE WHEN goes_on THEN session_id END AS session_id, CASE WHEN goes_on THEN current_index + submitted::INTEGER END AS current_index,
  CASE WHEN goes_on THEN correct END AS correct, CASE WHEN goes_on THEN wrong END AS wrong FROM decided"""


def session_questions(spark, sf):
    done, saved, requests = made(spark, sf)
    return sessions.resumed_items(sessions.resumed(saved, requests), done, questions(spark, sf))


QUERIES["session_questions"] = session_questions
ORACLE_SQL["session_questions"] = f"""{SAVED_SQL}
SELECT r.learner_id, r.session_id, row_number() OVER (PARTITION BY r.session_id ORDER BY position) - 1 AS position, question_id, CASE WHEN reached AND NOT draft THEN attempt_id::VARCHAR END AS selected,
  CASE WHEN reached AND NOT draft THEN is_correct END AS is_correct, CASE WHEN reached AND draft THEN attempt_id::VARCHAR END AS draft
FROM r JOIN decided d ON r.session_id = d.session_id AND d.goes_on WHERE question_id IN (SELECT doc_id FROM documents)"""
