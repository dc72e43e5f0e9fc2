"""The learning model over the stored tables: attempts from `events`, questions from `documents` and `labels`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORRECT_EVENTS = ("purchase", "click", "signup")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempt log. `place` orders attempts by time and id in one number, which hash aggregates can hold."""
    events = table(spark, sf_dir, "events")
    created = F.col("ts").cast("timestamp")
    return events.select(
        F.col("event_id").alias("attempt_id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("question_id"),
        F.col("user_id").alias("learner_id"),
        F.col("event_type").isin(*CORRECT_EVENTS).alias("is_correct"),
        (F.col("value") * 1000).cast("bigint").alias("elapsed_ms"),
        created.alias("created_at"),
        (F.unix_micros(created).cast("decimal(18,0)") * F.lit("10000000000000000000").cast("decimal(20,0)") + F.col("event_id")).cast("decimal(38,0)").alias("place"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question bank; `position` is its order."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    size = F.when(F.col("n_chars") < 300, "short").when(F.col("n_chars") < 3000, "medium").otherwise("long")
    review = F.when(F.col("quality") == 0, F.lit("needs-review"))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").alias("position"),
        F.col("lang").alias("category"),
        F.col("source").alias("group_id"),
        F.concat(F.lit("Set "), F.col("source")).alias("group_title"),
        F.col("text").alias("stem"),
        F.array("source", size).alias("tags"),
        F.array_compact(F.array(F.col("lang"), size, review)).alias("grammar_points"),
        F.when(F.col("quality") == 0, "review").otherwise("ready").alias("status"),
    )


#: The same model for the oracle.
ATTEMPTS_SQL = """attempts AS (
  SELECT event_id AS attempt_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS question_id, user_id AS learner_id,
    event_type IN ('purchase', 'click', 'signup') AS is_correct, CAST(trunc(value * 1000) AS BIGINT) AS elapsed_ms, ts AS created_at
  FROM events
)"""
QUESTIONS_SQL = """questions AS (
  SELECT d.doc_id AS id, d.doc_id AS position, lang AS category, source AS group_id, 'Set ' || source AS group_title, text AS stem,
    [source, CASE WHEN n_chars < 300 THEN 'short' WHEN n_chars < 3000 THEN 'medium' ELSE 'long' END] AS tags,
    list_filter([lang, CASE WHEN n_chars < 300 THEN 'short' WHEN n_chars < 3000 THEN 'medium' ELSE 'long' END, CASE WHEN quality = 0 THEN 'needs-review' END], lambda x: x IS NOT NULL) AS grammar_points,
    CASE WHEN quality = 0 THEN 'review' ELSE 'ready' END AS status
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""
STATS_SQL = """ranked AS (
  SELECT *, row_number() OVER w AS n, max(CASE WHEN NOT is_correct THEN 1 END) OVER (PARTITION BY question_id ORDER BY created_at DESC, attempt_id DESC) AS broken
  FROM attempts WINDOW w AS (PARTITION BY question_id ORDER BY created_at, attempt_id)
), folded AS (
  SELECT question_id, count(*) AS attempt_count, count(*) FILTER (is_correct) AS correct_count,
    count(*) FILTER (NOT is_correct AND n > 1) AS wrong_count,
    least(5, 1 + count(*) FILTER (broken IS NULL)) AS mastery,
    arg_max(is_correct, n) AS last_correct, max(created_at) AS last_attempt_at
  FROM ranked GROUP BY question_id
), stats AS (
  SELECT *, last_attempt_at + to_days(CAST([1, 1, 3, 7, 14, 30][mastery + 1] AS INTEGER)) AS review_due_at, false AS bookmarked FROM folded
)"""
TAGS_SQL = """tag_stats AS (
  SELECT tag, count(*) AS attempt_count, count(*) FILTER (is_correct) AS correct_count, count(*) FILTER (NOT is_correct) AS wrong_count
  FROM (SELECT a.is_correct, unnest(q.tags) AS tag FROM attempts a JOIN questions q ON a.question_id = q.id) GROUP BY tag
)"""
MODEL_SQL = f"WITH {ATTEMPTS_SQL}, {QUESTIONS_SQL}, {STATS_SQL}, {TAGS_SQL}"
