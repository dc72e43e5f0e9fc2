"""Registered queries: versions of the stored state, the log in files by day and key, Markdown files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyloom.operators import markdown, state
from tallyloom.plans.content import ORACLE_SQL as CONTENT_SQL
from tallyloom.plans.content import markdown_files
from tallyloom.plans.learning import ORACLE_SQL as LEARNING_SQL
from tallyloom.plans.learning import STATE_COLUMNS
from tallyloom.sources.log_layout import LogLayout
from tallyloom.sources.markdown_files import read_lines, write_files
from tallyloom.sources.shared import shared_dir
from tallyloom.sources.tables import ATTEMPTS_SQL, MODEL_SQL, attempts, questions
from tallyloom.sources.versions import Store, transact

#: Buckets of the stored tables in the queries.
BUCKETS = 16


def new_store(spark) -> Store:
    return Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", BUCKETS)


def versioned_merge(spark, sf):
    """Version 1 holds the states of two thirds of the attempts, version 2 the others' merged in; `before` is read from version 1."""
    store, log = new_store(spark), attempts(spark, sf)
    theirs = F.col("attempt_id") % 3 == 0
    store.begin().replace("question_stats", state.question_stats(log.where(~theirs)), "question_id").commit()
    store.begin().merge("question_stats", state.question_stats(log.where(theirs)), state.merge_stats).commit()
    before = store.read("question_stats", 1).select(F.col("question_id").alias("_id"), F.col("attempt_count").alias("before"))
    return store.read("question_stats", 2).join(before, F.col("question_id") == F.col("_id"), "left").drop("review_due_at", "bookmarked", "_id")


def recorded_attempts(spark, sf):
    """The log recorded in three changes by time: each appends attempts and moves the states of their questions and tags on, all or nothing."""
    store, bank = new_store(spark), questions(spark, sf)
    log = attempts(spark, sf).withColumn("redo", F.lit(False))
    cuts = log.agg(F.percentile_approx(F.unix_micros("created_at"), [1 / 3, 2 / 3], 10_000)).first()[0] or [0, 0]
    at = F.unix_micros("created_at")
    part = lambda k: log.where([at <= cuts[0], (at > cuts[0]) & (at <= cuts[1]), at > cuts[1]][k])
    empty = log.limit(0)
    first = store.begin().replace("attempts", empty, "question_id").replace("question_stats", state.question_stats(empty), "question_id")
    first.replace("tag_stats", state.tag_stats(empty, bank), "tag").commit()
    for k in range(3):

        def record(change, rows=part(k)):
            change.append("attempts", rows)
            change.merge("question_stats", rows, state.advance)
            change.merge("tag_stats", state.tag_stats(rows, bank), state.merge_tags)

        transact(store, record)
    log_counts = store.read("attempts").groupBy(F.col("question_id").alias("_id")).agg(F.count("*").alias("logged"))
    return store.read("question_stats").join(log_counts, F.col("question_id") == F.col("_id")).drop("_id", "bookmarked")


def stored_log(spark, sf) -> LogLayout:
    """The log written in two parts, in files of a few thousand rows."""
    layout = LogLayout(spark, f"{shared_dir(spark)}/log-{uuid.uuid4().hex}", "question_id", "created_at", 4096)
    log = attempts(spark, sf).drop("place")
    return layout.add(log.where("attempt_id % 4 <> 0")).add(log.where("attempt_id % 4 = 0"))


def log_days(spark, sf):
    """Attempts of each day, from what is written about the files."""
    return stored_log(spark, sf).counts().select("day", F.col("rows").alias("attempts"))


def log_slice(spark, sf):
    """A week of some questions: the days and the key range choose the files."""
    return stored_log(spark, sf).read("2024-01-08", "2024-01-14", 20, 39).select("attempt_id", "question_id", "learner_id", "is_correct", "created_at")


def parse_files(spark, sf):
    """The blocks of Markdown files that were written, and read again in splits."""
    path = f"{shared_dir(spark)}/markdown-{uuid.uuid4().hex}"
    write_files(markdown_files(spark, sf), path)
    found = markdown.typed_questions(markdown.blocks(read_lines(spark, path), "^###\\s+\\d+\\."), "^###\\s+\\d+\\.\\s*(.+)$")
    return found.select("file", "section", "block", "stem", F.size("options").alias("n_options"), "kind", "answer_key", "answer_text", "explanation")


QUERIES = {"parse_files": parse_files, "log_days": log_days, "log_slice": log_slice, "versioned_merge": versioned_merge, "recorded_attempts": recorded_attempts}
ORACLE_SQL = {
    "parse_files": CONTENT_SQL["parse_blocks"],
    "log_days": f"WITH {ATTEMPTS_SQL} SELECT CAST(created_at AS DATE) AS day, count(*) AS attempts FROM attempts GROUP BY 1",
    "log_slice": f"WITH {ATTEMPTS_SQL} SELECT attempt_id, question_id, learner_id, is_correct, created_at FROM attempts WHERE CAST(created_at AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' AND question_id BETWEEN 20 AND 39",
    "versioned_merge": f"""WITH {ATTEMPTS_SQL.replace("attempts AS", "early AS", 1)}, b AS (SELECT question_id, count(*) AS before FROM early WHERE attempt_id % 3 <> 0 GROUP BY question_id),
m AS ({LEARNING_SQL["merge_stats"]}) SELECT m.*, before FROM m LEFT JOIN b USING (question_id)""",
    "recorded_attempts": f"{MODEL_SQL} SELECT {STATE_COLUMNS}, review_due_at, attempt_count AS logged FROM stats",
}
