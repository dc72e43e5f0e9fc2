"""Running sessions saved as tables, and which of them a request goes on with.

A saved session is one header row and one row for each of its questions, so a session may have any number of
questions. All sessions of all learners are saved and resumed at once: grouped aggregates that fold before the
shuffle, and joins on session and learner.

Sessions without questions or answers have zero counts and index 0. Repeated events change nothing; of events at the
same place in time the greatest counts. Null keys belong to no session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.operators.retrieval import session_in_progress


def progress(items: DataFrame, events: DataFrame) -> DataFrame:
    """(session_id, position, question_id, selected, is_correct, draft): every question of every session with what was done to it.

    `items`: session_id, position, question_id; `events`: session_id, position, place, selected, is_correct. An event
    without `is_correct` is a draft. The latest answer counts, the latest draft stays beside it.
    """
    answer = F.col("is_correct").isNotNull()
    rows = events.where("session_id IS NOT NULL AND position IS NOT NULL")
    last = lambda kind: F.max(F.when(kind, F.struct("place", "selected", "is_correct")))
    done = rows.groupBy(F.col("session_id").alias("_session"), F.col("position").alias("_position")).agg(last(answer).alias("answer"), last(~answer).alias("note"))
    both = items.where("session_id IS NOT NULL").join(done, (F.col("session_id") == F.col("_session")) & (F.col("position") == F.col("_position")), "left")
    return both.select("session_id", "position", "question_id", F.col("answer.selected").alias("selected"), F.col("answer.is_correct").alias("is_correct"), F.col("note.selected").alias("draft"))


def headers(sessions: DataFrame, done: DataFrame, events: DataFrame) -> DataFrame:
    """`sessions`(session_id, ...) with total, current_index, submitted, correct and wrong from `progress` and the latest event.

    The index is the question of the latest event, submitted if that event was an answer.
    """
    counts = done.groupBy(F.col("session_id").alias("_session")).agg(F.count("*").alias("total"), F.count_if("is_correct").alias("correct"), F.count_if(~F.col("is_correct")).alias("wrong"))
    newest = events.where("session_id IS NOT NULL AND position IS NOT NULL").groupBy(F.col("session_id").alias("_of")).agg(F.max(F.struct("place", "position", F.col("is_correct").isNotNull().alias("submitted"))).alias("last"))
    rows = sessions.join(counts, F.col("session_id") == F.col("_session"), "left").join(newest, F.col("session_id") == F.col("_of"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return rows.select(*sessions.columns, zero("total").alias("total"), zero("last.position").alias("current_index"), F.coalesce("last.submitted", F.lit(False)).alias("submitted"), zero("correct").alias("correct"), zero("wrong").alias("wrong"))


def resumes(resume: Column, fresh: Column, bare: Column, same_entry: Column, in_progress: Column) -> Column:
    """Whether a request goes on with the saved session: asked for or from the same entry while it is in progress, or without any wish.

    A fresh start overrules the same entry only.
    """
    no = lambda c: F.coalesce(c, F.lit(False))
    return ((no(resume) | (no(same_entry) & ~no(fresh))) & no(in_progress)) | no(bare)


def resumed(saved: DataFrame, requests: DataFrame) -> DataFrame:
    """(learner_id, at, session_id, current_index, correct, wrong): the session each request goes on with, null for a new one.

    `saved`: headers with learner_id, entry_key, started_at and saved_at; of several sessions of a learner the last one saved
    counts, of equal times the greater id. `requests`: learner_id, at, entry_key, resume, fresh, bare.
    """
    columns = ["saved_at", "session_id", "entry_key", "started_at", "total", "current_index", "submitted", "correct", "wrong"]
    latest = saved.where("learner_id IS NOT NULL").groupBy(F.col("learner_id").alias("_learner")).agg(F.max(F.struct(*columns)).alias("s"))
    both = requests.join(latest, F.col("learner_id") == F.col("_learner"), "left")
    age = (F.unix_micros("at") - F.unix_micros("s.started_at")) / F.lit(3_600_000_000)
    going = session_in_progress(age, F.col("s.total"), F.col("s.current_index"), F.col("s.submitted"))
    goes_on = resumes(F.col("resume"), F.col("fresh"), F.col("bare") & F.col("_learner").isNotNull(), F.col("s.entry_key") == F.col("entry_key"), going)
    kept = lambda c: F.when(goes_on, F.col(f"s.{c}"))
    index = F.when(goes_on, F.col("s.current_index") + F.col("s.submitted").cast("int"))
    return both.select("learner_id", "at", kept("session_id").alias("session_id"), index.alias("current_index"), kept("correct").alias("correct"), kept("wrong").alias("wrong"))


def resumed_items(decided: DataFrame, done: DataFrame, questions: DataFrame) -> DataFrame:
    """(learner_id, session_id, position, question_id, selected, is_correct, draft) of the sessions that go on.

    Questions that the bank lacks are gone and the others close up; the saved index is not moved.
    """
    mine = decided.where("session_id IS NOT NULL").select("learner_id", F.col("session_id").alias("_session")).distinct()
    known = questions.select(F.col("id").alias("_id")).distinct()
    rows = done.join(mine, F.col("session_id") == F.col("_session")).join(known, F.col("question_id") == F.col("_id"), "left_semi")
    place = F.row_number().over(Window.partitionBy("learner_id", "session_id").orderBy("position")) - 1
    return rows.select("learner_id", "session_id", place.cast("bigint").alias("position"), "question_id", "selected", "is_correct", "draft")
