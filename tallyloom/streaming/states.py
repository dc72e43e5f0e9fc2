"""Streaming twins of the learning state: question states and tag counters from an attempt stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "question_id long, attempt_count long, correct_count long, wrong_count long, mastery long, last_correct boolean, last_attempt_at timestamp"
#: Attempts that tell the mastery: it is 1 plus the run of correct answers, at most 5.
RECENT = 4
BLOCKS = "question_id long, attempts long, correct long, first array<long>, recent array<long>"
HOUR = 3_600_000_000


def event_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """Files of the `events` table as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def attempt_stream(events: DataFrame) -> DataFrame:
    """The attempts of an event stream; the time is cast, since watermarks take no zoneless times."""
    return events.select(
        F.col("event_id").alias("attempt_id"),
        F.get_json_object("props", "$.k").cast("long").alias("question_id"),
        F.col("user_id").alias("learner_id"),
        F.col("event_type").isin("purchase", "click", "signup").alias("is_correct"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def known() -> Column:
    """An answer of unknown result is a wrong one."""
    return F.coalesce("is_correct", F.lit(False)).alias("is_correct")


def _places(rows: pd.DataFrame) -> pd.Series:
    """[microseconds, id, correct] of each attempt, as a list: lists sort in the order of attempts."""
    micros = rows.created_at.astype("datetime64[us]").astype("int64")
    return pd.Series([list(x) for x in zip(micros.tolist(), rows.attempt_id.tolist(), rows.is_correct.astype(int).tolist(), strict=True)], index=rows.index, dtype=object)


def question_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each batch of rows and question one summary: counts, the first attempt and the last RECENT, newest first.

    Two summaries make one in any order, so a question with a third of all attempts sends a row for each batch of some thousand.
    """
    for rows in batches:
        rows = rows[rows.question_id.notna() & rows.created_at.notna() & rows.attempt_id.notna()]
        if not len(rows):
            continue
        rows = rows.sort_values(["created_at", "attempt_id"])
        groups = rows.groupby("question_id")
        first, recent = groups.head(1), groups.tail(RECENT)  # only these become lists
        yield pd.DataFrame(
            {
                "attempts": groups.size(),
                "correct": groups.is_correct.sum(),
                "first": _places(first).set_axis(first.question_id),
                "recent": _places(recent).groupby(recent.question_id).agg(lambda x: [v for place in reversed(x.tolist()) for v in place]),
            }
        ).reset_index()


def merged(a: tuple, b: tuple) -> tuple:
    """Summary (attempts, correct, first, recent) of the attempts of two summaries, whichever came first."""
    triples = lambda flat: [tuple(flat[i : i + 3]) for i in range(0, len(flat), 3)]
    recent = sorted(triples(list(a[3])) + triples(list(b[3])), reverse=True)[:RECENT]
    return a[0] + b[0], a[1] + b[1], min(list(a[2]), list(b[2])), [v for place in recent for v in place]


def standing(summary: tuple) -> tuple:
    """(attempts, correct, wrong, mastery, last_correct, last microseconds) of a summary; a first wrong answer does not count as wrong."""
    attempts, correct, first, recent = summary
    answers = recent[2::3]
    run = answers.index(0) if 0 in answers else len(answers)
    return attempts, correct, attempts - correct - (not first[2]), 1 + run, bool(answers[0]), recent[0]


class QuestionStates(StatefulProcessor):
    """Keeps the summary of a question and puts out its standing after every batch that had attempts of it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("summary", "attempts long, correct long, first array<long>, recent array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names that Spark calls
        now = tuple(self.kept.get()) if self.kept.exists() else (0, 0, [], [])
        for part in rows:
            for block in zip(part.attempts.tolist(), part.correct.tolist(), part["first"], part.recent, strict=True):
                block = (block[0], block[1], [int(v) for v in block[2]], [int(v) for v in block[3]])
                now = merged(now, block) if now[0] else block
        self.kept.update(now)
        values = standing(now)
        yield pd.DataFrame([[key[0], *values[:5], pd.Timestamp(values[5], unit="us")]], columns=["question_id", "attempt_count", "correct_count", "wrong_count", "mastery", "last_correct", "last_attempt_at"])

    def close(self) -> None:
        pass


def with_state(spark: SparkSession) -> None:
    """States with timers need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def question_states(attempts: DataFrame) -> DataFrame:
    """Running state of every question, one row for each key of a batch that had attempts.

    The order is that of (created_at, attempt_id) over the whole stream, however attempts arrive. Attempts without a question, time or id count nowhere.
    """
    with_state(attempts.sparkSession)
    blocks = attempts.select("question_id", "attempt_id", "created_at", known()).mapInPandas(question_blocks, BLOCKS)
    return blocks.groupBy("question_id").transformWithStateInPandas(QuestionStates(), OUTPUT, "Update", "None")


def runs(times: list[tuple[int, int, int, int]], idle: int) -> list[tuple[int, int, int, int]]:
    """(start, end, attempts, correct) intervals joined where less than `idle` lies between two."""
    out: list[tuple[int, int, int, int]] = []
    for start, end, n, ok in sorted(times):
        if out and start - out[-1][1] < idle:
            last = out.pop()
            out.append((last[0], max(last[1], end), last[2] + n, last[3] + ok))
        else:
            out.append((start, end, n, ok))
    return out


def idle_sessions(attempts: DataFrame, idle_hours: int = 24, late: str = "2 hours") -> DataFrame:
    """Study sessions of each learner, put out once nothing was answered for `idle_hours`: then a session cannot go on and its state is dropped.

    The clock is the watermark, `late` behind the newest attempt; attempts of a learner and time whose session it has closed are dropped.
    Spark's own session windows keep the state, so no key of a batch costs a call of Python.
    """
    with_state(attempts.sparkSession)
    dated = attempts.where("learner_id IS NOT NULL AND created_at IS NOT NULL").select("learner_id", "created_at", known())
    # windows that touch are one, and an attempt after exactly `idle_hours` starts a session
    window = F.session_window(F.col("created_at"), f"{idle_hours * HOUR - 1} microseconds")
    counted = dated.withWatermark("created_at", late).groupBy("learner_id", window).agg(F.max("created_at").alias("end"), F.count("*").alias("attempts"), F.count_if("is_correct").alias("correct"))
    return counted.select("learner_id", F.col("session_window.start").alias("start"), "end", "attempts", "correct")


def tag_counters(attempts: DataFrame, questions: DataFrame) -> DataFrame:
    """Running counters of every tag; `questions`(id, tags) is static."""
    tagged = attempts.join(questions.select("id", "tags"), F.col("question_id") == F.col("id")).select("is_correct", F.explode("tags").alias("tag"))
    return tagged.groupBy("tag").agg(F.count("*").alias("attempt_count"), F.count_if("is_correct").alias("correct_count"), F.count_if(~F.col("is_correct")).alias("wrong_count"))


def windowed_counts(attempts: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Attempts and correct ones of each time window; rows later than `late` are dropped by the watermark."""
    return attempts.withWatermark("created_at", late).groupBy(F.window("created_at", width)).agg(F.count("*").alias("attempts"), F.count_if("is_correct").alias("correct")).select(F.col("window.start").alias("start"), "attempts", "correct")


def sessions(attempts: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Study sessions of each learner (attempts need `learner_id`): runs of attempts without a gap."""
    return attempts.withWatermark("created_at", late).groupBy("learner_id", F.session_window("created_at", gap)).agg(F.count("*").alias("attempts")).select("learner_id", F.col("session_window.start").alias("start"), "attempts")
