"""Learning state folded from the attempt log.

Normal mode has a closed form: mastery is 1 plus the run of correct answers since the last wrong one, at most
5, and the first attempt of a question never counts as wrong. So grouped aggregates and the last four
attempts of a key tell its state; both fold before the shuffle, so a question with a third of all attempts
is no large group. Redo mode has no closed form, but mastery has six values: any run of attempts is a map
of six states with counters. `fold` sums up blocks of attempts to such maps and composes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.numbers import round_half_up
from tallyloom.functions.schedule import due_at, next_mastery, redo_mastery


def question_stats(attempts: DataFrame, *keys: str) -> DataFrame:
    """State of every key (default: question_id) after its attempts in normal mode."""
    keys = keys or ("question_id",)
    wrong = ~F.col("is_correct")
    first = attempts.groupBy(*keys).agg(
        F.count("*").alias("attempt_count"),
        F.count_if("is_correct").alias("correct_count"),
        (F.count_if(wrong) - F.when(F.min_by("is_correct", "place"), 0).otherwise(1)).cast("bigint").alias("wrong_count"),
        F.max_by("is_correct", "place").alias("last_correct"),
        F.max("created_at").alias("last_attempt_at"),
    )
    # Spark keeps the four last attempts of each key in every task before the shuffle
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("place")))
    recent = attempts.select(*keys, "place", "is_correct").withColumn("back", back).where("back <= 4")
    run = recent.groupBy(*keys).agg((F.coalesce(F.min(F.when(wrong, F.col("back"))) - 1, F.count("*"))).alias("run"))
    mastery = (F.col("run") + 1).cast("bigint")
    return first.join(run, list(keys)).select(
        *keys,
        "attempt_count",
        "correct_count",
        "wrong_count",
        mastery.alias("mastery"),
        "last_correct",
        "last_attempt_at",
        due_at(F.col("last_attempt_at"), mastery).alias("review_due_at"),
        F.lit(False).alias("bookmarked"),
    )


#: Attempts, or summaries, that are put together at once.
BLOCK = 1024


def _empty() -> Column:
    """Summary of no attempts: every mastery stays (0: no attempt yet)."""
    zero = F.lit(0).cast("bigint")
    return F.struct(F.array(*[F.lit(m).cast("bigint") for m in range(6)]).alias("mastery"), F.lit(False).alias("reset"), zero.alias("wrong"), zero.alias("first_wrong"), zero.alias("attempts"), zero.alias("correct"))


def _step(run: Column, attempt: Column) -> Column:
    """Summary of a run of attempts and the next one.

    mastery: that after the run for each one before it. wrong: wrong answers since the last reset, the first
    attempt included; first_wrong: whether that one was wrong, which does not count for a new question.
    """
    ok, redo = attempt["is_correct"], F.coalesce(attempt["redo"], F.lit(False))
    after = lambda m: F.when(m == 0, F.when(~ok, 1).when(redo, 3).otherwise(2)).when(redo & ok, redo_mastery(m)).otherwise(next_mastery(m, ok)).cast("bigint")
    return F.struct(
        F.transform(run["mastery"], after).alias("mastery"),
        (run["reset"] | (redo & ok)).alias("reset"),
        F.when(redo & ok, F.lit(0).cast("bigint")).otherwise(run["wrong"] + (~ok).cast("bigint")).alias("wrong"),
        F.when(run["attempts"] == 0, (~ok).cast("bigint")).otherwise(run["first_wrong"]).alias("first_wrong"),
        (run["attempts"] + 1).alias("attempts"),
        (run["correct"] + ok.cast("bigint")).alias("correct"),
    )


def _then(run: Column, later: Column) -> Column:
    """Summary of two runs, one after the other."""
    return F.struct(
        F.transform(run["mastery"], lambda m: F.get(later["mastery"], m.cast("int"))).alias("mastery"),
        (run["reset"] | later["reset"]).alias("reset"),
        F.when(later["reset"], later["wrong"]).otherwise(run["wrong"] + later["wrong"]).alias("wrong"),
        F.when(run["attempts"] == 0, later["first_wrong"]).otherwise(run["first_wrong"]).alias("first_wrong"),
        (run["attempts"] + later["attempts"]).alias("attempts"),
        (run["correct"] + later["correct"]).alias("correct"),
    )


def summaries(attempts: DataFrame, *keys: str) -> DataFrame:
    """(keys, run, last): what the attempts of every key, in order, make of any state before them; attempts may be in redo mode (column `redo`).

    Attempts are sorted by ranges of (key, place), so that those of a hot key spread over tasks, and cut into
    blocks; summaries of blocks are composed in the same way. No row holds more than `BLOCK` of either below the top.
    """
    last = F.struct("place", "is_correct", "created_at")
    sorted_rows = attempts.select(*keys, "place", "is_correct", "redo", "created_at").repartitionByRange(*keys, "place").sortWithinPartitions(*keys, "place")
    blocks = sorted_rows.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK.bit_length() - 1))
    log = F.array_sort(F.collect_list(F.struct("place", "is_correct", "redo")))
    runs = blocks.groupBy(*keys, "block").agg(F.aggregate(log, _empty(), _step).alias("run"), F.max(last).alias("last"))
    for top in (False, True):
        level = [] if top else [F.shiftright("block", BLOCK.bit_length() - 1).alias("block")]
        parts = F.array_sort(F.collect_list(F.struct("block", "run")))
        runs = runs.groupBy(*keys, *level).agg(F.aggregate(parts, _empty(), lambda run, x: _then(run, x["run"])).alias("run"), F.max("last").alias("last"))
    return runs


def fold(attempts: DataFrame, *keys: str) -> DataFrame:
    """State of every key after its attempts in order; attempts may be in redo mode (column `redo`)."""
    runs = summaries(attempts, *keys)
    counted = F.when(F.col("run.reset"), F.col("run.wrong")).otherwise(F.col("run.wrong") - F.col("run.first_wrong"))
    return runs.select(
        *keys,
        F.col("run.attempts").alias("attempt_count"),
        F.col("run.correct").alias("correct_count"),
        counted.alias("wrong_count"),
        F.get("run.mastery", F.lit(0)).alias("mastery"),
        F.col("last.is_correct").alias("last_correct"),
        F.col("last.created_at").alias("last_attempt_at"),
    )


def advance(stats: DataFrame, attempts: DataFrame) -> DataFrame:
    """`stats` after further attempts (columns of the log, and `redo`): the stored state goes through their summary, so older attempts are not read."""
    mine = stats.select([F.col(c).alias(f"_{c}") for c in stats.columns])
    both = mine.join(summaries(attempts, "question_id"), F.col("_question_id") == F.col("question_id"), "full_outer")
    known, fresh = F.col("_question_id").isNotNull(), F.col("question_id").isNotNull()
    add = lambda c, n: F.coalesce(f"_{c}", F.lit(0)) + F.coalesce(n, F.lit(0))
    wrong = F.when(F.col("run.reset"), F.col("run.wrong")).otherwise(add("wrong_count", F.col("run.wrong")) - F.when(known, 0).otherwise(F.col("run.first_wrong")))
    mastery = F.when(fresh, F.get("run.mastery", F.coalesce(F.col("_mastery").cast("int"), F.lit(0)))).otherwise(F.col("_mastery"))
    now = {
        "question_id": F.coalesce("question_id", "_question_id"),
        "attempt_count": add("attempt_count", F.col("run.attempts")).cast("bigint"),
        "correct_count": add("correct_count", F.col("run.correct")).cast("bigint"),
        "wrong_count": F.when(fresh, wrong).otherwise(F.col("_wrong_count")).cast("bigint"),
        "mastery": mastery,
        "last_correct": F.when(fresh, F.col("last.is_correct")).otherwise(F.col("_last_correct")),
        "last_attempt_at": F.when(fresh, F.col("last.created_at")).otherwise(F.col("_last_attempt_at")),
        "review_due_at": F.when(fresh, due_at(F.col("last.created_at"), mastery)).otherwise(F.col("_review_due_at")),
        "bookmarked": F.coalesce("_bookmarked", F.lit(False)),
    }
    return both.select([now.get(c, F.col(f"_{c}")).alias(c) for c in stats.columns])


def tag_stats(attempts: DataFrame, questions: DataFrame) -> DataFrame:
    """Counters of every tag over the attempts of its questions: folded by question first, then by tag."""
    by_question = attempts.groupBy("question_id").agg(F.count("*").alias("n"), F.count_if("is_correct").alias("ok"))
    tagged = by_question.join(questions.select("id", "tags"), F.col("question_id") == F.col("id")).select("n", "ok", F.explode("tags").alias("tag"))
    return tagged.groupBy("tag").agg(F.sum("n").alias("attempt_count"), F.sum("ok").alias("correct_count"), (F.sum("n") - F.sum("ok")).alias("wrong_count"))


def merge_stats(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Keyed merge: counters add up, the higher mastery stays, latest-attempt fields come from the later side (mine on ties)."""
    m, t = mine.alias("m"), theirs.alias("t")
    both = m.join(t, F.col("m.question_id") == F.col("t.question_id"), "full_outer")
    newer = F.coalesce(F.col("t.last_attempt_at") > F.col("m.last_attempt_at"), F.col("m.last_attempt_at").isNull() & F.col("t.last_attempt_at").isNotNull())
    pick = lambda c: F.when(F.col("m.question_id").isNull() | newer & F.col("t.question_id").isNotNull(), F.col(f"t.{c}")).otherwise(F.col(f"m.{c}")).alias(c)
    add = lambda c: (F.coalesce(F.col(f"m.{c}"), F.lit(0)) + F.coalesce(F.col(f"t.{c}"), F.lit(0))).cast("bigint").alias(c)
    return both.select(
        F.coalesce("m.question_id", "t.question_id").alias("question_id"),
        *[add(c) for c in ("attempt_count", "correct_count", "wrong_count")],
        F.greatest("m.mastery", "t.mastery").alias("mastery"),
        *[pick(c) for c in ("last_correct", "last_attempt_at", "review_due_at")],
        (F.coalesce("m.bookmarked", F.lit(False)) | F.coalesce("t.bookmarked", F.lit(False))).alias("bookmarked"),
    )


def merge_tags(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    return mine.unionByName(theirs).groupBy("tag").agg(*[F.sum(c).alias(c) for c in ("attempt_count", "correct_count", "wrong_count")])


def merge_settings(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """(key, value): the imported value wins."""
    m, t = mine.alias("m"), theirs.alias("t")
    return m.join(t, F.col("m.key") == F.col("t.key"), "full_outer").select(F.coalesce("m.key", "t.key").alias("key"), F.when(F.col("t.key").isNotNull(), F.col("t.value")).otherwise(F.col("m.value")).alias("value"))


def reset_questions(table: DataFrame, gone: DataFrame, key: str, gone_key: str = "id") -> DataFrame:
    """`table` without the rows whose `key` is in `gone`."""
    return table.join(gone.select(F.col(gone_key).alias("_gone")).distinct(), F.col(key) == F.col("_gone"), "left_anti")


def clear_wrong(stats: DataFrame, cleared: Column) -> DataFrame:
    """Wrong count 0 and mastery 3 where `cleared` holds."""
    return stats.withColumns({"wrong_count": F.when(cleared, 0).otherwise(F.col("wrong_count")).cast("bigint"), "mastery": F.when(cleared, 3).otherwise(F.col("mastery")).cast("bigint")})


def bookmark(stats: DataFrame, marked: DataFrame) -> DataFrame:
    """Sets the bookmark of the ids in `marked`(question_id), with an empty state for new ones."""
    ids = marked.select(F.col("question_id").alias("_id")).distinct()
    both = stats.join(ids, F.col("question_id") == F.col("_id"), "full_outer")
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("attempt_count", "correct_count", "wrong_count", "mastery")}
    done = both.withColumns({"question_id": F.coalesce("question_id", "_id"), "last_correct": F.coalesce("last_correct", F.lit(False)), "bookmarked": F.coalesce("bookmarked", F.lit(False)) | F.col("_id").isNotNull(), **zero})
    return done.select(*stats.columns)


def latest_answers(answers: DataFrame) -> DataFrame:
    """Re-answering corrects: of each (session_id, position) the answer with the greatest place counts."""
    return answers.groupBy("session_id", "position").agg(F.max_by("question_id", "place").alias("question_id"), F.max_by("is_correct", "place").alias("is_correct"))


def session_totals(answers: DataFrame) -> DataFrame:
    """Answered, correct and wrong questions of each session after corrections."""
    return latest_answers(answers).groupBy("session_id").agg(F.count("*").alias("answered"), F.count_if("is_correct").alias("correct"), F.count_if(~F.col("is_correct")).alias("wrong"))


def append(log: DataFrame, fresh: DataFrame) -> DataFrame:
    """Imported rows after those at hand, repeats kept; columns that one side lacks are null."""
    return log.unionByName(fresh, allowMissingColumns=True)


def clear(tables: dict[str, DataFrame], session_key: str = "activeSession") -> dict[str, DataFrame]:
    """Every table empty, but the settings, which lose only the running session."""
    return {name: rows.where(F.col("key") != session_key) if name == "settings" else rows.limit(0) for name, rows in tables.items()}


def session_accuracy(totals: DataFrame) -> DataFrame:
    """`totals` of sessions with `accuracy`, null for a session without answers."""
    return totals.withColumn("accuracy", F.when(F.col("answered") > 0, round_half_up(F.col("correct") / F.col("answered") * 100)))
