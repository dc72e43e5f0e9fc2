import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tallyloom.operators import analytics, scheduler, state, streaks

START = datetime(2024, 1, 1)


def attempts_of(spark, sequences):
    rows = [(i, k, k, bool(ok), redo, START + timedelta(minutes=j), j) for k, seq in enumerate(sequences) for j, (ok, redo) in enumerate(seq) for i in [k * 1000 + j]]
    schema = "attempt_id long, learner_id long, question_id long, is_correct boolean, redo boolean, created_at timestamp, n long"
    return spark.createDataFrame(rows, schema).withColumn("place", F.col("n").cast("decimal(38,0)"))


def brute(seq):
    n = right = wrong = mastery = 0
    for ok, redo in seq:
        if n == 0:
            mastery = (3 if redo else 2) if ok else 1
        elif redo and ok:
            wrong, mastery = 0, max(3, min(5, mastery + 1))
        else:
            mastery = min(5, 2 if mastery < 1 else mastery + 1) if ok else 1
            wrong += not ok
        n, right = n + 1, right + bool(ok)
    return n, right, wrong, mastery


def test_closed_form_equals_fold_equals_brute_force(spark):
    rng = random.Random(3)
    sequences = [[(rng.random() < 0.7, False) for _ in range(rng.randint(1, 12))] for _ in range(60)]
    log = attempts_of(spark, sequences)
    want = {k: brute(s) for k, s in enumerate(sequences)}
    for df in (state.question_stats(log), state.fold(log, "question_id")):
        assert {r.question_id: (r.attempt_count, r.correct_count, r.wrong_count, r.mastery) for r in df.collect()} == want


def test_redo(spark):
    rng = random.Random(4)
    sequences = [[(rng.random() < 0.6, rng.random() < 0.5) for _ in range(rng.randint(1, 12))] for _ in range(60)]
    got = {r.question_id: (r.attempt_count, r.correct_count, r.wrong_count, r.mastery) for r in state.fold(attempts_of(spark, sequences), "question_id").collect()}
    assert got == {k: brute(s) for k, s in enumerate(sequences)}


def stats_of(spark, **fields):
    base = {"question_id": 1, "attempt_count": 0, "correct_count": 0, "wrong_count": 0, "mastery": 0, "last_correct": False, "last_attempt_at": None, "review_due_at": None, "bookmarked": False} | fields
    schema = "question_id long, attempt_count long, correct_count long, wrong_count long, mastery long, last_correct boolean, last_attempt_at timestamp, review_due_at timestamp, bookmarked boolean"
    return spark.createDataFrame([tuple(base.values())], schema)


def test_wrong_predicate(spark):
    assert scheduler.wrong_questions(stats_of(spark, wrong_count=2, correct_count=2, mastery=1)).count() == 1
    assert scheduler.wrong_questions(stats_of(spark, wrong_count=1, correct_count=3, mastery=3)).count() == 0


def test_due_without_stored_date(spark):
    due = lambda days, mastery: stats_of(spark, mastery=mastery, last_attempt_at=START).select(scheduler.stored_due(F.lit(START + timedelta(days=days)))).first()[0]
    assert due(4, 2) and not due(1, 2) and due(2, 99)


def test_bookmark_and_mastery_of_untouched_rows(spark):
    marked = state.bookmark(stats_of(spark, question_id=1, attempt_count=3, mastery=4), spark.createDataFrame([(1,), (2,)], "question_id long"))
    assert {(r.question_id, r.attempt_count, r.bookmarked) for r in marked.collect()} == {(1, 3, True), (2, 0, True)}
    questions = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    row = analytics.mastery_summary(questions, marked).first()
    assert (row.mastered, row.weak, row.untouched) == (1, 1, 2)


def test_merge_ties_keep_mine(spark):
    mine, theirs = (stats_of(spark, attempt_count=1, mastery=m, last_correct=ok, last_attempt_at=START) for m, ok in ((2, True), (4, False)))
    row = state.merge_stats(mine, theirs).first()
    assert (row.attempt_count, row.mastery, row.last_correct) == (2, 4, True)


def streak(spark, days, today="2026-06-19"):
    rows = [(datetime(2026, 6, 19, 12) - timedelta(days=d) if d is not None else None,) for d in days]
    found = streaks.active_days(spark.createDataFrame(rows, "at timestamp"), "at")
    return streaks.current_streak(found, today).first().streak


def test_streaks(spark):
    assert [streak(spark, d) for d in ([0, 2], [1], [1, 2], [0, 0, 0, 1], [3, 4], [None, 0])] == [1, 1, 2, 2, 0, 1]


def test_empty_log(spark):
    log = attempts_of(spark, [])
    assert state.question_stats(log).count() == 0
    assert analytics.trend(log).first().rate == 0
