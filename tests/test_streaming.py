"""Streams give the results of the batch operators on the same files."""

import random
from itertools import pairwise

import pandas as pd

from tallyloom.operators import state
from tallyloom.sources import tables
from tallyloom.streaming import states


def stream_to_rows(spark, df, mode, name, folder):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(folder)).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)


def test_question_states(spark, sf_small, tmp_path):
    events = spark.read.parquet(f"{sf_small}/events.parquet")
    ordered = events.orderBy("ts", "event_id").toPandas()
    for i in range(3):  # files in the order of time
        spark.createDataFrame(ordered.iloc[i * 334 : (i + 1) * 334], events.schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    updates = stream_to_rows(spark, states.question_states(states.attempt_stream(source)), "update", "question_updates", tmp_path / "c1")
    last = {}
    for r in updates.collect():
        last[r.question_id] = max(last.get(r.question_id, (0,)), (r.attempt_count, r.correct_count, r.wrong_count, r.mastery))
    batch = state.question_stats(tables.attempts(spark, sf_small))
    assert last == {r.question_id: (r.attempt_count, r.correct_count, r.wrong_count, r.mastery) for r in batch.collect()}


def test_tag_counters_and_windows(spark, sf_small, tmp_path):
    schema = spark.read.parquet(f"{sf_small}/events.parquet").schema
    spark.read.parquet(f"{sf_small}/events.parquet").coalesce(1).write.parquet(str(tmp_path / "in"))
    attempts = states.attempt_stream(states.event_stream(spark, str(tmp_path / "in"), schema))
    questions = tables.questions(spark, sf_small)
    got = stream_to_rows(spark, states.tag_counters(attempts, questions), "complete", "tag_counts", tmp_path / "c2")
    want = state.tag_stats(tables.attempts(spark, sf_small), questions)
    key = lambda df: sorted((r.tag, r.attempt_count, r.correct_count, r.wrong_count) for r in df.collect())
    assert key(got) == key(want)
    days = stream_to_rows(spark, states.windowed_counts(attempts), "complete", "day_counts", tmp_path / "c3")
    assert sum(r.attempts for r in days.collect()) == tables.attempts(spark, sf_small).count()


def test_summaries_merge_in_any_order():
    """A hot question sends one row for each batch of rows, whatever their number."""
    rng = random.Random(3)
    rows = pd.DataFrame({"question_id": 7, "attempt_id": range(5000), "created_at": pd.to_datetime([rng.randrange(10**6) for _ in range(5000)], unit="s"), "is_correct": [rng.random() < 0.8 for _ in range(5000)]})
    whole = next(states.question_blocks(iter([rows])))
    assert len(whole) == 1
    shuffled = rows.sample(frac=1, random_state=1)
    parts = [p for i in range(0, 5000, 700) for p in states.question_blocks(iter([shuffled[i : i + 700]]))]
    assert [len(p) for p in parts] == [1] * 8 and all(len(p.recent[0]) == 3 * states.RECENT for p in parts)
    now = None
    for p in parts:
        block = tuple(p[c][0] for c in ("attempts", "correct", "first", "recent"))
        now = states.merged(now, block) if now else block
    assert states.standing(now) == states.standing(tuple(whole[c][0] for c in ("attempts", "correct", "first", "recent")))
    mastery = wrong = 0
    for k, ok in enumerate(rows.sort_values(["created_at", "attempt_id"]).is_correct.tolist()):
        wrong += not ok and k > 0
        mastery = (min(5, 2 if mastery < 1 else mastery + 1)) if ok else 1
    assert states.standing(now)[2:4] == (wrong, mastery)
    assert list(states.question_blocks(iter([rows.iloc[:0], rows.assign(question_id=None)]))) == []


def test_runs_join_in_any_order():
    rng = random.Random(4)
    for _ in range(50):
        points = [(t, t, 1, t % 2) for t in (rng.randrange(300) for _ in range(rng.randint(0, 30)))]
        want = states.runs(points, 10)
        assert all(b[0] - a[1] >= 10 for a, b in pairwise(want)) and sum(s[2] for s in want) == len(points)
        rng.shuffle(points)
        some = []
        for i in range(0, len(points), 4):
            some = states.runs(some + states.runs(points[i : i + 4], 10), 10)
        assert some == want


def test_idle_sessions_go_on_after_a_restart(spark, tmp_path):
    """Stopped between batches and started again from its checkpoint, a stream closes the same sessions, once each."""
    hour = lambda h: pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h)
    hours = {1: [0, 5, 28, 60, 61], 2: [1, 1, 40], 3: [70], 4: [3, 26.9, 51, 75]}
    rows = sorted((h, learner, k) for learner, at in hours.items() for k, h in enumerate(at)) + [(130, 9, 0), (None, 5, 0), (20, None, 0)]
    schema = "attempt_id long, learner_id long, created_at timestamp, is_correct boolean"

    def add(part, k):
        spark.createDataFrame([(10 * k + i, n, None if h is None else hour(h).to_pydatetime(), bool(c % 2)) for i, (h, n, c) in enumerate(part)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))

    out = str(tmp_path / "out")

    def go():
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        query = states.idle_sessions(source).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()
        return query.lastProgress

    for k in range(4):
        add(rows[3 * k : 3 * k + 3], k)
    go()
    for k in range(4, 6):
        add(rows[3 * k : 3 * k + 3], k)
    progress = go()
    got = sorted((r.learner_id, (r.start - hour(0)).total_seconds() / 3600, (r.end - hour(0)).total_seconds() / 3600, r.attempts) for r in spark.read.parquet(out).collect())
    assert got == [(1, 0, 28, 3), (1, 60, 61, 2), (2, 1, 1, 2), (2, 40, 40, 1), (3, 70, 70, 1), (4, 3, 26.9, 2), (4, 51, 51, 1), (4, 75, 75, 1)]
    kept = progress["stateOperators"][0]["numRowsTotal"]
    assert kept <= 4  # of four closed learners nothing is left; learner 9 has a session and a timer, which has two entries


def test_idle_sessions_end_at_the_microsecond(spark, tmp_path):
    """A gap of exactly the idle time parts two sessions and one of a microsecond less does not; the state is Spark's own, without Python."""
    day = pd.Timedelta(hours=24)
    at, micro = pd.Timestamp("2024-01-01"), pd.Timedelta(microseconds=1)
    rows = [(1, at, True), (1, at + day, None), (2, at, True), (2, at + day - micro, True), (2, at, False), (3, at + 10 * day, True)]
    schema = "attempt_id long, learner_id long, created_at timestamp, is_correct boolean"
    spark.createDataFrame([(k, n, t.to_pydatetime(), ok) for k, (n, t, ok) in enumerate(rows)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = states.idle_sessions(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    plan = out._jdf.queryExecution().analyzed().toString()  # noqa: SLF001
    assert "InPandas" not in plan
    found = stream_to_rows(spark, out, "append", "closed_sessions", tmp_path / "c4").collect()
    assert sorted((r.learner_id, pd.Timestamp(r.start) - at, pd.Timestamp(r.end) - at, r.attempts, r.correct) for r in found) == [(1, 0 * day, 0 * day, 1, 1), (1, day, day, 1, 0), (2, 0 * day, day - micro, 3, 2)]


def test_only_first_and_last_attempts_become_lists(monkeypatch):
    made = []
    plain = states._places  # noqa: SLF001
    monkeypatch.setattr(states, "_places", lambda rows: made.append(len(rows)) or plain(rows))
    rows = pd.DataFrame({"question_id": [k % 3 for k in range(900)], "attempt_id": range(900), "created_at": pd.to_datetime(range(900), unit="s"), "is_correct": True})
    assert next(states.question_blocks(iter([rows]))).attempts.tolist() == [300] * 3
    assert sum(made) <= 3 * (1 + states.RECENT)
