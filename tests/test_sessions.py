"""Saved sessions against a plain replay of their events, and every wish a request can have."""

import random
from datetime import datetime, timedelta
from itertools import product

from pyspark.sql import functions as F

from tallyloom.operators import sessions

NOW = datetime(2024, 5, 1)


def test_progress_and_headers_equal_a_replay(spark):
    rng = random.Random(9)
    items, events, want, heads = [], [], {}, {}
    for s in range(12):
        n = 0 if s == 0 else rng.choice((1, 4, 30))
        items += [(s, p, s * 100 + p) for p in range(n)]
        state, index, submitted = {p: [None, None, None] for p in range(n)}, 0, False
        for place in range(0 if s == 1 or not n else rng.randrange(1, 60)):
            p, ok = rng.randrange(n), rng.choice((True, False, None))
            events.append((s, p, place, f"v{place}", ok))
            index, submitted = p, ok is not None
            if ok is None:
                state[p][2] = f"v{place}"
            else:
                state[p][:2] = [f"v{place}", ok]
        want |= {(s, p): (s * 100 + p, *v) for p, v in state.items()}
        heads[s] = (n, index, submitted, sum(v[1] is True for v in state.values()), sum(v[1] is False for v in state.values()))
    events += events[:7] + [(None, 0, 99, "x", True), (3, None, 99, "x", True)]  # repeated rows and null keys
    items_df = spark.createDataFrame(items + [(None, 0, 5)], "session_id long, position long, question_id long").withColumn("place", F.lit(0))
    events_df = spark.createDataFrame(events, "session_id long, position long, place long, selected string, is_correct boolean").withColumn("question_id", F.lit(-1)).repartition(5)
    done = sessions.progress(items_df, events_df)
    assert {(r.session_id, r.position): (r.question_id, r.selected, r.is_correct, r.draft) for r in done.collect()} == want
    named = spark.createDataFrame([(s, "kept") for s in range(12)], "session_id long, note string")
    got = {r.session_id: (r.total, r.current_index, r.submitted, r.correct, r.wrong) for r in sessions.headers(named, done, events_df).where("note = 'kept'").collect()}
    assert got == heads
    assert sessions.headers(named.limit(0), done, events_df).count() == 0


def test_every_wish(spark):
    """Resume, fresh and bare against sessions in progress, done, too old and missing."""
    schema = "session_id long, learner_id long, entry_key string, started_at timestamp, saved_at timestamp, total long, current_index long, submitted boolean, correct long, wrong long"
    kinds = {"going": (5, 2, True, 24), "done": (5, 4, True, 1), "last": (5, 4, False, 1), "old": (5, 2, False, 25), "empty": (0, 0, False, 1)}
    saved, requests, want = [], [], {}
    for k, (kind, resume, fresh, bare, same) in enumerate(product([*kinds, "none"], (True, False, None), (True, False), (True, False), (True, False, None))):
        if kind != "none":
            total, index, submitted, hours = kinds[kind]
            start = NOW - timedelta(hours=hours)
            saved.append((k, k, None if same is None else "here", start, start, total, index, submitted, 1, 2))
            saved.append((k + 10_000, k, "here", start, start - timedelta(seconds=1), 9, 0, False, 0, 0))  # saved before, so it does not count
        requests.append((k, NOW, "here" if same else "elsewhere", resume, fresh, bare))
        going = kind in ("going", "last")
        goes_on = kind != "none" and (bare or going and (bool(resume) or bool(same) and not fresh))
        want[k] = (k, kinds[kind][1] + kinds[kind][2], 1, 2) if goes_on else (None, None, None, None)
    asked = spark.createDataFrame(requests, "learner_id long, at timestamp, entry_key string, resume boolean, fresh boolean, bare boolean")
    decided = sessions.resumed(spark.createDataFrame(saved, schema), asked)
    assert {r.learner_id: (r.session_id, r.current_index, r.correct, r.wrong) for r in decided.collect()} == want
    assert sessions.resumed(spark.createDataFrame(saved, schema).limit(0), asked).where("session_id IS NOT NULL").count() == 0


def test_questions_that_left_the_bank_close_up(spark):
    done = spark.createDataFrame([(1, p, q, None, None, "d") for p, q in enumerate([7, 8, 9, 7])] + [(2, 0, 7, None, None, None)], "session_id long, position long, question_id long, selected string, is_correct boolean, draft string")
    decided = spark.createDataFrame([(4, 1), (4, 1), (5, None)], "learner_id long, session_id long")
    bank = spark.createDataFrame([(7,), (7,), (9,)], "id long")
    got = sessions.resumed_items(decided, done, bank).orderBy("position").collect()
    assert [(r.learner_id, r.position, r.question_id, r.draft) for r in got] == [(4, 0, 7, "d"), (4, 1, 9, "d"), (4, 2, 7, "d")]
