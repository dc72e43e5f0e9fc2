"""Reads of the stored log open only the files that they need."""

from datetime import datetime, timedelta

from tallyloom.sources.log_layout import LogLayout

START = datetime(2024, 1, 1)


def test_files_opened(spark, tmp_path):
    rows = [(i, i % 50 if i % 3 else 7, START + timedelta(minutes=13 * i), 5, "x") for i in range(3000)]  # question 7 is hot
    rows = [r[:3] for r in rows] + [(9001, 1, None)]
    frame = spark.createDataFrame(rows, "attempt_id long, question_id long, created_at timestamp")
    layout = LogLayout(spark, str(tmp_path / "log"), "question_id", "created_at", 40).add(frame.where("attempt_id % 5 > 0")).add(frame.where("attempt_id % 5 = 0"))
    everything = layout.read()
    total = len(everything.inputFiles())
    assert sorted(r.attempt_id for r in everything.collect()) == sorted(r[0] for r in rows)
    day = layout.read("2024-01-03", "2024-01-03")
    inside = [r for r in rows if r[2] and r[2].date() == datetime(2024, 1, 3).date()]
    assert sorted(r.attempt_id for r in day.collect()) == sorted(r[0] for r in inside)
    assert len(day.inputFiles()) <= total / 10
    narrow = layout.read("2024-01-03", "2024-01-04", 20, 22)
    want = sorted(r[0] for r in rows if r[2] and datetime(2024, 1, 3) <= r[2] < datetime(2024, 1, 5) and 20 <= r[1] <= 22)
    assert sorted(r.attempt_id for r in narrow.collect()) == want and want
    assert len(narrow.inputFiles()) < len(layout.read("2024-01-03", "2024-01-04").inputFiles())
    counts = layout.counts()
    assert {str(r.day): r.rows for r in counts.collect()}["2024-01-03"] == len(inside)
    assert all("/files/" in f for f in counts.inputFiles())  # the log itself is not opened
    assert layout.read("2031-01-01").count() == 0 and layout.read("2031-01-01").columns == frame.columns
