"""Overlap joins, tree labels, streaks from blocks and stratified samples against plain code."""

import hashlib
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import intervals, sampling, streaks


@pytest.mark.parametrize(("width", "bin_rows"), [(10, 1000), (3, 4), (1000, 7)])
def test_overlap_join_equals_all_pairs(spark, width, bin_rows):
    rng = random.Random(width)
    span = lambda: (lambda a: (a, a + rng.choice((0, 0, 1, 7, 40))))(rng.randrange(-50, 150))
    left = [(i, *span(), rng.choice("xy")) for i in range(120)] + [(500 + i, 20, 21, "x") for i in range(60)] + [(900, 5, 4, "x"), (901, None, 3, "x"), (902, 1, 2, None)]
    right = [(i, *span(), rng.choice("xy")) for i in range(80)] + [(900, 9, 1, "x"), (901, 3, None, "x")]
    a, b = spark.createDataFrame(left, "i long, s long, e long, k string"), spark.createDataFrame(right, "j long, from long, until long, k string")
    whole = lambda r: None not in r[1:3] and r[1] <= r[2]
    want = sorted((x[0], y[0]) for x in left for y in right if whole(x) and whole(y) and x[3] == y[3] and x[1] <= y[2] and y[1] <= x[2])
    met = intervals.overlap_join(a, b, ("s", "e"), ("from", "until"), width, ("k",), bin_rows)
    assert sorted((r.i, r.j) for r in met.collect()) == want
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    free = intervals.overlap_join(a.drop("k"), b.drop("k"), ("s", "e"), ("from", "until"), width, (), bin_rows)
    assert free.count() == sum(x[1] <= y[2] and y[1] <= x[2] for x in left for y in right if whole(x) and whole(y))


def test_tree_labels_in_pre_order(spark):
    rng = random.Random(9)
    nodes = [("k0", None), ("lone", "gone")] + [(f"k{i}", f"k{rng.randrange(max(0, i - 30), i)}") for i in range(1, 200)]
    children = {}
    for key, parent in nodes:
        children.setdefault(parent if parent != "gone" else None, []).append(key)
    want, parents = {}, dict(nodes)

    def walk(key, depth):
        want[key] = [len(want) + 1, depth]
        for child in sorted(children.get(key, [])):
            walk(child, depth + 1)
        want[key].append(len(want))

    for top in sorted(children[None]):
        walk(top, 0)
    labels = intervals.tree_labels(spark.createDataFrame(nodes, "key string, parent string"))
    assert {r.key: [r.entry, r.depth, r.exit] for r in labels.collect()} == want
    below = {r.key for r in intervals.subtree(labels, "k3").collect()}

    def under(key):
        while (key := parents.get(key)) is not None:
            if key == "k3":
                return True
        return False

    assert below == {k for k in parents if under(k)} and below
    pairs = labels.alias("n").join(labels.where("key IN ('k3', 'k5')").alias("t"), intervals.is_below("n", "t")).select("n.key", "t.key").collect()
    assert {r[0] for r in pairs if r[1] == "k3"} == below
    assert intervals.subtree(labels, "none").count() == 0
    assert intervals.tree_labels(spark.createDataFrame([], "key string, parent string")).count() == 0


@pytest.mark.parametrize("block_days", [1, 2, 5, 32])
def test_streaks_from_any_cut(spark, block_days):
    rng = random.Random(block_days)
    today = date(2024, 1, 30)
    rows = [(k, today - timedelta(days=d)) for k in range(30) for d in range(60) if rng.random() < (0.95 if k % 2 else 0.5)] + [(99, today), (98, today - timedelta(days=1)), (97, today - timedelta(days=2))]
    days = spark.createDataFrame(rows, "learner long, day date")
    got = {r.learner: (r.streak, r.longest) for r in streaks.merged_streaks(streaks.block_summaries(days, "learner", block_days=block_days), str(today), "learner").collect()}
    current = {r.learner: r.streak for r in streaks.current_streak(days, str(today), "learner").collect()}
    longest = {r.learner: r.streak for r in streaks.longest_streak(days, "learner").collect()}
    assert got == {k: (current[k], longest[k]) for k in current}
    # a new day: its block alone is summed up again
    new = days.where(F.col("day") == str(today))
    old = streaks.block_summaries(days.where(F.col("day") < str(today)), "learner", block_days=block_days)
    again = streaks.merged_streaks(old.unionByName(streaks.block_summaries(new, "learner", block_days=block_days)), str(today), "learner")
    assert {r.learner: (r.streak, r.longest) for r in again.collect()} == got


def test_samples_merge(spark):
    rows = [(i, "hot" if i % 3 else f"g{i % 7}") for i in range(900)]
    frame = spark.createDataFrame(rows, "id long, g string")
    digest = lambda i: hashlib.md5(f"s:{i}".encode()).hexdigest()
    want = {(i, g, k + 1) for group in {g for _, g in rows} for k, (i, g) in enumerate(sorted((r for r in rows if r[1] == group), key=lambda r: digest(r[0]))[:5])}
    whole = sampling.bottom_k(frame, 5, ["g"], seed="s")
    assert {tuple(r) for r in whole.collect()} == want
    parts = [sampling.bottom_k(frame.where(f"id % 4 = {k}"), 5, ["g"], seed="s") for k in range(4)]
    assert {tuple(r) for r in sampling.merged(parts, 5, ["g"], seed="s").collect()} == want
    assert "WindowGroupLimit" in whole._jdf.queryExecution().executedPlan().toString()  # before the shuffle
    exam = sampling.by_quotas(frame, {"hot": 5, "g3": 2, "none": 3, "g1": 0}, "g", seed="s")
    assert {tuple(r) for r in exam.collect()} == {r for r in want if r[1] == "hot" or r[1] == "g3" and r[2] <= 2}
    assert sampling.by_quotas(frame, {}, "g").count() == 0


def test_rows_within_a_stretch_are_counted_not_paired(spark):
    """Equal places, keys that are null, ends that meet places, and ranges of few rows; no join has two sides of rows."""
    rng = random.Random(5)
    rows = [(rng.choice((None, 1, 2, 3)), rng.choice((None, *range(60)))) for _ in range(300)]
    frame = spark.createDataFrame(rows, "who long, at long").repartition(5)
    for keys in ((), ("who",)):
        found = intervals.within(frame, "at", 7, keys)
        want = {(w if keys else None, t): sum(1 for v, x in rows if x is not None and t <= x <= t + 7 and (not keys or v == w)) for w, t in rows if t is not None}
        assert {(r["who"] if keys else None, r["at"]): r["inside"] for r in found.collect()} == want
        assert found.count() == len(want)
    assert intervals.within(frame.limit(0), "at", 7).collect() == []
    dense = spark.range(20_000).select((F.col("id") % 10).alias("at"))  # 2e8 pairs if paired
    assert {r["at"]: r["inside"] for r in intervals.within(dense, "at", 100).collect()} == {t: 20_000 - 2000 * t for t in range(10)}
