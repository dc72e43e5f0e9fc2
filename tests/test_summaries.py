"""Merged summaries stay within their error bounds."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import summaries

SCHEMA = "g string, day int, ms long, who long"


def log(n, seed):
    rng = random.Random(seed)
    return [(rng.choice("aab") if i % 3 else "hot", rng.randrange(30), rng.choice([0, rng.randrange(1, 200), int(rng.lognormvariate(8, 2))]), rng.randrange(4000)) for i in range(n)]


def test_quantiles_within_the_error(spark):
    rows = log(4000, 1) + [("n", 1, None, 5), ("m", 1, 7, None), ("z", 2, -4, 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    stored = summaries.summarize(frame, ["g", "day"], "ms", "who")
    marks = [0, 1, 50, 95, 99, 100]
    for first, last in ((0, 29), (3, 9), (5, 5)):
        got = {r.g: r for r in summaries.quantiles(summaries.merge(stored.where(F.col("day").between(first, last)), ["g"]), ["g"], marks).collect()}
        for g in {r[0] for r in rows}:
            values = sorted(r[2] for r in rows if r[0] == g and first <= r[1] <= last and r[2] is not None)
            assert (g in got) == bool(values)
            for h in marks if values else []:
                exact = max(0, values[h * (len(values) - 1) // 100])
                assert got[g].n == len(values) and abs(got[g][f"p{h}"] - exact) <= summaries.ERROR * exact + 1e-9, (g, h)


@pytest.mark.parametrize("n", [0, 1, 50, 3000, 60_000])
def test_distinct_counts_within_four_standard_errors(spark, n):
    rows = spark.range(n).select(F.lit("g").alias("g"), (F.col("id") % 7).cast("int").alias("day"), F.lit(1).cast("long").alias("ms"), (F.col("id") * 7919).alias("who"))
    twice = rows.unionByName(rows.withColumn("day", F.lit(8)))  # the same members again on another day
    stored = summaries.summarize(twice, ["g", "day"], "ms", "who")
    got = summaries.distinct_counts(summaries.merge(stored, ["g"]), ["g"]).collect()
    assert [abs(r.members - n) <= 4 * 1.04 / summaries.REGISTERS**0.5 * n + 1 for r in got] == [True] * (n > 0)


def test_cells_do_not_grow_with_the_rows(spark):
    frame = spark.createDataFrame(log(6000, 2), SCHEMA)
    few = summaries.summarize(frame.limit(3000), ["g"], "ms", "who").where("kind = 'q'").groupBy("g").count().agg(F.max("count")).first()[0]
    many = summaries.summarize(frame.unionByName(frame).unionByName(frame), ["g"], "ms", "who").where("kind = 'q'").groupBy("g").count().agg(F.max("count")).first()[0]
    assert many < 1200 and few > 100
