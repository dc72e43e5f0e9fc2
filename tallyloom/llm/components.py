"""Connected components over an edge table, by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import BROADCAST_BYTES, materialize, shuffled

#: Bytes that a row (u, v) takes in a broadcast table, about.
PAIR_BYTES = 48


def _minima(pairs: DataFrame) -> DataFrame:
    """Least neighbour of each u, itself included."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges`(u, v); root is the least node reachable.

    Every round is two grouped minima and two joins over the remaining edges, written to the shared
    folder. Rounds grow with the logarithm of the nodes. Loops (u = v) and repeated edges do no harm;
    rows with a null end are ignored; no edges give no rows. Beyond `BROADCAST_BYTES` no side of a join is broadcast.
    """
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    rows, seen = edges.count(), None
    for _ in range(max_rounds):
        bounded = shuffled if 2 * rows * PAIR_BYTES > BROADCAST_BYTES else (lambda side: side)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(bounded(_minima(both)), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = _minima(down)
        small = down.join(bounded(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())
        rows, seen = now[0], now
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
