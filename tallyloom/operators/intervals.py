"""Overlapping spans, and trees as spans.

Spans meet in an equi-join of bins: a span lies in every bin of `width` it touches, and a pair is kept in the one bin where the later of
its starts lies, so it comes once. Bins that hold many rows of the left side are dealt to several parts, to which the right side's rows of that bin are sent as well.

A tree in pre-order is a list in which every subtree is one stretch: `entry` is a node's place, `exit` the last place below
it, and being below is a comparison of numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.operators.ordering import ranked
from tallyloom.operators.retrieval import ancestors
from tallyloom.sources.shared import checked_broadcast, materialize

#: Left rows of a bin that one task takes.
BIN_ROWS = 1 << 16


def _bins(rows: DataFrame, start: str, end: str, width: int) -> DataFrame:
    at = lambda c: F.floor(F.col(c) / width)
    valid = rows.where(F.col(start) <= F.col(end))  # spans without an end, or that end before they start, meet nothing
    return valid.withColumn("_bin", F.explode(F.sequence(at(start), at(end))))


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], width: int, keys: tuple[str, ...] = (), bin_rows: int = BIN_ROWS) -> DataFrame:
    """Pairs of rows, equal in `keys`, whose closed spans (whole numbers, two columns of each side) overlap; columns of both, with distinct names but for the keys.

    `width` is about the usual length of the longer side's spans: a span is copied for each bin it touches.
    """
    (ls, le), (rs, re) = left_span, right_span
    a, b = materialize(_bins(left, ls, le, width), "left_bins"), _bins(right, rs, re, width)
    place = [*keys, "_bin"]
    hot = a.groupBy(*place).agg(F.count("*").alias("_n")).where(F.col("_n") > bin_rows).select(*place, F.ceil(F.col("_n") / bin_rows).cast("int").alias("_parts"))
    hot = materialize(hot, "hot_bins")
    parts = F.coalesce("_parts", F.lit(1))
    dealt = a.join(checked_broadcast(hot), place, "left").withColumn("_part", F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), parts)).drop("_parts")
    sent = b.join(checked_broadcast(hot), place, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), (parts - 1).cast("bigint")))).drop("_parts")
    met = dealt.join(sent, [*place, "_part"]).where((F.col(ls) <= F.col(re)) & (F.col(rs) <= F.col(le)) & (F.floor(F.greatest(ls, rs) / width) == F.col("_bin")))
    return met.drop("_bin", "_part")


def within(points: DataFrame, at: str, length: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, at, inside): for every place `at` of a row the rows, equal in `keys`, from it on to `length` after it, both ends included.

    Rows are counted up to both ends, not paired, so the work does not grow with what lies within a stretch. Equal places are one row
    with a count; counts run over ranges of sorted places, and of a range only its sum meets the others. Rows without a place count nowhere.
    """
    order = [*keys, at]
    held = points.where(F.col(at).isNotNull()).groupBy(*order).agg(F.count("*").alias("_n"))
    ends = held.select(*keys, (F.col(at) + length).alias(at), F.lit(0).cast("bigint").alias("_n"), F.col(at).alias("_from"))
    both = held.withColumn("_from", F.lit(None).cast(held.schema[at].dataType)).unionByName(ends)
    # of equal places the row comes before the end, so that the end counts it
    placed = materialize(both.orderBy(*order, F.col("_from").isNotNull()).withColumn("_id", F.monotonically_increasing_id()), "places")
    part = F.shiftrightunsigned("_id", 33)
    sums = placed.groupBy(part.alias("_part")).agg(F.sum("_n").alias("_sum"))
    before = sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))
    run = F.sum("_n").over(Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0))
    counted = placed.withColumn("_part", part).withColumn("_run", run).join(F.broadcast(before), "_part")
    start, upto = F.col("_from").isNull(), F.col("_run") + F.col("_before")
    # all up to the end less all before the place
    share = F.when(start, F.col("_n") - upto).otherwise(upto)
    return counted.groupBy(*keys, F.coalesce("_from", at).alias(at)).agg(F.sum(share).alias("inside"))


def tree_labels(nodes: DataFrame) -> DataFrame:
    """(key, parent, depth, entry, exit) of a tree table (key, parent): places in pre-order from 1, children by their keys.

    Nodes under a parent that is no node are roots. A circle is an error.
    """
    known = nodes.select(F.col("key").alias("_known"))
    rooted = materialize(nodes.join(known, F.col("parent") == F.col("_known"), "left").select("key", F.col("_known").alias("parent")), "nodes")
    above = materialize(ancestors(rooted), "above")
    paths = above.groupBy(F.col("key").alias("_key")).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("down"), "ancestor"))), lambda x: x["ancestor"]).alias("path"))
    sizes = above.groupBy(F.col("ancestor").alias("_top")).agg(F.count("*").alias("below"))
    listed = rooted.join(paths, F.col("key") == F.col("_key"), "left").join(sizes, F.col("key") == F.col("_top"), "left")
    path = F.concat(F.coalesce("path", F.array().cast("array<string>")), F.array("key"))
    placed = ranked(listed.select("key", "parent", path.alias("path"), F.coalesce("below", F.lit(0)).alias("below")), [F.asc("path")], name="entry")
    return placed.select("key", "parent", (F.size("path") - 1).alias("depth"), "entry", (F.col("entry") + F.col("below")).alias("exit"))


def is_below(node: str, top: str) -> Column:
    """Whether the node of the alias `node` is in the subtree of that of the alias `top`, itself excluded."""
    return (F.col(f"{node}.entry") > F.col(f"{top}.entry")) & (F.col(f"{node}.entry") <= F.col(f"{top}.exit"))


def subtree(labels: DataFrame, key: str) -> DataFrame:
    """Labels of all nodes below `key`: one look-up and one range, whatever the depth."""
    top = labels.where(F.col("key") == key).select("entry", "exit").first()
    return labels.where(F.col("entry").between(top["entry"] + 1, top["exit"])) if top else labels.limit(0)
