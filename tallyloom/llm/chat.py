"""Chat formatting of reply trees.

A message has a tree, a node (unique in its tree), a parent node (none for a root), a role, a text and
a score. Paths from leaves to roots come from iterative self-joins that double their reach: round k
joins the pointers 2**k levels up with themselves and adds, to every leaf's known ancestors, those
2**k levels above. So the rounds grow with the logarithm of the depth, and rows with the length of all
paths. Branches of a tree are ranked by the mean score of their messages; each chosen path becomes one
conversation.

Template: every turn is `<s>` role, line feed, text, `</s>`, line feed. Inside roles and texts a
backslash becomes `\\0`, `<` becomes `\\1` and, in roles, a line feed becomes `\\3`; so no mark can
occur in them, and reading back gives every role and text exactly. The loss mask is the list of spans
(start and length in code points) of the assistant's texts.

Main path: built-in expressions, joins and windows only.

Edge cases: null texts and roles count as empty; a null tree is a tree of its own; a parent that does
not exist makes its child a root; messages on a cycle have no root and belong to no conversation;
nodes without an id are left out; an empty table gives an empty result; other columns are not read.
Messages in rows by turn (`from_turns`) with equal turns are ordered by role and text; repeated rows
are repeated turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.llm.common import materialize

OPEN, CLOSE = "<s>", "</s>\n"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\0")), F.lit("<"), F.lit("\\1"))


def unescape(text: Column) -> Column:
    """Inverse of `escape`: every backslash of an escaped text starts an escape, so the order does not matter."""
    return F.replace(F.replace(F.replace(text, F.lit("\\3"), F.lit("\n")), F.lit("\\1"), F.lit("<")), F.lit("\\0"), F.lit("\\"))


def from_turns(turns: DataFrame) -> DataFrame:
    """Messages (tree, node, parent, role, text, score) of rows (conv_id, turn, role, text): each turn replies to the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    rows = turns.select(F.col("conv_id").alias("tree"), "role", "text", node.alias("node"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _matching(left: DataFrame, tree: str, node: str, right: DataFrame, how: str) -> DataFrame:
    """`left` joined to `right`(t, n, ...) on (tree, node); a null tree matches a null tree."""
    return left.join(right, left[tree].eqNullSafe(right["t"]) & (left[node] == right["n"]), how)


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): for every leaf that hangs from a root its ancestors, itself included, and how far up they are."""
    known = materialize(messages.where(F.col("node").isNotNull()).select("tree", "node", "parent"), "messages")
    ids = known.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    claimed = known.where(F.col("parent").isNotNull()).select("tree", F.col("node").alias("low"), F.col("parent").alias("high"))
    above = materialize(_matching(claimed, "tree", "high", ids, "left_semi"), "above")
    roots = _matching(known, "tree", "node", above.select(F.col("tree").alias("t"), F.col("low").alias("n")), "left_anti")
    leaves = _matching(known, "tree", "node", above.select(F.col("tree").alias("t"), F.col("high").alias("n")), "left_anti")
    reach = materialize(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "reach")
    most, step = known.count(), 1
    while step <= most and not above.isEmpty():  # on a cycle pointers never end, so the number of messages bounds the rounds
        pointers = above.select(F.col("tree").alias("t"), F.col("low").alias("n"), "high")
        further = _matching(reach, "tree", "node", pointers, "inner").select("tree", "leaf", F.col("high").alias("node"), (F.col("up") + step).alias("up"))
        reach = materialize(reach.unionByName(further), "reach")
        above = materialize(_matching(above.withColumnRenamed("high", "mid"), "tree", "mid", pointers, "inner").select("tree", "low", "high"), "above")
        step *= 2
    rooted = _matching(reach, "tree", "node", roots.select(F.col("tree").alias("t"), F.col("node").alias("n")), "left_semi").select(F.col("tree").alias("t"), F.col("leaf").alias("n"))
    return _matching(reach, "tree", "leaf", rooted, "left_semi")


def conversations(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, score, n_turns, formatted, mask): the chosen branches of every tree as one text each.

    `branches`: how many of the best branches of a tree to format (None: all). Equal scores go to the
    smaller leaf. mask: array of (start, length), in code points, of the assistant's texts.
    """
    texts = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.coalesce("role", F.lit("")).alias("role"), "text", F.coalesce("score", F.lit(0.0)).alias("score"))
    rows = materialize(_matching(paths(messages), "tree", "node", texts, "inner").drop("t", "n"), "paths")
    scores = rows.groupBy("tree", "leaf").agg(F.avg("score").alias("score"), F.max("up").alias("top"))
    best = scores.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    best = (best if branches is None else best.where(F.col("rank") <= branches)).select(F.col("tree").alias("t"), F.col("leaf").alias("n"), F.col("score").alias("mean"), "top", "rank")
    chosen = _matching(rows, "tree", "leaf", best, "inner").drop("t", "n")
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\3"))
    marked = chosen.select("tree", "leaf", "rank", "mean", "role", (F.col("top") - F.col("up")).alias("at"), F.concat(F.lit(OPEN), role, F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    order = Window.partitionBy("tree", "leaf").orderBy("at")
    ends = marked.withColumn("end", F.sum(F.length("head") + F.length("body") + len(CLOSE)).over(order))
    span = F.struct((F.col("end") - len(CLOSE) - F.length("body")).alias("start"), F.length("body").cast("long").alias("length"))
    turn = F.struct("at", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), F.when(F.col("role") == LEARNED, span).alias("span"))
    grouped = ends.groupBy("tree", "leaf", "rank").agg(F.max("mean").alias("score"), F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.select(
        "tree",
        "leaf",
        "rank",
        "score",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("formatted"),
        F.array_compact(F.transform("turns", lambda x: x["span"])).alias("mask"),
    )


def turns_of(formatted: Column) -> Column:
    """Roles and texts of a formatted conversation, read back: array of (role, text)."""
    parts = F.split(formatted, F.lit(CLOSE))
    body = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))

    def read(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        return F.struct(unescape(F.substring(role, F.lit(len(OPEN) + 1), F.length(role))).alias("role"), unescape(F.substring(part, F.length(role) + 2, F.length(part))).alias("text"))

    return F.transform(body, read)


def learned_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
