"""Near-duplicates by the Jaccard similarity of five-word shingles, joined with SimHash links.

Words are those of `simhash`; a text's shingles are its distinct runs of `SHINGLE` words (fewer words:
the whole sequence). Two texts are linked if their shingles have Jaccard similarity `SIMILARITY` or
more, or if their fingerprints differ in at most `simhash.BITS` bits.

Method: texts with the same shingles fold into one node. Candidates share one of `BANDS` band keys of
`ROWS` minima under random hashes each (a pair at 0.8 shares none with probability under 3 in 100,000),
and the exact similarity of a candidate pair verifies it. Before that a pair must agree in size (fewer
shingles at least `SIMILARITY` of more, exactly) and in `LEAST_EQUAL` of all minima, by one byte each (a pair
at 0.8 fails with probability 2e-6). A pair that shares several buckets is taken in the first of them only. Each bucket first meets its least node; only nodes of a bucket that
are then still in different components are compared with each other, so a group of near copies costs
its size, not its square.

Edge cases: null and blank texts have no shingles, fingerprint zero, and link to each other; rows that
repeat a document are rows of the same group; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import simhash
from tallyloom.llm.common import checked_broadcast, materialize, shuffled, small_batches
from tallyloom.llm.components import connected_components
from tallyloom.llm.features import Prefixes, mix, runs

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
#: Minima that the sketches of a pair have in common at least, of BANDS * ROWS.
LEAST_EQUAL = 48
_BLANK = bytes(32 if c in b" \t\n\x0b\x0c\r" else c for c in range(256))
_draw = np.random.default_rng(42)
_TIMES = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles of UTF-8 bytes."""
    data = np.frombuffer((text or b"").lower().translate(_BLANK), dtype=np.uint8)
    words = Prefixes(data).span(*runs(data != 32))
    if not len(words):
        return words
    k = min(SHINGLE, len(words))
    n = len(words) - k + 1
    total = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        total += mix(words[i : i + n] + np.uint64(i + 1)) * np.uint64(2 * i + 3)
    return np.unique(mix(total))


def name(found: np.ndarray) -> int:
    """Signed 64-bit name of a set of shingles."""
    return simhash._signed(xxhash.xxh64_intdigest(found.tobytes(), simhash.SEED))


def band_keys(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One key for each band and a byte of each minimum; none without shingles."""
    if not len(found):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int8)
    minima = np.array([mix(found * a + b).min() for a, b in zip(_TIMES, _PLUS, strict=True)])
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        keys = mix(keys * _TIMES[i] + minima.reshape(BANDS, ROWS)[:, i])
    return keys.view(np.int64), (minima >> np.uint64(20)).astype(np.uint8).view(np.int8)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        out: list[list] = [[], [], [], [], []]
        for text in batch.column("text"):
            found = shingles(text.as_py())
            for column, value in zip(out, (simhash.fingerprint(text.as_py()), name(found), *band_keys(found), len(found)), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int8()), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], ["row", "doc_id", "fp", "node", "bands", "minima", "n"])


def _alike(x: Column, y: Column, n: Column, m: Column) -> Column:
    """Whether two sketches can be those of a pair that reaches the similarity."""
    equal = F.aggregate(F.zip_with(x, y, lambda a, b: (a == b).cast("int")), F.lit(0), lambda total, e: total + e)
    return (F.least(n, m) >= SIMILARITY * F.greatest(n, m)) & (equal >= LEAST_EQUAL)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        found = [shingles(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([pa.array([name(x) for x in found], pa.int64()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["node", "shingles"])


def verified(docs: DataFrame, sketches: DataFrame, pairs: DataFrame, row: Column) -> DataFrame:
    """The `pairs` (u, v) of nodes that reach the similarity."""
    pairs = materialize(pairs, "shingle-pairs")
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    rows = sketches.join(checked_broadcast(materialize(nodes, "shingle-nodes")), "node").groupBy("node").agg(F.min("row").alias("wanted"))
    texts = docs.join(checked_broadcast(materialize(rows.select("wanted"), "shingle-rows")), row == F.col("wanted"), "left_semi")
    sets = materialize(texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(_sets, "node long, shingles array<long>").dropDuplicates(["node"]), "shingle-sets")
    sets = checked_broadcast(sets)
    side = lambda end, out: sets.select(F.col("node").alias(end), F.col("shingles").alias(out))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(side("u", "x"), "u").join(side("v", "y"), "v").where(both >= SIMILARITY * (F.size("x") + F.size("y") - both)).select("u", "v")


def groups(docs: DataFrame, row: Column) -> DataFrame:
    """(row, doc_id, node, group) for every row of `docs`; `row` names rows, and group the linked ones."""
    sketches = materialize(docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(_sketches, "row long, doc_id long, fp long, node long, bands array<long>, minima array<tinyint>, n int"), "sketches")
    # SimHash links, each fingerprint standing for the least of its nodes
    prints = materialize(sketches.groupBy("fp").agg(F.min("node").alias("least"), F.max("node").alias("most")), "shingle-prints")
    several = prints.where("least <> most").select("fp", "least")
    same = sketches.join(checked_broadcast(several), "fp").select(F.col("least").alias("u"), F.col("node").alias("v"))
    near = materialize(simhash.links(prints.select("fp")).distinct(), "shingle-prints-linked")
    end = lambda e: prints.select(F.col("fp").alias(e), F.col("least").alias(f"{e}_node"))
    near = checked_broadcast(near).join(end("u"), "u").join(shuffled(end("v")), "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    # shingle links of every node of a bucket to the bucket's least node
    members = sketches.select("node", F.explode("bands").alias("band")).distinct()
    buckets = materialize(members.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("band", "least"), "shingle-buckets")
    members = materialize(members.join(checked_broadcast(buckets), "band"), "shingle-members")
    wanted = checked_broadcast(materialize(members.select("node").distinct(), "shingle-bucketed"))
    traits = checked_broadcast(materialize(sketches.select("node", "minima", "n", "bands").join(wanted, "node").dropDuplicates(["node"]), "shingle-traits"))
    of = lambda end, x, n, bands: traits.select(F.col("node").alias(end), F.col("minima").alias(x), F.col("n").alias(n), F.col("bands").alias(bands))
    likely = _alike(F.col("x"), F.col("y"), F.col("n_x"), F.col("n_y"))
    first = members.where("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v")).distinct()
    first = first.join(of("u", "x", "n_x", "bands_x"), "u").join(of("v", "y", "n_y", "bands_y"), "v").where(likely).select("u", "v")
    edges = materialize(same.unionByName(near).unionByName(verified(docs, sketches, first, row)).where("u <> v").distinct(), "shingle-edges")
    # and among the nodes of a bucket that are still apart
    placed = materialize(_rooted(members, edges), "shingle-placed")
    split = materialize(placed.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("band"), "shingle-split")
    placed = placed.join(checked_broadcast(split), "band")
    one = placed.select("band", "least", F.col("node").alias("u"), F.col("root").alias("a")).join(of("u", "x", "n_x", "bands_x"), "u")
    other = placed.select(F.col("band").alias("other_band"), F.col("node").alias("v"), F.col("root").alias("b")).join(of("v", "y", "n_y", "bands_y"), "v")
    once = F.get(F.array_intersect("bands_x", "bands_y"), F.lit(0)) == F.col("band")
    apart = (F.col("band") == F.col("other_band")) & F.expr("u < v AND a <> b AND u <> least") & likely & once
    second = one.join(other, apart).select("u", "v").distinct()
    edges = materialize(edges.unionByName(verified(docs, sketches, second, row)), "shingle-edges")
    return _rooted(sketches.select("row", "doc_id", "node"), edges).withColumnRenamed("root", "group")


def _rooted(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """`rows` with the root of each `node` over `edges`; a node without edges is its own."""
    roots = materialize(connected_components(edges), "shingle-roots")
    return rows.join(checked_broadcast(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
