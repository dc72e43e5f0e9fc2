"""SimHash near-duplicates through vantage-point trees over 64-bit fingerprints.

Fingerprint: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, 4-word shingles (repeats included,
space-joined; fewer words: the whole sequence; none: zero), XXH64 with seed 42; a bit is set if
it is set in over half of the hashes.

Linking at `bits` or fewer differing bits, exactly. The 64 bits are cut into `bits` + 2 blocks, so a
linked pair is equal in two blocks at least: each choice of two blocks makes a forest whose trees are
named by the bits of these blocks. Within a tree, every node has a vantage point of its own and puts
its fingerprints on rings of `bits` + 1 distances from it (Hamming, over the other blocks); a ring is a
node of the next level and the last level's rings are leaves (shards). By the triangle bound the
distances of a linked pair differ by `bits` at most, so a query visits its own ring and those that
this bound reaches over the boundary. While both are in one ring they see each other, and only the
one nearer to the vantage point asks across the boundary. Leaves meet in an equi-join and a popcount
verifies each pair. Depth grows with the logarithm of the distinct fingerprints; every row goes
through the same path.

Copies fold into one fingerprint before the search, so a group of copies costs one node.

Edge cases: null and blank texts have fingerprint zero and link like any other; rows that repeat a
doc_id are kept and labelled one by one; a null doc_id never names a component unless all its ids are
null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import checked_broadcast, materialize, shuffled, small_batches
from tallyloom.llm.components import connected_components

SHINGLE = 4
SEED = 42
BITS = 4
#: Shingle hashes whose bits are counted at once: bounds the memory of very long texts.
CHUNK = 1 << 16


def fingerprint(text: bytes | None, k: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of UTF-8 bytes."""
    tokens = (text or b"").lower().split()  # bytes: A-Z only, and exactly the six blanks
    if not tokens:
        return 0
    joined = memoryview(b" ".join(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(k, len(tokens))
    n = len(tokens) - k + 1
    digest, seed = xxhash.xxh64_intdigest, SEED
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        spans = zip(starts[at : min(at + CHUNK, n)].tolist(), ends[at + k - 1 : min(at + CHUNK, n) + k - 1].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in spans), dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        prints = [fingerprint(x.as_py()) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row of `docs`."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forests(bits: int) -> list[int]:
    """For each choice of two of `bits` + 2 blocks, the mask of their bits."""
    n = bits + 2
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [x | y for x, y in combinations(blocks, 2)]


def depth_for(n: int) -> int:
    """Levels of the trees over n fingerprints: a tree of two blocks holds about n / 2**21 of them."""
    return max(1, min(4, (max(n, 1).bit_length() - 14) // 6))


def _roots(nodes: DataFrame, bits: int) -> DataFrame:
    """`nodes` once for each forest, with `mask` (the bits that the vantage points compare) and the root of its tree."""
    masks = forests(bits)
    trees = [F.struct(F.lit(_signed(~m & (1 << 64) - 1)).cast("long").alias("mask"), F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long"))).alias("node")) for k, m in enumerate(masks)]
    return nodes.select("fp", F.inline(F.array(*trees)))


def leaves(nodes: DataFrame, bits: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """(fp, mask, node) of every fingerprint's own leaves, and (fp, node, same) of the leaves it visits."""
    width = bits + 1
    # the vantage point of a node follows from its name
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.xxhash64(F.lit(SEED), "node")).bitwiseAND(F.col("mask")))
    ring = lambda d: F.floor(d / width).cast("int")
    below = lambda r: F.xxhash64("node", r)
    homes = _roots(nodes, bits)
    asked = homes.withColumn("same", F.lit(True))
    for _ in range(levels):
        homes = homes.select("fp", "mask", below(ring(distance)).alias("node"))
        first = F.when(F.col("same"), F.col("d")).otherwise(F.greatest(F.col("d") - bits, F.lit(0)))
        visited = asked.withColumn("d", distance).select("*", F.explode(F.sequence(ring(first), ring(F.col("d") + bits))).alias("r"))
        asked = visited.select("fp", "mask", below(F.col("r")).alias("node"), (F.col("same") & (F.col("r") == ring(F.col("d")))).alias("same"))
    return homes, asked


def candidates(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): the pairs that share a leaf, before they are verified."""
    homes, asked = leaves(nodes, bits, depth_for(nodes.count()))
    asked = asked.select(F.col("fp").alias("a"), F.col("node").alias("visited"), "same")
    return asked.join(shuffled(homes.select(F.col("fp").alias("b"), "node")), (F.col("visited") == F.col("node")) & (~F.col("same") | (F.col("a") < F.col("b")))).select("a", "b")


def links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs (u < v) of the distinct `fp` of `nodes` at `bits` or fewer differing bits, possibly repeated across forests."""
    near = candidates(nodes, bits).where((F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits) & (F.col("a") != F.col("b")))
    return near.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def near_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of `docs`; component_id is the smallest doc_id reachable."""
    prints = materialize(fingerprints(docs), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = materialize(connected_components(links(nodes, bits)).withColumnRenamed("node", "fp"), "roots")
    named = materialize(nodes.join(checked_broadcast(roots), "fp"), "linked")
    least = materialize(named.groupBy("root").agg(F.min("least").alias("component")), "components")
    named = materialize(named.join(checked_broadcast(least), "root").select("fp", "component"), "named")
    labels = materialize(nodes.join(checked_broadcast(named), "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")), "labels")
    return prints.join(checked_broadcast(labels), "fp").select("doc_id", "fp", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
