"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Codes: vectors are centred, taken to their principal axes and turned by a rotation that alternates between the
signs and the best rotation towards them (both learned from a bounded sample); a code is the signs, 64 bits at most.

Index: every row with its code, in shards of bounded size. Within a shard each of SUBSTRINGS parts of the codes has a
directory from its values to their rows, so a bucket of any size lies in ranges of rows over all shards.

Search: a query asks for every code within a Hamming radius r. By the pigeonhole principle a code within
r = m * q + a (m substrings, 0 <= a < m) differs in at most q bits in one of the first a + 1 substrings or in at most q - 1 bits
in one of the others; these buckets are probed, their rows verified on whole codes and ranked by distances
of the floats. The radius follows from a bound on the distance of the k-th neighbour: the k-th distance in the sample
at first. Under it a sixteenth of the shards are searched, the others within NEAR bits only, which finds near neighbours
wherever they lie; the k-th distance of what they found then bounds the radius for the others, where only codes
that were not yet retrieved are ranked. How many bits vectors at a distance differ in is calibrated on the sample (SURE of its
neighbours lie within). Without a bound the radius takes in all codes.

Fitted on a sample, applied to every row. The query set meets all rows in tiles (`vectors.tiles`): a task holds one
shard and one tile of queries at a time, and nothing is broadcast but the model and the sample, whose bytes are bounded.

Edge cases: rows whose vector is null, zero or holds null or non-finite components and rows without a vec_id
take no part; a vec_id that several query rows bear is asked once, with the least of their vectors; every other row is a
candidate of its own, so repeated rows may both be found; fewer than k candidates are all found; no rows or no queries give none. Vectors
of several lengths are a ValueError. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.llm.common import materialize
from tallyloom.llm.vectors import finite, matrix, shard_count, spread, tiles, width_of

#: Rows of the sample that the rotation, the calibration and the first bounds come from, and its bytes at most.
SAMPLE_ROWS = 4096
SAMPLE_BYTES = 8 << 20
BITS = 64
SUBSTRINGS = 4
STEPS = 25
SURE = 0.95
#: One of so many shards is searched first, the others within so many bits.
FIRST_SHARE = 16
NEAR = 7


@dataclass
class Model:
    """Turns vectors into codes, and distances into Hamming radii."""

    mean: np.ndarray
    rotation: np.ndarray  # (components, bits)
    sample_ids: np.ndarray
    sample: np.ndarray
    margin: float = 0.0  # standard deviations over the mean of differing bits

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]

    @cached_property
    def cuts(self) -> list[tuple[int, int]]:
        """(shift, width) of the substrings."""
        m = min(SUBSTRINGS, self.bits)
        edges = [self.bits * i // m for i in range(m + 1)]
        return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]

    def encode(self, rows: np.ndarray) -> np.ndarray:
        signs = (rows - self.mean) @ self.rotation > 0
        padded = np.zeros((len(rows), 64), bool)
        padded[:, : self.bits] = signs
        return np.packbits(padded, axis=1, bitorder="little").view("<u8")[:, 0]

    def expected(self, rows: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and deviation of the bits that differ between `rows` and vectors as long at the distances `apart`."""
        reach = 2 * np.linalg.norm(rows - self.mean, axis=1)
        rate = np.where(apart < reach, 2 / np.pi * np.arcsin(np.minimum(1, apart / np.maximum(reach, 1e-300))), 1.0)
        return self.bits * rate, np.sqrt(self.bits * rate * (1 - rate) + 1)

    def radius(self, rows: np.ndarray, bound: np.ndarray) -> np.ndarray:
        mean, deviation = self.expected(rows, np.where(np.isfinite(bound), bound, np.inf))
        return np.clip(np.ceil(mean + self.margin * deviation), 0, self.bits).astype(int)


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - query) ** 2).sum(1))


def fit(ids: np.ndarray, rows: np.ndarray, k: int, bits: int = BITS) -> Model:
    """Rotation and calibration from a sample in memory; without rows, codes are the signs of the first components."""
    width = rows.shape[1]
    bits = min(bits, width)
    if not len(rows):
        return Model(np.zeros(width), np.eye(width, bits), ids, rows)
    mean = rows.mean(0)
    centred = rows - mean
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :bits]
    turned, rotation = centred @ axes, np.linalg.qr(np.random.default_rng(0).normal(size=(bits, bits)))[0]
    for _ in range(STEPS):
        left, _, right = np.linalg.svd(turned.T @ np.where(turned @ rotation > 0, 1.0, -1.0))
        rotation = left @ right
    model = Model(mean, axes @ rotation, ids, rows)
    codes, off = model.encode(rows), []
    for i in range(min(len(rows), 512)):
        far = distances(rows, rows[i])
        near = np.argsort(far, kind="stable")[1 : k + 1]
        mean_bits, deviation = model.expected(rows[[i] * len(near)], far[near])
        off.append((np.bitwise_count(codes[near] ^ codes[i]) - mean_bits) / deviation)
    off = np.concatenate(off)
    model.margin = float(np.quantile(off, SURE)) if len(off) else 0.0
    return model


class Shard:
    """Rows of a shard with a directory for each substring of their codes."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, codes: np.ndarray, cuts: list[tuple[int, int]]):
        self.ids, self.rows, self.codes = ids, rows, codes
        self.directories = []
        for shift, width in cuts:
            part = codes >> np.uint64(shift) & np.uint64((1 << width) - 1)
            values, counts = np.unique(part, return_counts=True)
            self.directories.append((shift, width, values, np.cumsum(counts) - counts, counts, np.argsort(part, kind="stable")))

    def probe(self, code: np.uint64, radius: int) -> np.ndarray:
        """Rows whose codes differ from `code` in `radius` bits at most."""
        each, more = divmod(radius, len(self.directories))
        seen = np.zeros(len(self.ids), bool)
        for place, (shift, width, values, starts, counts, order) in enumerate(self.directories):
            reach = each if place <= more else each - 1
            if reach < 0:
                continue
            own = code >> np.uint64(shift) & np.uint64((1 << width) - 1)
            if (asked := flips(width, reach)) is not None and len(asked) < len(values):
                at = np.searchsorted(values, asked ^ own)
                at = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == asked ^ own)]
            else:  # fewer buckets than values to ask for
                at = np.flatnonzero(np.bitwise_count(values ^ own) <= reach)
            n = counts[at]
            seen[order[np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]] = True
        found = np.flatnonzero(seen)
        return found[np.bitwise_count(self.codes[found] ^ code) <= radius]


_FLIPS: dict[tuple[int, int], np.ndarray] = {}


def flips(width: int, reach: int) -> np.ndarray | None:
    """Values of `width` bits with up to `reach` bits set; None if they are too many to ask for one by one."""
    if width > 16:
        return None
    if (width, reach) not in _FLIPS:
        values = np.arange(1 << width, dtype=np.uint64)
        _FLIPS[width, reach] = values[np.bitwise_count(values) <= reach]
    return _FLIPS[width, reach]


def _encoder(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = model.encode(matrix(batch.column("embedding"), len(model.mean))).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(codes)], ["vec_id", "embedding", "code"])

    return run


def _bounder(model: Model, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k-th distance of each query in the sample, and the radius asked of all shards at first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, asked = [], matrix(batch.column("query"), len(model.mean))
            for own, query in zip(batch.column("query_id").to_numpy(zero_copy_only=False), asked, strict=True):
                far = distances(model.sample[model.sample_ids != own], query)
                bounds.append(float(np.partition(far, k - 1)[k - 1]) if len(far) >= k else np.inf)
            near = np.minimum(model.radius(asked, np.array(bounds)), NEAR)
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("query"), pa.array(bounds, pa.float64()), pa.array(near, pa.int32())], ["query_id", "query", "bound", "near"])

    return run


FOUND = "query_id bigint, vec_id bigint, score double, probed bigint"


def _searcher(model: Model, k: int, stage: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Ranks codes within the radius of the bound ("whole"), within `near` bits ("near"), or those beyond `near` within the radius ("rest")."""

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if index.num_rows and queries.num_rows:
            codes = index["code"].to_numpy().astype(np.int64).view(np.uint64)
            shard = Shard(index["vec_id"].to_numpy(), matrix(index["embedding"], len(model.mean)), codes, model.cuts)
            asked, bound = matrix(queries["query"], len(model.mean)), queries["bound"].to_numpy()
            near = queries["near"].to_numpy()
            radii = near if stage == "near" else model.radius(asked, bound)
            for own, query, code, radius, done, far in zip(queries["query_id"].to_pylist(), asked, model.encode(asked), radii, near, bound, strict=True):
                if stage == "rest" and radius <= done:
                    continue
                found = shard.probe(code, int(radius))
                if stage == "rest":
                    found = found[np.bitwise_count(shard.codes[found] ^ code) > done]
                score = distances(shard.rows[found], query)
                stays = (shard.ids[found] != own) & (score <= far)
                ids, score = shard.ids[found][stays], score[stays]
                best = np.lexsort((ids, score))[:k]
                out.append((np.full(len(best), own), ids[best], score[best], np.full(len(best), len(found))))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], [], []]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "vec_id", "score", "probed"), columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)})

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    return vectors.where(F.col("vec_id").isNotNull() & finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")


@dataclass
class Index:
    """Every row with its code and shard, as a written table, and the model of the codes."""

    rows: DataFrame
    n_rows: int
    model: Model


def build(vectors: DataFrame, k: int = 10, bits: int = BITS) -> Index:
    rows = usable(vectors)
    width, n, _ = width_of(rows, "embedding")
    width = max(width, 1)
    bound = min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * width), n // 8)
    sample = rows.orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(bound).collect() if bound else []
    ids, points = np.array([r["vec_id"] for r in sample], np.int64), np.array([r["embedding"] for r in sample], float).reshape(len(sample), width)
    model = fit(ids, points, k, bits)
    kind = vectors.schema["embedding"].dataType.simpleString()
    coded = rows.mapInArrow(_encoder(model), f"vec_id bigint, embedding {kind}, code bigint").withColumn("part", spread(shard_count(n)))
    return Index(materialize(coded, "hash_index"), n, model)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score, probed) of the k nearest rows found for each of `queries`(vec_id, embedding).

    A row that bears the query's vec_id is the query's own and no result; `probed` is the number of codes of the result's shard that were ranked.
    """
    asked = usable(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("query"))
    kind = queries.schema["embedding"].dataType.simpleString()
    asked = materialize(asked.mapInArrow(_bounder(index.model, k), f"query_id bigint, query {kind}, bound double, near int"), "queries")
    n_queries, light = asked.count(), replace(index.model, sample=None, sample_ids=None)

    def over(rows: DataFrame, bounded: DataFrame, n_rows: int, stage: str) -> DataFrame:
        a, b = tiles(rows.select("vec_id", "embedding", "code"), bounded, n_rows, n_queries)
        return a.groupBy("shard", "tile").cogroup(b.groupBy("shard", "tile")).applyInArrow(_searcher(light, k, stage), FOUND)

    n_first = max(1, shard_count(index.n_rows) // FIRST_SHARE)
    n_rows = index.n_rows * n_first // shard_count(index.n_rows)
    some, others = index.rows.where(F.col("part") < n_first), index.rows.where(F.col("part") >= n_first)
    first = materialize(over(some, asked, n_rows, "whole").union(over(others, asked, index.n_rows - n_rows, "near")), "first_found")
    kth = _best(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("its_query"), F.col("score").alias("kth"))
    bounded = asked.join(kth, F.col("query_id") == F.col("its_query"), "left").select("query_id", "query", F.least("bound", "kth").alias("bound"), "near")
    rest = over(others, bounded, index.n_rows - n_rows, "rest")
    return _best(first.union(rest), k).select("query_id", "rank", "vec_id", "score", "probed")
