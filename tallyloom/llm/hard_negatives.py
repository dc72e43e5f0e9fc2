"""Hard-negative mining: product quantisation with stored residual norms, and exact integer reranks.

Components become integers (`scale` times, rounded down). For each pair of components a codebook is fitted to a bounded
sample; every row stores its nearest entries and, for each part, the norm of what they leave over. The score of a row for
an anchor is their inner product: the sum of a table look-up for each part, which is exact for the entries, plus the inner
product with the residual, which by Cauchy and Schwarz is at most the sum of the parts' products of norms. So every
row has a lower and an upper bound. Per anchor and window of scores, the rows are kept whose bounds reach
the window and whose upper bound is not below k lower bounds of rows that lie in it for certain; their integer inner
products then decide. No row of the k best is lost, so results are exact whatever the sample was.

The k best are sought in a sixteenth of the shards first; the k-th score found raises the low end of the window for the others,
which then keep and send less. Anchors meet all rows in tiles (`vectors.tiles`); a task holds one shard and one tile at a time.

Edge cases: rows with a null vec_id or label, a null vector or null or non-finite components take no part; a vec_id that
several anchors bear is asked once, with the least of their (vector, label); rows with the anchor's vec_id are never its positives; every other row counts on its own,
so repeated rows may both be positives or negatives; anchors without positives give no rows; fewer rows than asked
are all given. Vectors of several lengths and components that reach 2**20 after scaling are a ValueError, since scores would not fit.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.llm.common import materialize
from tallyloom.llm.vectors import finite, floors, matrix, shard_count, spread, tiles, width_of

SCALE = 256
LIMIT = 1 << 20
#: Components of a part and entries of a codebook.
PART = 2
ENTRIES = 256
#: Rows that the codebooks are fitted to, their bytes at most, and rounds of the fit.
SAMPLE_ROWS = 8192
SAMPLE_BYTES = 8 << 20
ROUNDS = 6
FIRST_SHARE = 16
#: Scores are smaller than this.
ENDLESS = 1 << 62


def parts_of(rows: np.ndarray) -> np.ndarray:
    """(parts, rows, PART) of integer rows; the last part is filled up with zeros."""
    missing = -rows.shape[1] % PART
    return np.pad(rows, ((0, 0), (0, missing))).reshape(len(rows), -1, PART).transpose(1, 0, 2)


def nearest(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
    """An entry near each row; any entry is right, near ones give narrow bounds."""
    return np.argmin((book**2).sum(1) - 2.0 * rows @ book.T, axis=1)


def fit(sample: np.ndarray, entries: int = ENTRIES) -> np.ndarray:
    """Codebooks (parts, entries, PART) of integers for the rows of `sample`."""
    books = []
    for rows in parts_of(sample).astype(float):
        book = rows[:entries].copy()
        for _ in range(ROUNDS):
            code = nearest(rows, book)
            counts = np.bincount(code, minlength=len(book))
            sums = np.stack([np.bincount(code, rows[:, i], len(book)) for i in range(PART)], axis=1)
            book[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
        books.append(np.rint(book).astype(np.int64))
    return np.stack(books)


def encode(rows: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, norms) of rows by parts; norms of what the entries leave over are never too small."""
    codes, norms = [], []
    for part, book in zip(parts_of(rows), books, strict=True):
        code = nearest(part.astype(float), book.astype(float))
        codes.append(code)
        norms.append(np.sqrt(((part - book[code]) ** 2).sum(1).astype(float)))
    up = np.nextafter(np.stack(norms, 1).astype(np.float32), np.float32(np.inf))
    return np.stack(codes, 1).astype(np.uint8), up


class Shard:
    """Coded rows, with the places of each label."""

    def __init__(self, books: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, codes: np.ndarray, norms: np.ndarray):
        self.books, self.ids, self.labels, self.rows = books, ids, labels, rows
        self.cells = codes.astype(np.int64) + np.arange(len(books)) * books.shape[1]
        self.norms = norms.astype(float)

    def bounds(self, anchor: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of the rows `at`."""
        own = parts_of(anchor[None])[:, 0]
        table = (self.books * own[:, None]).sum(2).ravel()
        seen = table[self.cells[at]].sum(1)
        slack = self.norms[at] @ np.sqrt((own**2).sum(1).astype(float)) * (1 + 1e-9) + 1e-6
        return seen - slack, seen + slack

    def best(self, anchor: np.ndarray, at: np.ndarray, windows: list[tuple[int, int, int]], k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(key, places, scores) of the k best of the rows `at` for each window (key, low, high): by score from above, then by id."""
        low, high = self.bounds(anchor, at)
        masks = []
        for _, least, most in windows:
            may = (high >= least) & (low <= most)
            sure = np.flatnonzero((low >= least) & (high <= most))
            if len(sure) > k:
                may &= high >= np.partition(low[sure], len(sure) - k)[len(sure) - k]
            masks.append(may)
        needed = np.flatnonzero(np.logical_or.reduce(masks))
        score = self.rows[at[needed]] @ anchor
        out = []
        for (key, least, most), may in zip(windows, masks, strict=True):
            stays = may[needed] & (score >= least) & (score <= most)
            places, won = at[needed[stays]], score[stays]
            first = np.lexsort((self.ids[places], -won))[:k]
            out.append((key, places[first], won[first], int(may.sum())))
        return out


@dataclass
class Index:
    """Every row with integers, codes, residual norms and shard, as a written table, and the codebooks."""

    rows: DataFrame
    n_rows: int
    width: int
    books: np.ndarray | None


def _encoder(books: np.ndarray, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, norms = encode(matrix(batch.column("ints"), width, np.int64), books)
            packed = [pa.array([row.tobytes() for row in x], pa.binary()) for x in (codes, norms)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("ints"), *packed], ["vec_id", "label", "ints", "codes", "norms"])

    return run


def build(vectors: DataFrame, scale: int = SCALE) -> Index:
    """Codes for every usable row of `vectors`(vec_id, embedding, label)."""
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("embedding")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), floors(F.col("embedding"), scale).alias("ints"))
    width, n, (largest,) = width_of(rows, "ints", F.max(F.array_max(F.transform("ints", F.abs))))
    if not n or not width:
        return Index(rows, 0, 0, None)
    if largest >= LIMIT:
        raise ValueError(f"components up to {largest}")
    sample = rows.orderBy(F.xxhash64("vec_id", "ints"), "vec_id").limit(min(SAMPLE_ROWS, max(1, SAMPLE_BYTES // (8 * width)))).collect()
    books = fit(np.array([r["ints"] for r in sample], np.int64))
    coded = rows.mapInArrow(_encoder(books, width), "vec_id bigint, label bigint, ints array<bigint>, codes binary, norms binary")
    return Index(materialize(coded.withColumn("part", spread(shard_count(n))), "coded"), n, width, books)


def _searcher(index: Index, k: int, same: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    books, width = index.books, index.width

    def run(rows: pa.Table, asks: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and asks.num_rows:
            read = lambda name, kind: np.frombuffer(b"".join(rows[name].to_pylist()), kind).reshape(rows.num_rows, -1)
            shard = Shard(books, rows["vec_id"].to_numpy(), rows["label"].to_numpy(), matrix(rows["ints"], width, np.int64), read("codes", np.uint8), read("norms", np.float32))
            of_label = {label: np.flatnonzero(shard.labels == label) for label in np.unique(shard.labels).tolist()}
            for own, label, anchor, windows in zip(asks["anchor_id"].to_pylist(), asks["label"].to_pylist(), matrix(asks["anchor"], width, np.int64), asks["windows"].to_pylist(), strict=True):
                at = of_label.get(label, np.array([], int)) if same else np.flatnonzero(shard.labels != label)
                if same:
                    at = at[shard.ids[at] != own]
                for key, places, scores, tried in shard.best(anchor, at, [(w["key"], w["low"], w["high"]) for w in windows], k):
                    out.append((np.full(len(places), own), np.full(len(places), key), shard.ids[places], scores, np.full(len(places), tried)))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[]] * 5
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("anchor_id", "key", "vec_id", "score", "tried"), columns, strict=True)})

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "key").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_in_windows(index: Index, anchors: DataFrame, windows: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor_id, key, rank, vec_id, score, tried): for each of `windows`(anchor_id, key, low, high) the k best rows of the anchor's label (`same`) or of others.

    `windows` has a few rows for each of `anchors`(anchor_id, label, anchor); `tried` is the number of rows of the result's shard that reached the rerank.
    """
    n_anchors, look = anchors.count(), _searcher(index, k, same)
    found = "anchor_id bigint, key bigint, vec_id bigint, score bigint, tried bigint"

    def over(rows: DataFrame, asked: DataFrame, n_rows: int) -> DataFrame:
        lists = asked.groupBy(F.col("anchor_id").alias("its_anchor")).agg(F.collect_list(F.struct("key", "low", "high")).alias("windows"))
        asks = anchors.join(lists, F.col("anchor_id") == F.col("its_anchor")).select("anchor_id", "label", "anchor", "windows")
        a, b = tiles(rows.select("vec_id", "label", "ints", "codes", "norms"), asks, n_rows, n_anchors)
        return a.groupBy("shard", "tile").cogroup(b.groupBy("shard", "tile")).applyInArrow(look, found)

    n_first = max(1, shard_count(index.n_rows) // FIRST_SHARE)
    share = index.n_rows * n_first // shard_count(index.n_rows)
    first = materialize(over(index.rows.where(F.col("part") < n_first), windows, share), "first_found")
    kth = _first(first, k).where(F.col("rank") == k).select(F.col("anchor_id").alias("its_anchor"), F.col("key").alias("its_key"), "score")
    raised = windows.join(kth, (F.col("anchor_id") == F.col("its_anchor")) & (F.col("key") == F.col("its_key")), "left").select("anchor_id", "key", F.greatest("low", "score").alias("low"), "high")
    return _first(first.union(over(index.rows.where(F.col("part") >= n_first), raised, index.n_rows - share)), k)


MINED = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def mine(vectors: DataFrame, is_anchor: str, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = SCALE) -> DataFrame:
    """For each anchor (rows of `vectors`(vec_id, embedding, label) where `is_anchor` holds for the vec_id) and each of its `positives`
    best rows of the same label: the `negatives` best rows of other labels whose score is `low` to `high` hundredths of the positive's.
    """
    index = build(vectors, scale)
    if not index.n_rows:
        return vectors.sparkSession.createDataFrame([], MINED)
    anchors = index.rows.where(is_anchor).groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("ints", "label")).alias("x")).select("anchor_id", "x.label", F.col("x.ints").alias("anchor"))
    anchors = materialize(anchors, "anchors")
    whole = anchors.select("anchor_id", F.lit(0).cast("long").alias("key"), F.lit(-ENDLESS).alias("low"), F.lit(ENDLESS).alias("high"))
    near = best_in_windows(index, anchors, whole, positives, True)
    pairs = materialize(near.select("anchor_id", F.col("rank").cast("long").alias("key"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    hundredths = lambda n: F.col("positive_score") * n  # noqa: E731  100 times the ends of the window
    least = hundredths(low) + F.pmod(-hundredths(low), F.lit(100))
    most = hundredths(high) - F.pmod(hundredths(high), F.lit(100))
    windows = pairs.select("anchor_id", "key", least.alias("low"), most.alias("high")).select("anchor_id", "key", F.expr("low div 100").alias("low"), F.expr("high div 100").alias("high"))
    mined = best_in_windows(index, anchors, materialize(windows, "windows"), negatives, False)
    return mined.join(pairs, ["anchor_id", "key"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), "tried")
