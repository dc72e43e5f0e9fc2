"""Vector code compression: product codebooks fitted by exponion search, exact in integers.

Components become integers (`scale` times, rounded down) and a vector is cut into equal parts, each with a
codebook of its own. A round assigns every part to the nearest entry (squared distance, ties to the lower
index) and moves every entry to the mean of its parts, rounded down; entries that no part took stay.

Exponion search: a part starts at the entry a it had in the round before, at squared distance d. An entry that is
as near or nearer lies, by the triangle inequality, within twice the distance from a, so in squares within
4d of it. The entries around a are listed by their distance from a once a round (16 lists of 16), and the scan
ends at the first that lies beyond that radius. All comparisons are between integers, so none is lost to rounding.

Rounds run in tasks over the rows where they lie. Only sums and counts for each entry are shuffled, and
only the codebooks (parts x entries x components) reach the driver. The integers and entries of a round are
persisted for the next; a lost part is computed again from the table, without a shuffle.

Edge cases: rows whose vector is null or holds null or non-finite components are left out; null and repeated
vec_ids are rows like any other (nulls come last among the first entries, repeats in the order of their vectors); fewer rows than entries give
as many entries as rows; no rows give none. Vectors of several lengths, a length that the parts do not divide, and
components that reach 2**27 after scaling are a ValueError, since distances would not fit. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import checked_broadcast, materialize
from tallyloom.llm.vectors import finite, floors, matrix, width_of

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Components stay below this, so that squared distances and their sums fit in 64 bits.
LIMIT = 1 << 27
#: Rows assigned at once in a task.
CHUNK = 8192


def around(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, apart) of the (entries, components) `book`: entries by squared distance from each entry, and these distances."""
    apart = ((book[:, None] - book[None]) ** 2).sum(2)
    order = np.argsort(apart, axis=1, kind="stable")
    return order, np.take_along_axis(apart, order, 1)


def nearest(rows: np.ndarray, book: np.ndarray, start: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, squared distance) nearest to each row, searched from entry `start`; also the distances computed."""
    order, apart = lists
    best = ((rows - book[start]) ** 2).sum(1)
    entry, computed = start.copy(), len(rows)
    radius, active = 4 * best, np.arange(len(rows))
    for place in range(len(book)):
        active = active[apart[start[active], place] <= radius[active]]  # lists ascend: who leaves does not come back
        if not len(active):
            break
        tried = order[start[active], place]
        far = ((rows[active] - book[tried]) ** 2).sum(1)
        computed += len(active)
        wins = (far < best[active]) | ((far == best[active]) & (tried < entry[active]))
        best[active[wins]], entry[active[wins]] = far[wins], tried[wins]
    return entry, best, computed


def _assigner(books: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Assigns every part of every row anew, from the entries in `codes`."""
    n_parts, _, wide = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [around(b) for b in books]
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                x = matrix(batch.column("ints"), n_parts * wide, np.int64)
                codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, n_parts).astype(np.int64)
                error = np.zeros(len(x), np.int64)
                for p, book in enumerate(books):
                    codes[:, p], best, _ = nearest(x[:, p * wide : (p + 1) * wide], book, codes[:, p], lists[p])
                    error += best
                packed = pa.array([row.tobytes() for row in codes.astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("ints"), packed, pa.array(error)], ["vec_id", "label", "ints", "codes", "error"])

    return run


def _summer(shape: tuple[int, int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of the components and counts of the parts at each entry, once for each task."""
    n_parts, entries, wide = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((n_parts, entries, wide + 1), np.int64)
        for batch in batches:
            x = matrix(batch.column("ints"), n_parts * wide, np.int64)
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, n_parts)
            for p in range(n_parts):
                np.add.at(totals[p, :, :wide], codes[:, p], x[:, p * wide : (p + 1) * wide])
                totals[p, :, wide] += np.bincount(codes[:, p], minlength=entries)
        flat = totals.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], ["cell", "total"])

    return run


def _state(rows: DataFrame, books: np.ndarray) -> DataFrame:
    kind = rows.schema["vec_id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(_assigner(books), f"vec_id {kind[0]}, label {kind[1]}, ints array<bigint>, codes binary, error bigint")


def moved(books: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Entries at the means of their parts, rounded down; entries without parts stay."""
    sums, counts = totals[..., :-1], totals[..., -1:]
    return np.where(counts > 0, sums // np.maximum(counts, 1), books)


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, ints) of the rows that take part."""
    return vectors.where(finite(F.col("embedding"))).select("vec_id", "label", floors(F.col("embedding"), scale).alias("ints"))


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, codes, error) under the final codebooks, and these as (parts, entries, components); None without rows."""
    if entries > 256:
        raise ValueError("codes hold entries up to 255")
    width, n, (largest,) = width_of(rows, "ints", F.max(F.array_max(F.transform("ints", F.abs))))
    if not n or not width:
        return rows.select("vec_id", "label", F.lit(b"").alias("codes"), F.lit(0).cast("bigint").alias("error")), None
    if width % parts or largest >= LIMIT:
        raise ValueError(f"{width} components in {parts} parts, up to {largest}")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).collect()
    books = np.array([r["ints"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    state, kept = rows.withColumn("codes", F.lit(bytes(parts))), []
    for _ in range(rounds):
        state = _state(state.select("vec_id", "label", "ints", "codes"), books).persist()
        kept.append(state)
        cells = state.select("ints", "codes").mapInArrow(_summer(books.shape), "cell bigint, total bigint").groupBy("cell").agg(F.sum("total").alias("total")).collect()
        totals = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
        for cell, total in cells:
            totals.flat[cell] = total
        books = moved(books, totals)
        for old in kept[:-1]:
            old.unpersist()
        kept = kept[-1:]
    done = materialize(_state(state.select("vec_id", "label", "ints", "codes"), books).select("vec_id", "label", "codes", "error"), "codes")
    for old in kept:
        old.unpersist()
    return done, books


def digest(books: np.ndarray) -> str:
    """SHA-256 of the entries' components by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def as_text(codes: Column) -> Column:
    """Codes in hexadecimal, two lower-case digits for each part."""
    return F.lower(F.hex(codes))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for every row of `vectors`(vec_id, embedding, label) that takes part."""
    done, books = fit(integers(vectors, scale), parts, entries, rounds)
    of_label = materialize(done.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors").withColumnRenamed("label", "its_label")
    joined = done.join(checked_broadcast(of_label), F.col("label").eqNullSafe(F.col("its_label")))
    return joined.select("vec_id", as_text(F.col("codes")).alias("code"), "error", "label_error", F.lit(digest(books) if books is not None else "").alias("codebooks_sha256"))
