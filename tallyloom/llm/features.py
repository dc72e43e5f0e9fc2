"""Vectorized hashing of the terms of a text, and bounded samples of labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes hashed at once; texts are cut at blanks, so memory does not grow with the text.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.multiply.accumulate(np.array([1] + [base] * (size - 1), dtype=np.uint64)) for base in (_BASE, _INVERSE)]
    return _powers


def chunks(data: bytes, size: int = CHUNK) -> Iterator[bytes]:
    """Parts of `data` of about `size` bytes, cut at spaces."""
    at = 0
    while len(data) - at > size:
        cut = data.find(b" ", at + size)
        if cut < 0:
            break
        yield data[at:cut]
        at = cut
    yield data[at:]


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    steps = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    return steps[::2], steps[1::2]


class Prefixes:
    """Hashes of any spans of a byte array in constant time each."""

    def __init__(self, data: np.ndarray):
        power, self._inverse = _power_tables(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=self._sums[1:])

    def span(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._inverse[starts])


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return h ^ (h >> np.uint64(29))


def in_remainder(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves `remainder`; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int) -> DataFrame:
    """(text, y) of about `rows` labelled documents at most, chosen by a hash of the id.

    `usable` is a condition on doc_id. Of several labels for an id the greatest counts. The sample's
    ids are broadcast: `rows` bounds them.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    share = rows / max(known.count(), 1)
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(1 << 20)) < int(share * (1 << 20)))
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "y")
