"""Benchmark decontamination with spaced seeds.

Texts become lower-cased words (ASCII punctuation separates). A spaced seed hashes the words at the
kept positions of a fixed mask and ignores the others, so a seed still matches where an ignored word
was replaced. Seeds of benchmark items and of documents meet in an equi-join; around each hit the
item is laid along the document without gaps, and the longest stretch of which at least
`MIN_SIMILARITY` match is verified: a document is contaminated by an item if that stretch has
`MIN_OVERLAP` words or more (or is the whole of a shorter item).

The seeds lose nothing: however words are replaced in a stretch of 13 to 25 words, within the
similarity, some mask meets kept words only (a test tries all ways), and a longer stretch splits into
such lengths, one of which reaches the similarity. Items under `MIN_OVERLAP` words are sought by masks
of their own length, cut into blocks, that ignore every choice of as many blocks as words may be
replaced (none in items under 5 words, which must occur as they are).

Documents are scanned once, in full. A Bloom filter of the benchmark's seeds (fixed size, broadcast)
keeps the seeds that may match; only these, with the words around them, are shuffled. Words beyond a
window cannot belong to the stretch: without hits, every 13 words lose at least 2 of its sum (a match
counts 1, a replaced word -4), so it reaches at most 7 words for each word between its outermost hits, nor
does it reach farther than the longest item. A pair of a window and an item is verified on the words that
lie on each other only, so a window may be long.
Windows with the same words and items with the same words fold into one before they meet. Seeds and
items are broadcast only within a bound in bytes, else joined by shuffle.

Edge cases: null and empty texts have no words and are clean; rows that repeat a doc_id share their
findings; null ids of documents are kept as one id; repeated items count by their item_id and items
without an id or without words are not sought; an empty benchmark leaves all documents clean; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import checked_broadcast, materialize, small_batches
from tallyloom.llm.features import Prefixes, chunks, mix, runs

#: Spaced seeds, 1: kept, 0: ignored. Fixed values.
MASKS = ("1111001", "11001000011", "101111")
MIN_OVERLAP = 13
MIN_SIMILARITY = 0.8
#: Beside +1 for a match: MIN_SIMILARITY of the words match where the sum is 0 or more.
MISMATCH = -4
#: A window reaches PAD + REACH * (words from its first to its last hit) words beyond its hits, or the longest item.
PAD, REACH = 26, 7
FILTER_BITS = 27
_WORD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words of a text, in order."""
    out = []
    for part in chunks((text or "").lower().encode("utf-8", "replace").translate(_WORD)):
        data = np.frombuffer(part, dtype=np.uint8)
        out.append(Prefixes(data).span(*runs(data != 32)))
    return np.concatenate(out)


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the masked words at every position of `words`."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.full(n, int(mask, 2) + 1, dtype=np.uint64)
    for i, kept in enumerate(mask):
        if kept == "1":
            total += mix(words[i : i + n] + np.uint64(i + 1)) * np.uint64(2 * i + 3)
    return mix(total)


def item_masks(n_words: int) -> tuple[str, ...]:
    if n_words >= MIN_OVERLAP:
        return MASKS
    if not n_words:
        return ()
    replaced = n_words // 5  # at MIN_SIMILARITY
    blocks = replaced + 2
    block = [i * blocks // n_words for i in range(n_words)]
    return tuple("".join("0" if b in gone else "1" for b in block) for gone in combinations(range(blocks), replaced))


def _slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << FILTER_BITS) - 1)
    return hashes & low, (hashes >> np.uint64(FILTER_BITS)) & low


def best_stretch(same: np.ndarray) -> tuple[int, int]:
    """(length, matches) of the longest stretch of an alignment that reaches `MIN_SIMILARITY`; the first of equals."""
    sums = np.concatenate(([0], np.cumsum(np.where(same, 1, MISMATCH))))
    # sums over a stretch are 0 or more exactly if it reaches the similarity; minima only fall
    starts = np.searchsorted(-np.minimum.accumulate(sums), -sums)
    end = int(np.argmax(np.arange(len(sums)) - starts))
    start = int(starts[end])
    return end - start, int(same[start:end].sum())


def clusters(at: np.ndarray, ends: np.ndarray, n_words: int, longest: int) -> list[tuple[int, int, int, int]]:
    """(first hit, hit after the last, first word, word after the last) of windows around sorted hits, none overlapping."""
    out: list[tuple[int, int, int, int]] = []
    pad = lambda a, b: min(longest, PAD + REACH * int(ends[b - 1] - at[a]))
    for k in range(len(at)):
        a, b = k, k + 1
        while out and int(at[a]) - pad(a, b) < out[-1][3]:
            a = out.pop()[0]
        out.append((a, b, max(0, int(at[a]) - pad(a, b)), min(n_words, int(ends[b - 1]) + pad(a, b))))
    return out


def is_leak(length: int, matches: int, item_words: int) -> bool:
    return length >= min(MIN_OVERLAP, item_words) and matches >= MIN_SIMILARITY * length


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        words = [tokens(t.as_py()).view(np.int64) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(words, pa.list_(pa.int64()))], ["item_id", "item_words"])


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        ids, hashes, places = [], [], []
        for item, words in zip(batch.column("item_id").to_pylist(), batch.column("item_words"), strict=True):
            words = words.values.to_numpy().view(np.uint64)
            for mask in item_masks(len(words)):
                found = seeds(words, mask)
                hashes.append(found.view(np.int64))
                ids += [item] * len(found)
                places.append(np.arange(len(found)))
        join = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(join(hashes), pa.int64()), pa.array(join(places), pa.int32())], ["item_id", "seed", "item_at"])


def _filter(item_seeds: DataFrame) -> np.ndarray:
    """Bloom filter of the seeds, two bits each; at most 2**FILTER_BITS bits reach the driver."""
    hashed = F.col("seed")
    low = F.lit((1 << FILTER_BITS) - 1)
    slots = item_seeds.select(F.explode(F.array(hashed.bitwiseAND(low), F.shiftrightunsigned(hashed, FILTER_BITS).bitwiseAND(low))).alias("s"))
    # eight slots to a row, so what reaches the driver is bounded by the filter, not by the benchmark
    packed = slots.select(F.shiftright("s", 3).alias("byte"), F.pow(F.lit(2), F.col("s") % 8).cast("int").alias("bit")).groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    bits[packed.column("byte").to_numpy()] = packed.column("bits").to_numpy().astype(np.uint8)
    return bits


def hits(docs: DataFrame, bits: np.ndarray, masks: tuple[str, ...], longest: int) -> DataFrame:
    """(a, b, doc_id, words, at, seeds): stretches of words around seeds that pass the filter, named by 128 bits of their words."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # of fixed size

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        passes = lambda s: (table[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8)) & 1
        for batch in small_batches(batches):
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = tokens(text.as_py())
                at, found, ends = [], [], []
                for mask in masks:
                    hashed = seeds(words, mask)
                    one, two = _slots(hashed)
                    maybe = np.flatnonzero(passes(one))
                    maybe = maybe[passes(two[maybe]) > 0]
                    at.append(maybe)
                    found.append(hashed[maybe])
                    ends.append(maybe + len(mask))
                at, found, ends = (np.concatenate(x) for x in (at, found, ends))
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, found, ends = at[order], found[order], np.maximum.accumulate(ends[order])
                for a, b, lo, hi in clusters(at, ends, len(words), longest):
                    rows.append((doc, words[lo:hi].view(np.int64), (at[a:b] - lo).astype(np.int32), found[a:b].view(np.int64)))
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "words", "at", "seeds"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(windows, "doc_id long, words array<long>, at array<int>, seeds array<long>")
    return found.select(F.xxhash64("words").alias("a"), F.xxhash64(F.lit(1), "words").alias("b"), "doc_id", "words", "at", "seeds")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        rows, counts = [], ([], [])
        for row, (w, x, n) in enumerate(zip(*(batch.column(c) for c in ("w", "x", "n")), strict=True)):
            length, matches = best_stretch(w.values.to_numpy() == x.values.to_numpy())
            if is_leak(length, matches, n.as_py()):
                rows.append(row)
                counts[0].append(length)
                counts[1].append(matches)
        kept = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("a", "b", "item")]
        yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, pa.int64()) for c in counts]], ["a", "b", "item", "overlap", "matches"])


def _found(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Windows (doc_id, a, b), overlaps (a, b, item, overlap, matches) of their words, and names (item, item_id) of the items."""
    named = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_items, "item_id long, item_words array<long>")
    named = materialize(named.where(F.size("item_words") > 0).select(F.xxhash64("item_words").alias("item"), "item_id", "item_words").distinct(), "item-names")
    items = materialize(named.select("item", "item_words").dropDuplicates(["item"]), "items")
    item_seeds = materialize(items.select(F.col("item").alias("item_id"), "item_words").mapInArrow(_item_seeds, "item_id long, seed long, item_at int").distinct(), "item-seeds").withColumnRenamed("item_id", "item")
    longest = items.agg(F.max(F.size("item_words"))).first()[0] or 0
    lengths = [r[0] for r in items.select(F.size("item_words").alias("n")).where(F.col("n") < MIN_OVERLAP).distinct().collect()]
    masks = MASKS + tuple(m for n in sorted(lengths) for m in item_masks(n))
    windows = materialize(hits(docs, _filter(item_seeds), masks, longest), "windows")
    # the hits of a window follow from its words; any of the equal rows serves
    once = materialize(windows.drop("doc_id").dropDuplicates(["a", "b"]), "distinct-windows")
    hit = once.select("a", "b", F.explode(F.arrays_zip("at", "seeds")).alias("h")).select("a", "b", "h.at", F.col("h.seeds").alias("seed"))
    laid = hit.join(checked_broadcast(item_seeds), "seed").select("a", "b", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    pairs = laid.join(checked_broadcast(once.select("a", "b", "words")), ["a", "b"]).join(checked_broadcast(items), "item")
    # the words that lie on each other
    start, n = F.greatest("shift", F.lit(0)), F.size("item_words")
    both = F.least(F.size("words"), F.col("shift") + n) - start
    laid_out = pairs.select("a", "b", "item", F.slice("words", start + 1, both).alias("w"), F.slice("item_words", start - F.col("shift") + 1, both).alias("x"), n.alias("n"))
    found = laid_out.mapInArrow(_verified, "a long, b long, item long, overlap long, matches long")
    best = found.groupBy("a", "b", "item").agg(F.max(F.struct("overlap", "matches")).alias("best")).select("a", "b", "item", "best.*")
    return windows.select("doc_id", "a", "b"), materialize(best, "overlaps"), named.select("item", "item_id")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, overlap, matches): every document and item that overlap, with the longest stretch."""
    windows, overlaps, names = _found(docs, benchmark)
    pairs = windows.join(checked_broadcast(overlaps), ["a", "b"]).join(checked_broadcast(names), "item")
    return pairs.groupBy("doc_id", "item_id").agg(F.max(F.struct("overlap", "matches")).alias("best")).select("doc_id", "item_id", "best.overlap", "best.matches")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, items, overlap, matches) of every contaminated doc_id."""
    windows, overlaps, names = _found(docs, benchmark)
    # by window first: copies of a window do not multiply its items
    listed = overlaps.join(checked_broadcast(names), "item").groupBy("a", "b").agg(F.collect_set("item_id").alias("items"), F.max("overlap").alias("overlap"), F.max("matches").alias("matches"))
    rows = windows.join(checked_broadcast(materialize(listed, "window-items")), ["a", "b"])
    return rows.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.max("overlap").alias("overlap"), F.max("matches").alias("matches"))


def flag(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` with `items` (null if clean), `overlap` and `matches` (0 if clean); columns of these names are replaced."""
    found = checked_broadcast(materialize(contaminated(docs, benchmark), "leaks"))
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found["doc_id"]), "left")
    counts = [F.coalesce(found[c], F.lit(0)).alias(c) for c in ("overlap", "matches")]
    return joined.select(*[docs[c] for c in docs.columns if c not in found.columns or c == "doc_id"], found["items"], *counts)
