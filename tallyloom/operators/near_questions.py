"""Questions whose stems are nearly equal: an exact set-similarity join over character grams of the normalized stem.

Equal stems are one class, so copies cost one set. Two sets of n and m grams at a Jaccard similarity of t or more differ in at most
(1 - t) / (1 + t) * (n + m) grams. A sketch of a set has a bit for each remainder of the grams' hashes: whether an odd number of its
grams have it. Every gram in which two sets differ changes one bit, so sketches that differ in more bits than the sets may are those of a pair that
is not similar: no pair is lost, whatever the hash. Common grams, which long texts of one language share, cancel out and bring no pairs together.

Sets are in the order of size and cut into tiles of bounded bytes; the tiles whose sizes allow the similarity pass by a tile in a few groups, in which
sketches are compared by matrix products, folded to fewer bits first. Only pairs (not grams) leave it; the texts of the pairs that are left then meet in small groups, each text once in a group,
and their whole sets are compared. All pairs of similar sizes are looked at, so the time grows with the square of the classes, with bits as
the sets grow; memory is that of a tile and a batch, and the disk that of the sketches times the tiles that a tile meets.

Null and blank stems are one class without links; a stem shorter than a gram is its own gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import char_grams, norm_audit
from tallyloom.operators.ordering import ranked
from tallyloom.operators.quality import keyed
from tallyloom.sources.shared import checked_broadcast, materialize

#: Bits of the shortest sketch.
LEAST_BITS = 512
#: Rows that a tile is put together from at once, bytes of sketches of a tile at most, and the tiles that small tables are cut into.
LEAST_TILE, TILE_BYTES, TILES = 256, 64 << 20, 24
#: Tiles that pass by a tile in one group.
STREAM = 4
#: Bytes of a row beside its sketch.
ROW_BYTES = 64
#: Tasks that compare tiles, at most.
TASKS = 384
#: Consecutive places whose texts meet in one group.
BLOCK = 64
#: Signs of a matrix that is multiplied at once.
SIGNS = 1 << 22
_SIGNS_OF = 1 - 2 * np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32)


def gram_set(stem: Column, q: int) -> Column:
    """Distinct runs of `q` characters of a normalized stem."""
    return char_grams(norm_audit(stem), q)


def classes(questions: DataFrame) -> DataFrame:
    """(id, class_id): the least id with the same normalized stem."""
    rows = keyed(questions).select("id", "key")
    return rows.join(rows.groupBy("key").agg(F.min("id").alias("class_id")), "key").select("id", "class_id")


def coded(sets: DataFrame) -> DataFrame:
    """(class_id, size, codes): the number of grams of every set, and their hashes."""
    return sets.select("class_id", F.size("grams").alias("size"), F.transform("grams", lambda g: F.xxhash64(g)).alias("codes"))


def power(n: float) -> int:
    """The least power of two from LEAST_BITS that is `n` or more."""
    return max(LEAST_BITS, 1 << int(np.ceil(n) - 1).bit_length())


def sketches(sets: DataFrame, percent: int) -> DataFrame:
    """(class_id, size, bits) of `coded` sets; a sketch has nearly three times the bits that a similar set may differ in."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, at = batch["codes"].flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(batch["codes"].value_lengths().to_numpy(zero_copy_only=False))])
            bits = []
            for k, n in enumerate(batch["size"].to_pylist()):
                width = power(2.8 * n * (100 - percent) / percent)
                odd = np.bincount(codes[at[k] : at[k + 1]] & (width - 1), minlength=width) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).tobytes())
            yield pa.RecordBatch.from_arrays([batch["class_id"], batch["size"], pa.array(bits, pa.binary())], ["class_id", "size", "bits"])

    return sets.mapInArrow(made, f"class_id {sets.schema['class_id'].dataType.simpleString()}, size int, bits binary")


def placed_sketches(sets: DataFrame, percent: int) -> DataFrame:
    """`sketches` with `place`, from 1 in the order of size and id."""
    made = materialize(sketches(sets, percent), "sketches")  # a sort by ranges reads its rows twice
    return materialize(ranked(made, [F.asc("size"), F.asc("class_id")], name="place"), "placed")


def folded(rows: np.ndarray, width: int) -> np.ndarray:
    """Sketches (rows of bytes) of `width` bits: bits with the same remainder are added."""
    return np.bitwise_xor.reduce(rows.reshape(len(rows), -1, width // 8), axis=1)


def signs(rows: np.ndarray, odd: np.ndarray, last: bool) -> np.ndarray:
    """1 and -1 for the bits; two columns before them add the bounds of both rows to the product."""
    out = np.ones((len(rows), rows.shape[1] * 8 + 2), np.float32)
    out[:, 2:] = _SIGNS_OF[rows].reshape(len(rows), -1)
    out[:, 1 if last else 0] = odd
    return out


def enough(differ: float) -> int:
    """Bits, a multiple of 8, in which sketches that have nothing in common nearly always differ in more than `differ`: fewer bits never differ in more than all."""
    return 8 * int(np.ceil((2.25 * differ + 6.6 * differ**0.5) / 8))


def met(percent: int, left: tuple, right: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs (place of the left one first) of two tiles (places, sizes, sketches by width) whose sketches and sizes allow the similarity."""
    for lp, ls, lb in left:
        for rp, rs, rb in right:
            width = min(lb.shape[1], rb.shape[1]) * 8
            x, y = folded(lb, width), folded(rb, width)
            k, wider = 0, 1.0
            while k < len(lp):
                most = rs[min(np.searchsorted(rs, ls[k] * 100 // percent, "right"), len(rs)) - 1]
                short = min(width, power(2.3 * wider * (100 - percent) * (int(ls[k]) + int(most)) / (100 + percent)))
                step = max(1, min(1024, SIGNS // short))
                here = slice(k, k + step)
                k += step
                begin, end = np.searchsorted(rp, lp[here][0] + 1), np.searchsorted(rs, ls[here][-1] * 100 // percent, "right")
                bound = lambda s: -(-(100 - percent) * s.astype(np.int64) // (100 + percent))  # noqa: E731  of the bits that one side may bring
                a = signs(folded(x[here], short), 2 * bound(ls[here]), False)
                for j in range(begin, end, step):
                    there = slice(j, min(j + step, end))
                    bits = min(short, enough(wider * (100 - percent) * (int(ls[here][-1]) + int(rs[there][-1])) / (100 + percent)))
                    b = signs(folded(y[there], short)[:, : bits // 8], 2 * bound(rs[there]), True)
                    u, v = np.nonzero(a[:, : bits + 2] @ b.T >= bits)
                    n, m = ls[here][u].astype(np.int64), rs[there][v].astype(np.int64)
                    # texts of one language share grams and differ less; more bits tell them apart for less than comparing whole sketches
                    wider = min(4.0, wider * 1.2) if len(u) * 50 > a.shape[0] * b.shape[0] else wider
                    near = (n * 100 >= m * percent) & (lp[here][u] < rp[there][v])
                    u, v, n, m = u[near], v[near], n[near], m[near]
                    for c in range(0, len(u), step):
                        differ = np.bitwise_count(x[here][u[c : c + step]] ^ y[there][v[c : c + step]]).sum(axis=1, dtype=np.int64)
                        kept = differ * (100 + percent) <= (100 - percent) * (n[c : c + step] + m[c : c + step])
                        yield lp[here][u[c : c + step][kept]], rp[there][v[c : c + step][kept]]


def tile(rows: pa.Table) -> list[tuple]:
    """(places, sizes, sketches) in the order of places, for each width."""
    rows = rows.sort_by("place")
    place, size = rows["place"].to_numpy(), rows["size"].to_numpy()
    bits = pa.concat_arrays([pa.array([], pa.binary()), *rows["bits"].cast(pa.binary()).chunks])
    ends = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits) + 1] if len(bits) else np.zeros(1, np.int32)
    data, length = np.frombuffer(bits.buffers()[2] or b"", np.uint8), np.diff(ends)
    at = [0, *(np.flatnonzero(np.diff(length)) + 1).tolist(), len(bits)]
    return [(place[i:j], size[i:j], data[ends[i] : ends[j]].reshape(j - i, -1)) for i, j in zip(at, at[1:], strict=False)]


def place_pairs(placed: DataFrame, percent: int) -> DataFrame:
    """(a_place, b_place) of the pairs of `placed_sketches` that sizes and sketches let through, once each."""
    rows = F.floor((F.col("place") - 1) / LEAST_TILE)
    parts = materialize(placed.groupBy(rows.alias("part")).agg(F.min("size").alias("least"), F.max("size").alias("most"), F.sum(F.length("bits") + ROW_BYTES).alias("bytes")), "tile_parts")
    n, total = parts.agg(F.count("*"), F.sum("bytes")).first()
    before = F.sum("bytes").over(Window.orderBy("part")) - F.col("bytes")  # a row for each 256 sketches
    parts = materialize(parts.withColumn("tile", F.floor(before / max(1, min(TILE_BYTES, -(-(total or 0) // min(TILES, n or 1)))))), "tiles")
    placed = placed.withColumn("part", rows).join(checked_broadcast(parts.select("part", "tile")), "part").drop("part")
    sizes = materialize(parts.groupBy("tile").agg(F.min("least").alias("least"), F.max("most").alias("most")), "tile_sizes")
    side = lambda s: sizes.select(F.col("tile").alias(s), F.col("least").alias(f"least_{s}"), F.col("most").alias(f"most_{s}"))
    pairs = side("i").join(side("j"), F.expr(f"i <= j AND CAST(most_i AS BIGINT) * 100 >= CAST(least_j AS BIGINT) * {percent}"))
    pairs = materialize(pairs.select("i", "j", F.floor((F.col("j") - F.col("i")) / STREAM).alias("h")), "tile_pairs")
    groups = pairs.select("i", "h").distinct()
    sent = lambda ways, own, second: placed.join(checked_broadcast(ways), F.col("tile") == F.col(own)).select("i", "h", F.lit(second).alias("second"), "place", "size", "bits")
    both = sent(groups, "i", False).unionAll(sent(pairs.where("i <> j"), "j", True)).repartition(max(1, min(TASKS, groups.count())), "i", "h")

    def compared(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def against(right: list[tuple]) -> Iterator[pa.RecordBatch]:
            for a, b in met(percent, left, right):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a_place", "b_place"])

        held, left = [], None
        for batch in chain(batches, [None]):
            rows = None if batch is None else pa.Table.from_batches([batch])
            second = None if batch is None else rows["second"].to_numpy()
            if left is None:
                if rows is not None:
                    held.append(rows.filter(pa.array(~second)))
                if rows is None or second.any():
                    left = tile(pa.concat_tables(held))
                    held.clear()
                    if key[1].as_py() == 0:
                        yield from against(left)
            elif rows is not None and not second.all():
                raise RuntimeError("rows of the tile after those that it meets")
            if rows is not None and second.any():
                yield from against(tile(rows.filter(pa.array(second))))

    # the tile comes first and is held; those that it meets pass by
    return both.sortWithinPartitions("i", "h", "second", "place").groupBy("i", "h").applyInArrow(compared, "a_place long, b_place long")


def candidates(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of classes of `coded` sets that the filters let through, once each; a has the smaller set, or the smaller id of equal ones."""
    placed = placed_sketches(sets, percent)
    name = lambda s: placed.select(F.col("class_id").alias(s), F.col("place").alias(f"{s}_place"))
    return place_pairs(placed, percent).join(name("a"), "a_place").join(name("b"), "b_place").select("a", "b")


def counted(pairs: DataFrame, placed: DataFrame, stems: DataFrame, percent: int, q: int) -> DataFrame:
    """(a, b, shared, united) of the pairs of places whose gram sets are similar; `stems`(class_id, norm) of `placed` classes. A text meets a block of others once."""
    block = lambda c: F.floor((F.col(c) - 1) / BLOCK)
    keyed_pairs = pairs.withColumn("i", block("a_place")).withColumn("j", block("b_place"))
    ends = keyed_pairs.select(F.col("i").alias("_i"), F.col("j").alias("_j"), F.explode(F.array("a_place", "b_place")).alias("place")).distinct()
    ends = ends.join(placed.select("place", "class_id"), "place").join(stems, "class_id")  # texts last, so that they are shuffled to one join only
    kind = stems.schema["class_id"].dataType.simpleString()

    def compared(pairs: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        number: dict[str, int] = {}
        sets = {}
        for place, norm in zip(rows.place.tolist(), rows.norm, strict=True):
            grams = {norm[k : k + q] for k in range(max(1, len(norm) - q + 1))}
            sets[place] = np.fromiter((number.setdefault(g, len(number)) for g in grams), np.int64, len(grams))
        named, out, last = dict(zip(rows.place.tolist(), rows.class_id, strict=True)), [], None
        held = np.zeros(len(number), bool)
        for a, b in sorted(zip(pairs.a_place.tolist(), pairs.b_place.tolist(), strict=True)):
            if a != last:
                held[:] = False
                held[sets[a]] = True
                last = a
            shared = int(held[sets[b]].sum())
            united = len(sets[a]) + len(sets[b]) - shared
            if shared * 100 >= united * percent:
                out.append((named[a], named[b], shared, united))
        return pd.DataFrame(out, columns=["a", "b", "shared", "united"])

    return keyed_pairs.groupBy("i", "j").cogroup(ends.groupBy("_i", "_j")).applyInPandas(compared, f"a {kind}, b {kind}, shared int, united int")


def similar_classes(questions: DataFrame, percent: int = 80, q: int = 2) -> DataFrame:
    """(a, b, shared, united): pairs of classes whose gram sets have a Jaccard similarity of `percent` hundredths or more."""
    if not 0 < percent <= 100:
        raise ValueError("a similarity in hundredths, over 0")
    spark = questions.sparkSession
    norms = questions.select("id", norm_audit(F.col("stem")).alias("norm")).where("norm <> ''").withColumn("key", F.md5("norm"))
    # texts are shuffled once, to so many parts that grams, far more work than bytes, are made by all cores
    spread = norms.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "key")
    stems = materialize(spread.groupBy("key").agg(F.min("id").alias("class_id"), F.min("norm").alias("norm")).select("class_id", "norm"), "stems")
    placed = placed_sketches(coded(stems.select("class_id", char_grams(F.col("norm"), q).alias("grams"))), percent)
    pairs = materialize(place_pairs(placed, percent), "pairs")
    return counted(pairs, placed, stems, percent, q)


def near_questions(questions: DataFrame, percent: int = 80, q: int = 2) -> DataFrame:
    """(id, class_id, links): for every question its class of equal stems and the number of other classes nearly equal to it."""
    pairs = materialize(similar_classes(questions, percent, q), "similar")
    ends = pairs.select(F.col("a").alias("_class")).unionAll(pairs.select("b"))
    links = ends.groupBy("_class").agg(F.count("*").alias("links"))
    named = classes(questions)
    return named.join(links, F.col("class_id") == F.col("_class"), "left").select("id", "class_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
