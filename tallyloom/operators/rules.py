"""Many tagging rules at once: a table of patterns, keyed by text that every match must hold.

A pattern that matches a few fixed texts only (`spelled`) is these texts: all such rules are found in one pass over a text, where its
first characters tell which of them can start at a place, and the text is not moved. For the others follow literals of which each match
holds one (`needed`). Their first characters are the keys of an equi-join with the grams of the texts, so a text meets only the rules
whose key it has, whatever their number; `rlike` decides on these. Texts are not carried through the grams: ids and rule numbers are,
folded before the shuffle. Rules without such a literal meet every text, one by one.

The plan has the same size for ten rules and for ten thousand.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import product
from re import _constants as codes  # the pattern's own tree; there is no public form of it
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.text import char_grams
from tallyloom.sources.shared import checked_broadcast, materialize

#: Characters of a key at most, and keys of a rule; a rule that needs more keys meets every text.
KEY = 6
KEYS = 64
#: Code points of texts that are looked through at once.
STRETCH = 1 << 20
#: Bits of the table that tells which runs of characters start no fixed text.
SIEVE = 20
#: Patterns that Python and Java read alike: characters, groups, alternatives and plain classes.
_PLAIN = re.compile(r"(?:[^\\\[\]{}()^$.*+?|]|\((?:\?:)?|\)|\||\[[^\\\[\]^&-]+\])*")


def _best(options: list[list[str]]) -> list[str] | None:
    """Of sets of literals of which each match holds one of every set: that with the longest shortest literal."""
    return max(options, key=lambda o: (min(map(len, o)), -len(o)), default=None)


def _needed(items: list) -> list[str] | None:
    options, run = [], ""
    for code, value in [*items, (None, None)]:
        if code is codes.LITERAL:
            run += chr(value)
            continue
        if run:
            options.append([run])
            run = ""
        found = None
        if code is codes.BRANCH:
            parts = [_needed(list(part)) for part in value[1]]
            found = [x for p in parts for x in p] if all(parts) else None
        elif code is codes.SUBPATTERN:
            found = None if value[1] or value[2] else _needed(list(value[3]))
        elif code in (codes.MAX_REPEAT, codes.MIN_REPEAT) and value[0] >= 1:
            found = _needed(list(value[2]))
        elif code is codes.IN and all(c is codes.LITERAL for c, _ in value):
            found = [chr(v) for _, v in value]
        if found:
            options.append(found)
    return _best(options)


def needed(pattern: str) -> list[str] | None:
    """Lower-case literals of which the lower-cased text of every match holds one; None if there are none or the pattern is not understood."""
    try:
        tree = parser.parse(pattern)
    except (re.error, OverflowError):
        return None
    if tree.state.flags & re.VERBOSE:
        return None
    found = _needed(list(tree))
    return sorted({x.lower() for x in found}) if found and len(found) <= KEYS else None


def _spelled(items: list) -> list[str] | None:
    out = [""]
    for code, value in items:
        if code is codes.LITERAL:
            found = [chr(value)]
        elif code is codes.IN and all(c is codes.LITERAL for c, _ in value):
            found = [chr(v) for _, v in value]
        elif code is codes.BRANCH:
            parts = [_spelled(list(part)) for part in value[1]]
            found = [x for p in parts for x in p] if all(parts) else None
        elif code is codes.SUBPATTERN and not value[1] and not value[2]:
            found = _spelled(list(value[3]))
        else:
            found = None
        if not found or len(out) * len(found) > KEYS:
            return None
        out = [a + b for a, b in product(out, found)]
    return out


def spelled(pattern: str) -> tuple[bool, list[str]] | None:
    """(whether the case of a-z counts, all texts that the pattern matches), in lower case if it does not; None if they are many or one is empty."""
    body = pattern.removeprefix("(?i)")
    if not _PLAIN.fullmatch(body):
        return None
    try:
        found = _spelled(list(parser.parse(body)))
    except (re.error, OverflowError):
        return None
    if not found or "" in found:
        return None
    cased = body == pattern
    return cased, sorted({x if cased else "".join(c.lower() if c.isascii() else c for c in x) for x in found})


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class _Finder:
    """Finds fixed texts (text, rule) in code points: a sieve of hashed starts, then the starts, then whole texts."""

    def __init__(self, said: list[tuple[str, int]]):
        self.longest = max(len(x) for x, _ in said)
        self.groups = []
        for size in sorted({min(len(x), KEY) for x, _ in said}):
            own = [(_code_points(x), rule) for x, rule in said if min(len(x), KEY) == size]
            starts = np.array([self._hashes(x[:size], size)[0] for x, _ in own], np.uint64)
            order = np.argsort(starts, kind="stable")
            points = np.zeros((len(own), self.longest), np.uint32)
            for k, at in enumerate(order):
                points[k, : len(own[at][0])] = own[at][0]
            lengths, rules = np.array([len(own[at][0]) for at in order]), np.array([own[at][1] for at in order])
            sieve = np.zeros(1 << SIEVE, bool)
            sieve[(starts >> np.uint64(64 - SIEVE)).astype(np.int64)] = True
            self.groups.append((size, starts[order], points, lengths, rules, sieve))

    @staticmethod
    def _hashes(points: np.ndarray, size: int) -> np.ndarray:
        n = max(len(points) - size + 1, 0)
        out = np.zeros(n, np.uint64)
        for j in range(size):
            out = (out + points[j : n + j]) * np.uint64(0x9E3779B97F4A7C15)
        return out

    def __call__(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, rules) of all fixed texts in `points`."""
        places, found = [], []
        for size, starts, own, lengths, rules, sieve in self.groups:
            hashes = self._hashes(points, size)
            at = np.flatnonzero(sieve[(hashes >> np.uint64(64 - SIEVE)).astype(np.int64)])
            first, last = np.searchsorted(starts, hashes[at], "left"), np.searchsorted(starts, hashes[at], "right")
            n = last - first
            at, which = np.repeat(at, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            for j in range(self.longest):
                ends = lengths[which] <= j
                same = ends | (points[np.minimum(at + j, len(points) - 1)] == own[which, j])
                same &= ends | (at + j < len(points))
                at, which = at[same], which[same]
            places.append(at)
            found.append(rules[which])
        return np.concatenate(places), np.concatenate(found)


def _stretches(texts: list[str | None], overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code points, number of the text at each), about STRETCH at a time; a sign that is no character lies between texts, long texts are cut with an overlap."""
    points, owners, held = [], [], 0
    for k, text in enumerate(texts):
        whole = _code_points(text or "")
        for start in range(0, len(whole), STRETCH):
            part = whole[start : start + STRETCH + overlap]
            points += [part, np.full(1, 0xFFFFFFFF, np.uint32)]
            owners.append(np.full(len(part) + 1, k, np.int32))
            held += len(part)
            if held >= STRETCH:
                yield np.concatenate(points), np.concatenate(owners)
                points, owners, held = [], [], 0
    if points:
        yield np.concatenate(points), np.concatenate(owners)


def _tagger(rules: list[tuple[str, int, bool]], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds `found`, the rules (rule, name) whose fixed texts (text, rule, cased) are in each text, in the order of the rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [(cased, _Finder(own)) for cased in (True, False) if (own := [(x, k) for x, k, c in rules if c is cased])]
        overlap, width, listed = max(f.longest for _, f in finders) - 1, len(names), pa.array(names, pa.string())
        for batch in batches:
            hits = [np.zeros(0, np.int64)]
            for points, owners in _stretches(batch.column("said").to_pylist(), overlap):
                for cased, find in finders:
                    at, rule = find(points if cased else np.where((points >= 65) & (points <= 90), points + np.uint32(32), points))
                    hits.append(np.unique(owners[at].astype(np.int64) * width + rule))
            pairs = np.unique(np.concatenate(hits))
            rule = pa.array((pairs % width).astype(np.int32))
            ends = np.searchsorted(pairs, np.arange(batch.num_rows + 1, dtype=np.int64) * width).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([rule, listed.take(rule)], ["rule", "name"]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), found], ["id", "found"])

    return run


def rule_keys(spark: SparkSession, rules: list[tuple[int, str, str]]) -> tuple[DataFrame, DataFrame, list[int]]:
    """(rule, name, pattern), (key, rule), and the lengths of the keys; rules without a key have none in the second table."""
    table = spark.createDataFrame(rules, "rule int, name string, pattern string")
    keys = {(x[:KEY], k) for k, _, p in rules for x in needed(p) or []}
    return table, spark.createDataFrame(sorted(keys), "key string, rule int"), sorted({len(x) for x, _ in keys})


def tag_texts(texts: DataFrame, rules: list[tuple[str, str]], id_column: str = "id", text_column: str = "text") -> DataFrame:
    """(id, tags): the distinct names of the rules (name, pattern) that occur in each text, in the order of the rules.

    Ids must be unique. Null texts have no tags. Same as `functions.text.match_tags`, for any number of rules.
    """
    spark = texts.sparkSession
    docs = texts.select(F.col(id_column).alias("id"), F.col(text_column).alias("said"))
    fixed = {k: found for k, (_, p) in enumerate(rules) if (found := spelled(p))}
    loose = [(k, n, p) for k, (n, p) in enumerate(rules) if k not in fixed]
    listed = T.ArrayType(T.StructType([T.StructField("rule", T.IntegerType()), T.StructField("name", T.StringType())]))
    if fixed:
        said = [(x, k, cased) for k, (cased, own) in fixed.items() for x in own]
        told = docs.mapInArrow(_tagger(said, [n for n, _ in rules]), T.StructType([docs.schema["id"], T.StructField("found", listed)]))
    else:
        told = docs.select("id", F.array().cast(listed).alias("found"))
    if loose:
        more = materialize(_matched(spark, docs, loose).withColumnRenamed("id", "_id"), "tags")
        told = told.join(more, F.col("id") == F.col("_id"), "left").select("id", F.array_sort(F.concat("found", F.coalesce("more", F.array().cast(listed)))).alias("found"))
    return told.select("id", F.array_distinct(F.transform("found", lambda x: x["name"])).alias("tags"))


def _matched(spark: SparkSession, docs: DataFrame, rules: list[tuple[int, str, str]]) -> DataFrame:
    """(id, more): the rules (rule, name, pattern) that occur in each text of `docs`(id, said) where any does."""
    table, keys, lengths = rule_keys(spark, rules)
    loose = [k for k, _, p in rules if not needed(p)]
    grams = F.array_distinct(F.concat(*[char_grams(F.lower("said"), n) for n in lengths])) if lengths else F.array().cast("array<string>")
    met = docs.select("id", F.explode(grams).alias("gram")).join(checked_broadcast(keys), F.col("gram") == F.col("key")).select("id", "rule").distinct()
    if loose:
        met = met.unionByName(docs.select("id", F.explode(F.array([F.lit(k) for k in loose])).alias("rule")))
    hits = met.join(checked_broadcast(table), "rule").join(docs.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id")).where(F.expr("said RLIKE pattern"))
    return hits.groupBy("id").agg(F.collect_set(F.struct("rule", "name")).alias("more"))
