"""Wrong answers that look right: the first free alteration of a word, as column expressions. Rules and tables are the caller's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = "array<string>"


def first_free(candidates: Column, word: Column, taken: Column, least: int = 1) -> Column:
    """The first candidate of `least` characters or more that is neither the word nor in `taken` (array); null if there is none."""
    return F.get(F.filter(candidates, lambda c: c.isNotNull() & (c != word) & ~F.array_contains(taken, c) & (F.length(c) >= least)), F.lit(0))


def rewritten(word: Column, rules: list[tuple[str, str]]) -> Column:
    """For each rule (pattern, replacement), in order: the word with every match replaced, null where nothing matches."""
    table = F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(t).alias("target")) for p, t in rules]) if rules else F.array().cast("array<struct<pattern:string,target:string>>")
    return F.transform(table, lambda r: F.when(F.regexp_like(word, r["pattern"]), F.regexp_replace(word, r["pattern"], r["target"])))


def altered_reading(word: Column, taken: Column, rules: list[tuple[str, str]], least: int = 1, mark: str = "ー") -> Column:
    """A reading near `word` that is not taken: by the first rule that gives one, else the word with `mark` after it."""
    return F.coalesce(first_free(rewritten(word, rules), word, taken, least), F.concat(word, F.lit(mark)))


def lookalike(word: Column, taken: Column, table: dict[str, list[str]], common: list[str]) -> Column:
    """`word` with one Chinese character replaced: by the look-alikes of the table in place order, then by common signs; null without one."""
    signs = F.split(word, "")
    at = lambda i, sign: F.concat(F.substring(word, F.lit(1), i), sign, F.substring(word, i + 2, F.length(word)))
    known = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))]) if table else F.create_map().cast("map<string,array<string>>")
    every = lambda of: F.flatten(F.transform(signs, lambda c, i: F.when(c.rlike("^[一-鿿]$"), F.transform(of(c), lambda s: at(i, s))).otherwise(F.array().cast(NONE))))
    near = every(lambda c: F.coalesce(F.try_element_at(known, c), F.array().cast(NONE)))
    return first_free(F.concat(near, every(lambda c: F.array(*[F.lit(s) for s in common]).cast(NONE))), word, taken)
