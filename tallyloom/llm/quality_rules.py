"""Quality rules: base counts of every text and a hashed n-gram log-likelihood ratio.

The ratio compares a trusted-target multinomial with the raw-corpus multinomial over hashed
token unigrams and bigrams, both smoothed alike. Counts come from all documents; the score of a document is the mean
ratio per n-gram (length-normalised) and a fixed threshold decides each document alone.
Main path: built-in expressions only. Scoring needs no shuffle; fitting shuffles one row for
each bucket and task.

Edge cases: a null text counts as empty (0 words, base_failed); texts without tokens score 0;
repeated rows are scored one by one; an empty table gives an empty result; other columns of the
input are not read. A corpus without trusted rows gives ratios from smoothing alone, so nothing
but the base rules rejects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import NOT_BLANK, let, materialize, shuffled, words

BUCKETS = 1 << 16
#: Pseudo-count of a bucket in the target; the raw multinomial gets the same share of its larger total,
#: so that an n-gram too rare to tell has a ratio near 0 at any corpus size.
SMOOTHING = 5.0
#: Mean log-likelihood ratio per n-gram under which a text is rejected.
THRESHOLD = -0.2
MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: Tokens: runs of letters and digits, or runs of other visible characters.
TOKEN = "[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\x00-\\x20]+"
SYMBOLS = "[^#*$%&|<>]+"


def neighbours(x: Column, step: int = 1) -> Column:
    """Hashes of each element with the one `step` places after it, as array<bigint>."""
    n = F.size(x) - step
    return F.when(n > 0, F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(1 + step), n), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))


def ngram_hashes(text: Column) -> Column:
    """Hashes of the token unigrams and bigrams of a text, as array<bigint>."""
    hashes = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))
    return let(hashes, lambda h: F.concat(h, neighbours(h)))


def ngram_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """Hashed token unigrams and bigrams of a text, as array<int>."""
    return F.transform(ngram_hashes(text), lambda x: F.pmod(x, F.lit(buckets)).cast("int"))


def fit_ratios(docs: DataFrame, trusted: Column, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row with `ratios`: array<double> of `buckets` log-likelihood ratios, from all rows of `docs`.

    `trusted` is a boolean column of `docs` that marks the rows of the target.
    """
    grams = docs.select(F.coalesce(trusted, F.lit(False)).cast("long").alias("t"), F.explode(ngram_buckets(F.col("text"), buckets)).alias("b"))
    counts = materialize(grams.groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("target")), "ngram-counts")
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
    filled = every.join(shuffled(counts), "b", "left").select("b", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    # one row of fixed size: `buckets` pairs, whatever the corpus
    one = filled.agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"), F.sort_array(F.collect_list(F.struct("b", "raw", "target"))).alias("c"))
    scaled = F.col("all_target") / F.col("all_raw")
    ratio = lambda x: F.log((x["target"] + smoothing) / (x["raw"] * scaled + smoothing))  # noqa: E731  the totals are equal
    return materialize(one.select(F.when(F.col("all_target") > 0, F.transform("c", ratio)).otherwise(F.transform("c", lambda x: F.lit(0.0))).alias("ratios")), "ngram-ratios")


def ratio_score(grams: Column, ratios: Column, buckets: int = BUCKETS) -> Column:
    """Mean log-likelihood ratio of n-gram hashes; 0 without n-grams."""
    return F.when(F.size(grams) > 0, F.aggregate(grams, F.lit(0.0), lambda acc, x: acc + F.get(ratios, F.pmod(x, F.lit(buckets)).cast("int"))) / F.size(grams)).otherwise(0.0)


def repeated_words(all_words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of `window` words, a power of two, that occur twice or more in the text."""

    def joined(h: Column, step: int) -> Column:
        return let(h, lambda x: neighbours(x, step))

    def windows(h: Column) -> Column:
        size = 1
        while size < window:  # a window is named by its two halves
            h, size = joined(h, size), 2 * size
        return h

    def covered(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = let(placed, lambda s: F.filter(s, lambda e, k: (F.when(k > 0, F.get(s, k - 1)["x"]) == e["x"]) | (F.get(s, k + 1)["x"] == e["x"])))
        starts = F.sort_array(F.transform(twice, lambda e: e["i"]))
        step = lambda acc, p: F.struct((p + window).alias("end"), (acc["n"] + F.least(F.lit(window), p + window - acc["end"])).cast("int").alias("n"))
        return F.aggregate(starts, F.struct(F.lit(-window).alias("end"), F.lit(0).alias("n")), step)["n"]

    hashes = F.transform(all_words, lambda w: F.xxhash64(w))
    return let(let(hashes, windows), lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0))


def base_columns(text: Column) -> dict[str, Column]:
    """The base counts of a text, without the verdict."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_BLANK))
    return {
        "counts": let(
            words(text),
            lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words")),
        ),
        "n_symbols": F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def apply_rules(docs: DataFrame, ratios: DataFrame, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",), buckets: int = BUCKETS) -> DataFrame:
    """Columns `keep`, the base counts, base_failed, llr_score and kept, for every row of `docs`; `buckets` as in the fit."""
    base = F.struct(*[c.alias(n) for n, c in base_columns(F.col("text")).items()])
    # a generated row: filters on its columns are not pushed below it, so nothing is computed twice
    row = F.struct(base.alias("m"), ngram_hashes(F.col("text")).alias("grams"))
    measured = docs.select(*keep, F.inline(F.array(row)), ratios.select("ratios").scalar().alias("ratios"))
    scored = F.struct("m", ratio_score(F.col("grams"), F.col("ratios"), buckets).alias("llr_score"))
    measured = measured.select(*keep, F.inline(F.array(scored)))
    counts = F.col("m.counts")
    failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
    return measured.select(
        *keep,
        counts["n_words"].alias("n_words"),
        counts["word_chars"].alias("word_chars"),
        F.col("m.n_symbols").alias("n_symbols"),
        F.col("m.n_dup_lines").alias("n_dup_lines"),
        counts["n_repeat_words"].alias("n_repeat_words"),
        failed.alias("base_failed"),
        "llr_score",
        (~failed & (F.col("llr_score") >= threshold)).alias("kept"),
    )
