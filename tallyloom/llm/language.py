"""Language identification of web pages by Bayesian evidence fusion.

posterior(l) ~ host prior(l) * P(text | l) * P(declared language | l) * P(address suffix | l) * P(path code | l)

* Text: multinomials over hashed byte trigrams, one for each language of the training documents,
  counted over all of them. Neighbouring trigrams depend on each other, so a text counts as at most
  `EVIDENCE` independent ones.
* Declared language (the `lang` attribute of <html>), address suffix (last label of the host) and path
  code (a first path step of two letters) have tables P(value | l) from soft counts: every page adds
  its text-only posterior.
* Host prior: soft counts of the host, smoothed towards those of its domain (last two labels), which
  are smoothed towards those of all pages; the page's own share is taken out, so no page votes for
  itself.

Soft counts are grouped aggregates that fold before the shuffle, so one host with a third of all
pages is no large group; host tables are broadcast only within a counted bound.

Edge cases: null or empty html gives no text evidence; a missing declaration, suffix or code is a value of
its own; a null or malformed url has the empty host, domain and suffix, shared by all such pages; equal
posteriors go to the language first in the alphabet; repeated rows are pages of their own; without
training documents every page gets a null language; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import checked_broadcast, materialize, small_batches

BITS = 15
EVIDENCE = 60.0
STRENGTH = 10.0  # pseudo-pages that a host takes from its domain, and a domain from all pages
SMOOTHING = 0.5
_OPEN = re.compile(r"(?i)<(?:(script|style)\b|(!--))?")
_CLOSE = {kind: re.compile(pattern) for kind, pattern in (("script", r"(?i)</script\s*>"), ("style", r"(?i)</style\s*>"), ("!--", "-->"), ("", ">"))}
_HTML = re.compile(r"(?i)<html\b")
_LANG = re.compile(r"(?i)\blang\s*=\s*[\"']?([a-z]{2,3})")


def unmarked(page: str) -> str:
    """`page` with a space for every script, style, comment and mark; one that is not closed counts as a plain mark.

    One scan forward: once a kind of close is not found, it is not looked for again, so time grows with the page.
    """
    out, at, lost = [], 0, set()

    def close(kind: str, start: int) -> int:
        if kind in lost:
            return -1
        found = _CLOSE[kind].search(page, start)
        if not found:
            lost.add(kind)
            return -1
        return found.end()

    begin = _OPEN.search(page)
    while begin:
        kind = (begin[1] or begin[2] or "").lower()
        end = close(kind, begin.end())
        if end < 0 and kind:
            end = close("", begin.start() + 1)
        if end < 0 and "" in lost and lost >= set(_CLOSE):
            break
        if end < 0:
            begin = _OPEN.search(page, begin.end())
            continue
        out += [page[at : begin.start()], " "]
        at = end
        begin = _OPEN.search(page, end)
    return "".join([*out, page[at:]])


def visible(page: str | None) -> str:
    """Text of a page without marks, scripts and styles, with single spaces."""
    return " ".join(html.unescape(unmarked(page or "")).split())


def declared_language(page: str | None) -> str:
    """The `lang` attribute of the first <html> that has one, in lower case; empty without one."""
    at, page = 0, page or ""
    while found := _HTML.search(page, at):
        at = page.find(">", found.end())
        at = len(page) if at < 0 else at
        # another <html> before the next `>` lies within this region
        if lang := _LANG.search(page, found.end(), at):
            return lang[1].lower()
    return ""


def trigrams(text: str | None) -> np.ndarray:
    """Counts of the hashed byte trigrams of a lower-cased text."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(1 << BITS, dtype=np.int64)
    packed = data[:-2] | (data[1:-1] << np.uint32(8)) | (data[2:] << np.uint32(16))
    return np.bincount((packed * np.uint32(2654435761)) >> np.uint32(32 - BITS), minlength=1 << BITS)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in small_batches(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            found = trigrams(text.as_py())
            totals[lang] = totals[lang] + found if lang in totals else found
    for lang, counts in totals.items():
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], ["lang", "b", "n"])


def fit_text(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log trigram probabilities, from all rows of `docs`(lang, text); the size is fixed by language."""
    counts = docs.where(F.col("lang").isNotNull()).select("lang", "text").mapInArrow(_counted, "lang string, b long, n long").groupBy("lang", "b").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counts.column("lang").to_pylist()))
    table = np.full((len(names), 1 << BITS), SMOOTHING)
    at = np.searchsorted(np.array(names), counts.column("lang").to_numpy(zero_copy_only=False).astype(str)) if names else []
    if names:
        table[at, counts.column("b").to_numpy()] += counts.column("n").to_numpy()
    return names, np.log(table / table.sum(axis=1, keepdims=True))


def text_evidence(page: str | None, logs: np.ndarray) -> list[float]:
    """Log-likelihood of each language, of at most EVIDENCE trigrams."""
    counts = trigrams(visible(page))
    n = int(counts.sum())
    used = np.flatnonzero(counts)
    return (logs[:, used] @ counts[used] * (min(1.0, EVIDENCE / n) if n else 0.0)).tolist()


def _log_sum(values: Column) -> Column:
    top = F.array_max(values)
    return top + F.log(F.aggregate(F.transform(values, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x))


def normalized(values: Column) -> Column:
    """Probabilities from logs."""
    total = _log_sum(values)
    return F.transform(values, lambda x: F.exp(x - total))


def evidence(pages: DataFrame, logs: np.ndarray) -> DataFrame:
    """(page_id, host, domain, suffix, code, declared, text, soft) of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(logs)  # of fixed size by language

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            bodies = batch.column("html").to_pylist()
            found = [text_evidence(h, shared.value) for h in bodies]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array([declared_language(h) for h in bodies], pa.string()), pa.array(found, pa.list_(pa.float64()))], ["page_id", "url", "declared", "text"])

    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), "html").mapInArrow(scored, "page_id long, url string, declared string, text array<double>")
    host = F.lower(F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    code = F.lower(F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([a-zA-Z]{2})(?:[/?#]|$)", 1))
    named = read.withColumn("host", host).withColumn("code", code)
    return named.select("page_id", "host", F.substring_index("host", ".", -2).alias("domain"), F.substring_index("host", ".", -1).alias("suffix"), "code", "declared", "text", normalized(F.col("text")).alias("soft"))


def _soft_counts(seen: DataFrame, languages: int, *keys: str) -> DataFrame:
    """`keys` and `mass`: the sum of `soft` over the rows of each key."""
    sums = seen.groupBy(*keys).agg(*[F.sum(F.get("soft", i)).alias(f"m{i}") for i in range(languages)])
    return sums.select(*keys, F.array(*[f"m{i}" for i in range(languages)]).alias("mass"))


def _log_ratio(mass: Column, whole: Column, extra: float) -> Column:
    return F.zip_with(mass, whole, lambda m, t: F.log((m + SMOOTHING) / (t + extra)))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, language, confidence, text_language, declared) of every page."""
    names, logs = fit_text(docs)
    if not names:
        return pages.select(F.col("page_id").cast("long").alias("page_id"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_language"), F.lit(None).cast("string").alias("declared"))
    seen = materialize(evidence(pages, logs), "evidence")
    k = len(names)
    joined = seen
    everything = seen.agg(*[F.coalesce(F.sum(F.get("soft", i)), F.lit(0.0)).alias(f"m{i}") for i in range(k)]).first()
    whole = F.array(*[F.lit(float(x)) for x in everything])
    log_likelihoods = []
    for field in ("declared", "suffix", "code"):
        counts = checked_broadcast(materialize(_soft_counts(seen, k, field), field)).withColumnsRenamed({field: f"{field}_key", "mass": f"{field}_mass"})
        values = SMOOTHING * counts.count()
        joined = joined.join(counts, F.col(field) == F.col(f"{field}_key"))
        log_likelihoods.append(_log_ratio(F.col(f"{field}_mass"), whole, values))
    hosts = checked_broadcast(materialize(_soft_counts(seen, k, "host"), "hosts")).withColumnsRenamed({"host": "host_key", "mass": "host_mass"})
    domains = checked_broadcast(materialize(_soft_counts(seen, k, "domain"), "domains")).withColumnsRenamed({"domain": "domain_key", "mass": "domain_mass"})
    joined = joined.join(hosts, F.col("host") == F.col("host_key")).join(domains, F.col("domain") == F.col("domain_key"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    others = lambda mass: F.zip_with(mass, "soft", lambda m, s: F.greatest(m - s, F.lit(0.0)))
    smoothed = lambda mass, base: F.zip_with(mass, base, lambda m, b: (m + STRENGTH * b) / (total(mass) + STRENGTH))
    joined = joined.withColumn("base", F.transform(others(whole), lambda m: (m + 1.0) / (total(others(whole)) + k)))
    joined = joined.withColumn("domain_prior", smoothed(others(F.col("domain_mass")), F.col("base")))
    joined = joined.withColumn("prior", smoothed(others(F.col("host_mass")), F.col("domain_prior")))
    logs_of = F.zip_with(F.col("text"), "prior", lambda t, p: t + F.log(p))
    for likelihood in log_likelihoods:
        logs_of = F.zip_with(logs_of, likelihood, lambda a, b: a + b)
    joined = joined.withColumn("posterior", normalized(logs_of))
    name = lambda p: F.get(F.array(*[F.lit(n) for n in names]), (F.array_position(p, F.array_max(p)) - 1).cast("int"))
    return joined.select("page_id", name(F.col("posterior")).alias("language"), F.round(F.array_max("posterior"), 6).alias("confidence"), name(F.col("soft")).alias("text_language"), "declared")
