"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its lower-cased words and the first 4 and 5 bytes of longer words, hashed to
`1 << SPACE` values. Grouped counts over the labelled sample select the hashes that tell about the
label: alone (log-likelihood ratio G of at least `LEAST_G`), or only together with another (the G of a
pair's four cells exceeds the sum of both single ones by `LEAST_PAIR_G`, over all pairs of the
`PAIR_TERMS` terms whose presence varies most). A factorization machine with linear weights and `rank`
factors for each term learns from them, so pairs of terms count beyond their single weights.
score = sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>) over the terms present in the whole text.

Fitting reads a bounded sample of labelled rows (`sample_rows`); scoring reads every text in full
and shuffles nothing. The model has a fixed size, whatever the corpus.

Edge cases: null and empty texts have no terms and score sigmoid(w0); without labels of both
classes every text scores the share of positive labels (0 without labels); repeated rows are scored
one by one; very long texts are hashed in parts; an empty table gives an empty result; other columns
are never inputs.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import materialize, small_batches
from tallyloom.llm.features import Prefixes, chunks, in_remainder, labelled_sample, runs

SPACE = 30
PREFIXES = (4, 5)
SAMPLE_ROWS = 30_000
PAIR_TERMS = 2048
#: A term's G exceeds this by chance about once in 5,000 terms, so few chance terms enter the model.
LEAST_G = 14.0
#: A pair's excess exceeds this by chance about once in 10**9 pairs; there are some two million.
LEAST_PAIR_G = 38.0
#: Steps of the fit at least: a small sample is read more often.
STEPS = 2400
RANK = 8
_WORD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_FILTER = 24  # bits of the table that finds candidate terms fast


def terms(text: str | None) -> np.ndarray:
    """Term hashes of a text as uint32, repeats included."""
    found = []
    for part in chunks((text or "").lower().encode("utf-8", "replace").translate(_WORD)):
        data = np.frombuffer(part, dtype=np.uint8)
        starts, ends = runs(data != 32)
        spans = Prefixes(data)
        found.append(spans.span(starts, ends))
        for n in PREFIXES:
            long = starts[ends - starts > n]
            found.append(spans.span(long, long + n) + np.uint64(n))
    return (np.concatenate(found) & np.uint64((1 << SPACE) - 1)).astype(np.uint32)


@dataclass
class Model:
    hashes: np.ndarray  # sorted
    w0: float
    w: np.ndarray
    v: np.ndarray

    def indices(self, text: str | None, table: np.ndarray) -> np.ndarray:
        """Positions in `hashes` of the terms present in the text."""
        found = terms(text)
        found = np.unique(found[table[found & np.uint32((1 << _FILTER) - 1)]])
        at = np.searchsorted(self.hashes, found)
        at[at == len(self.hashes)] = 0
        return at[self.hashes[at] == found] if len(self.hashes) else at[:0]

    def table(self) -> np.ndarray:
        out = np.zeros(1 << _FILTER, dtype=bool)
        out[self.hashes & np.uint32((1 << _FILTER) - 1)] = True
        return out

    def score(self, at: np.ndarray) -> float:
        v = self.v[at]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(self.w0 + self.w[at].sum() + pairs, -30, 30))))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, 2048):
        parts = [(np.unique(terms(t)), y) for t, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True)]
        of = lambda want: np.concatenate([np.empty(0, np.uint32), *[t for t, y in parts if (y > 0) == want]])
        keys, inverse = np.unique(np.concatenate((of(True), of(False))), return_inverse=True)
        positive = len(of(True))
        columns = [keys.astype(np.int64), np.bincount(inverse[:positive], minlength=len(keys)), np.bincount(inverse[positive:], minlength=len(keys))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["h", "pos", "neg"])


def term_counts(sample: DataFrame, positive: int, negative: int) -> DataFrame:
    """(h, df, g): rows of the sample with each term, and the G of its association with the label."""
    counts = sample.mapInArrow(_counts, "h long, pos long, neg long").groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos + neg >= 3")
    total = float(positive + negative)
    df = F.col("pos") + F.col("neg")
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    cells = [part(F.col(c), df * (k / total)) + part(F.lit(float(k)) - F.col(c), (total - df) * (k / total)) for c, k in (("pos", positive), ("neg", negative))]
    return counts.select("h", df.alias("df"), (2 * (cells[0] + cells[1])).alias("g"))


def _information(pos: np.ndarray, neg: np.ndarray, share: float) -> np.ndarray:
    """The part of G of cells with `pos` and `neg` rows, of which `share` would be positive by chance."""
    n = pos + neg
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * (np.where(pos > 0, pos * np.log(pos / (n * share)), 0) + np.where(neg > 0, neg * np.log(neg / (n * (1 - share))), 0))


def interacting(rows: list[np.ndarray], y: np.ndarray, n_terms: int, least: float = LEAST_PAIR_G) -> np.ndarray:
    """The terms of all pairs that tell more about the label than their terms do one by one, sorted."""
    together = [np.zeros((n_terms, n_terms), dtype=np.float32) for _ in range(2)]
    for kind in (0, 1):
        chosen = np.flatnonzero(y == kind)
        for at in range(0, len(chosen), 1024):
            block = np.zeros((min(1024, len(chosen) - at), n_terms), dtype=np.float32)
            for k, i in enumerate(chosen[at : at + 1024]):
                block[k, rows[i]] = 1
            together[kind] += block.T @ block
    total = [float((y == kind).sum()) for kind in (0, 1)]
    share = total[1] / len(y)
    single = [t.diagonal().astype(float) for t in together]
    alone = _information(single[1], single[0], share) + _information(total[1] - single[1], total[0] - single[0], share)
    found = np.zeros(n_terms, dtype=bool)
    for i in range(n_terms):
        both = [t[i].astype(float) for t in together]
        cells = [[b, single[k][i] - b, single[k] - b, total[k] - single[k][i] - single[k] + b] for k, b in enumerate(both)]
        excess = sum(_information(p, n, share) for n, p in zip(*cells, strict=True)) - alone[i] - alone
        excess[i] = 0
        if (excess >= least).any():
            found[i] = True
            found[excess >= least] = True
    return np.flatnonzero(found)


def fit_machine(rows: list[np.ndarray], y: np.ndarray, hashes: np.ndarray, rank: int = RANK, epochs: int = 12, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> Model:
    """AdaGrad over mini-batches of the sample's rows (positions in `hashes`)."""
    rng = np.random.default_rng(seed)
    base = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    w0, w, v = np.log(base / (1 - base)), np.zeros(len(hashes)), rng.normal(0, 0.01, (len(hashes), rank))
    g0, gw, gv = 1e-8, np.full(len(hashes), 1e-8), np.full((len(hashes), rank), 1e-8)
    for _ in range(max(epochs, -(-STEPS * 128 // max(len(rows), 1)))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 128):
            batch = [rows[i] for i in order[at : at + 128]]
            sizes = np.fromiter(map(len, batch), dtype=np.int64, count=len(batch))
            owner, items = np.repeat(np.arange(len(batch)), sizes), np.concatenate(batch)
            vi = v[items]
            sums = np.zeros((len(batch), rank))
            np.add.at(sums, owner, vi)
            squares = np.bincount(owner, weights=(vi**2).sum(axis=1), minlength=len(batch))
            margin = w0 + np.bincount(owner, weights=w[items], minlength=len(batch)) + 0.5 * ((sums**2).sum(axis=1) - squares)
            error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[order[at : at + 128]]
            used, where = np.unique(items, return_inverse=True)
            dw = np.bincount(where, weights=error[owner], minlength=len(used)) / len(batch) + decay * w[used]
            dv = np.zeros((len(used), rank))
            np.add.at(dv, where, error[owner, None] * (sums[owner] - vi))
            dv = dv / len(batch) + decay * v[used]
            d0 = error.mean()
            g0 += d0**2
            gw[used] += dw**2
            gv[used] += dv**2
            w0 -= rate * d0 / np.sqrt(g0)
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
    return Model(hashes, float(w0), w, v)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", sample_rows: int = SAMPLE_ROWS, pair_terms: int = PAIR_TERMS) -> Model:
    """Fit on about `sample_rows` labelled rows of `docs` for which `usable` holds."""
    sample = labelled_sample(docs, labels, label, usable, sample_rows)
    totals = sample.groupBy(F.col("y") > 0).count().collect()
    counts = {bool(r[0]): r[1] for r in totals}
    positive, negative = counts.get(True, 0), counts.get(False, 0)
    if not positive or not negative:
        share = np.clip(positive / max(positive + negative, 1), 1e-9, 1 - 1e-9)
        return Model(np.empty(0, np.uint32), float(np.log(share / (1 - share))), np.empty(0), np.empty((0, RANK)))
    found = materialize(term_counts(sample, positive, negative), "term-counts")
    telling = {r.h for r in found.where(F.col("g") >= LEAST_G).select("h").collect()}  # the sample bounds them
    varying = found.orderBy(F.desc(F.col("df") * (positive + negative - F.col("df"))), "h").limit(pair_terms)
    hashes = np.array(sorted(telling | {r.h for r in varying.select("h").collect()}), dtype=np.uint32)
    shell = pickle.dumps(Model(hashes, 0.0, np.empty(0), np.empty((0, RANK))))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(shell)
        table = model.table()
        for batch in small_batches(batches):
            at = [model.indices(t, table).astype(np.int32) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), batch.column("y")], ["at", "y"])

    got = sample.mapInArrow(rows, "at array<int>, y double").toArrow().combine_chunks()
    at = [x.values.to_numpy() for x in got.column("at")]
    y = (got.column("y").to_numpy() > 0).astype(float)
    order = np.lexsort(([int(x.sum()) for x in at], [hash(tuple(x.tolist())) for x in at], y))  # the same order, however Spark returned the rows
    at, y = [at[i] for i in order], y[order]
    kept = np.union1d(np.flatnonzero(np.isin(hashes, list(telling))), interacting(at, y, len(hashes)))
    place = np.full(len(hashes), -1)
    place[kept] = np.arange(len(kept))
    return fit_machine([x[x >= 0] for x in (place[a] for a in at)], y, hashes[kept])


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and `score` for every row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    schema = docs.select(*keep).schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = model.table()
        for batch in small_batches(batches):
            values = [model.score(model.indices(t.as_py(), table)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(f"k{i}") for i in range(len(keep))), pa.array(values, pa.float64())], [*keep, "score"])

    columns = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    return docs.select(*columns, "text").mapInArrow(scored, schema.add("score", "double"))


def held_out(doc_id: Column) -> Column:
    return in_remainder(doc_id, 4, 2)
