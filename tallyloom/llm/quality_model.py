"""Quality classifier: naive Bayes support vectors.

A text's n-gram indicators (tokens, token pairs, and pairs of equal neighbouring words, hashed to
`1 << BITS` buckets) are scaled by the class log-count ratios of the labelled rows; a linear
hinge-loss model over the scaled indicators is fitted by dual coordinate descent. Log-count ratios come from grouped counts over a bounded sample of labelled
rows (`count_rows`), the support vectors from a smaller one (`fit_rows`). Scoring reads every text
in full and shuffles nothing; the model has a fixed size.

score = sigmoid(slope * margin): 0.5 lies on the decision boundary.

Edge cases: null and empty texts have no indicators and score by the intercept; without labels of
both classes every text scores the share of label 1 (0.5 without labels); repeated rows are scored
one by one; very long texts are hashed in parts, pairs across two parts included; an empty
table gives an empty result; other columns are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import small_batches
from tallyloom.llm.features import Prefixes, chunks, in_remainder, labelled_sample, mix, runs

BITS = 18
COUNT_ROWS = 30_000
FIT_ROWS = 6_000
_KIND = bytes(0 if c in b" \t\n\x0b\x0c\r" else 1 if c >= 128 or chr(c).isalnum() else 2 for c in range(256))


def indicators(text: str | None) -> np.ndarray:
    """Buckets of the n-grams present in a text, sorted and distinct."""
    present = np.zeros(1 << BITS, dtype=bool)
    mask = np.uint64((1 << BITS) - 1)
    last, before = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)  # the last token and words of the part before
    for part in chunks((text or "").encode("utf-8", "replace")):
        data = np.frombuffer(part, dtype=np.uint8)
        kind = np.frombuffer(part.translate(_KIND), dtype=np.uint8)
        spans = Prefixes(data)
        change = np.flatnonzero(np.diff(kind, prepend=0)) if len(kind) else np.empty(0, dtype=np.int64)
        ends = np.append(change[1:], len(kind))
        visible = kind[change] > 0 if len(change) else np.empty(0, dtype=bool)
        tokens = np.concatenate((last, spans.span(change[visible], ends[visible])))
        last = tokens[-1:]
        present[tokens & mask] = True
        present[mix(tokens[:-1] * np.uint64(3) + tokens[1:]) & mask] = True
        starts, stops = runs(kind != 0)
        whole = np.concatenate((before, spans.span(starts, stops)))
        before = whole[-3:]
        again = whole[1:] == whole[:-1]
        for n in (1, 2, 3):  # runs of equal words, whatever the word
            if again.any():
                present[mix(np.array([n], dtype=np.uint64)) & mask] = True
            again = again[1:] & again[:-1]
    return np.flatnonzero(present)


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    slope: float = 1.0

    def score(self, at: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * (self.weight[at].sum() + self.bias), -30, 30))))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = np.zeros((2, 1 << BITS), dtype=np.int64)
    for batch in small_batches(batches):
        for text, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
            totals[int(y > 0), indicators(text.as_py())] += 1
    used = np.flatnonzero(totals.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (used, totals[1, used], totals[0, used])], ["b", "pos", "neg"])


def log_count_ratios(sample: DataFrame, smoothing: float = 1.0) -> np.ndarray:
    """Class log-count ratio of each bucket; 0 where the sample has fewer than 3 rows."""
    counts = sample.mapInArrow(_counts, "b long, pos long, neg long").groupBy("b").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos + neg >= 3").toArrow()
    pos, neg = (np.full(1 << BITS, smoothing) for _ in range(2))
    at = counts.column("b").to_numpy()
    pos[at] += counts.column("pos").to_numpy()
    neg[at] += counts.column("neg").to_numpy()
    ratios = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    seen = np.zeros(1 << BITS, dtype=bool)
    seen[at] = True
    return np.where(seen, ratios, 0.0)


def dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, epochs: int = 15, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and intercept of the L1-loss linear support vector machine over rows x_i = scale[rows_i].

    `y` is -1 or 1; `cost` bounds each dual variable. The intercept is the weight of a constant 1.
    """
    rng = np.random.default_rng(seed)
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    norms = np.array([(scale[r] ** 2).sum() + 1 for r in rows])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r = rows[i]
            slack = y[i] * ((w[r] * scale[r]).sum() + bias) - 1
            new = min(max(alpha[i] - slack / norms[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * scale[r]
                bias += step
                moved = max(moved, abs(new - alpha[i]) / cost[i])
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", count_rows: int = COUNT_ROWS, fit_rows: int = FIT_ROWS, cost: float = 0.1) -> Model:
    """Fit on labelled rows of `docs` for which `usable` holds; both samples are bounded."""
    ratios = log_count_ratios(labelled_sample(docs, labels, label, usable, count_rows))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [indicators(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([x[ratios[x] != 0].astype(np.int32) for x in found], pa.list_(pa.int32())), batch.column("y")], ["at", "y"])

    got = labelled_sample(docs, labels, label, usable, fit_rows).mapInArrow(rows, "at array<int>, y double").toArrow().combine_chunks()
    y = np.where(got.column("y").to_numpy() > 0, 1.0, -1.0)
    positive = int((y > 0).sum())
    if positive in (0, len(y)):
        share = np.clip((positive + 0.5) / (len(y) + 1), 1e-9, 1 - 1e-9)
        return Model(np.zeros(1 << BITS), float(np.log(share / (1 - share))))
    at = [x.values.to_numpy() for x in got.column("at")]
    order = np.lexsort(([int(x.sum()) for x in at], [len(x) for x in at], y))  # the same order, however Spark returned the rows
    rows_, y = [at[i] for i in order], y[order]
    balance = np.where(y > 0, len(y) / (2 * positive), len(y) / (2 * (len(y) - positive)))
    w, bias = dual_descent(rows_, y, ratios, cost * balance)
    return Model(w * ratios, bias, 2.0)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and `score` for every row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    schema = docs.select(*keep).schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in small_batches(batches):
            values = [model.score(indicators(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(f"k{i}") for i in range(len(keep))), pa.array(values, pa.float64())], [*keep, "score"])

    columns = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    return docs.select(*columns, "text").mapInArrow(scored, schema.add("score", "double"))


def held_out(doc_id: Column) -> Column:
    return in_remainder(doc_id, 3, 1)
