"""Quality classifier: naive Bayes support vector machine over byte n-gram indicators.

A text's features say which n-grams of one to three bytes it holds, hashed to
2**17 buckets, and which n-grams of one and the same word, for n of 2, 3, 4, 6, 8,
12 and so on up to 64, whatever the word is. Each indicator is scaled by the log ratio of its smoothed counts in
the two classes; a linear hinge-loss model on these is fitted by dual coordinate
descent; its margins become scores by a logistic curve fitted on folds held out.

The model learns from a bounded sample of labelled documents (`TRAIN_ROWS`) that
is a parameter; each text that is scored is read whole. Executors send bucket
numbers, not texts, to the driver.

Null and empty texts hold no n-gram: their score comes from the intercept alone.
Without labels, or with one label only, every score is the share of label 1
(a half without labels). Repeated rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkit as K
from tessera.llm.shared import labelled_rows, renamed

TRAIN_ROWS = 6000
BUCKETS = 1 << 17
GRAMS = 3
RUNS = (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)


class Model(NamedTuple):
    weights: np.ndarray
    intercept: float
    slope: float
    shift: float

    def margin(self, sets: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[s].sum() for s in sets], float) + self.intercept

    def score(self, sets: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(sets) + self.shift, -30, 30)))


def indicators(column: pa.Array) -> list[np.ndarray]:
    """The buckets of the n-grams of each text."""
    data, bounds = K.text_bytes(column)
    value = data.astype(np.uint32)
    hashed = []
    for n in range(1, GRAMS + 1):
        code = np.full(max(len(value) - n + 1, 0), n, np.uint32)
        for k in range(n):
            code = code * np.uint32(257) + value[k : k + len(code)]
        code *= np.uint32(2654435761)
        hashed.append((code ^ (code >> np.uint32(13))) % np.uint32(BUCKETS - len(RUNS)))
    longest = _longest_run(K.words(column, K.SPACE_WORDS, lower=True))
    seen, out = np.zeros(BUCKETS, bool), []
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        for n, h in enumerate(hashed, 1):
            seen[h[a : max(b - n + 1, a)]] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        out.append(found)
    run = np.searchsorted(RUNS, longest, side="right")
    return [np.concatenate([s, BUCKETS - len(RUNS) + np.arange(r)]) if r else s for s, r in zip(out, run.tolist())]


def _longest_run(w: K.Words) -> np.ndarray:
    """How often in a row each text says one word, at most."""
    n, h = len(w.first) - 1, w.hash
    longest = np.minimum(np.diff(w.first), 1)
    if len(h):
        new = np.ones(len(h) + 1, bool)
        new[1:-1] = h[1:] != h[:-1]
        new[w.first] = True
        start = np.flatnonzero(new)
        row = np.searchsorted(w.first, start[:-1], side="right") - 1
        np.maximum.at(longest, row[row < n], np.diff(start)[row < n])
    return longest


def _descend(sets: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float, rounds: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss on indicators scaled by `ratio`, with an intercept feature of 1."""
    w, intercept = np.zeros(len(ratio)), 0.0
    alpha = np.zeros(len(y))
    square = ratio**2
    diagonal = np.array([square[s].sum() for s in sets]) + 1.0
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(y)):
            s = sets[i]
            gradient = y[i] * ((w[s] * ratio[s]).sum() + intercept) - 1
            step = np.clip(alpha[i] - gradient / diagonal[i], 0, cost) - alpha[i]
            if step:
                alpha[i] += step
                w[s] += step * y[i] * ratio[s]
                intercept += step * y[i]
                most = max(most, abs(gradient * step))
        if most < 1e-6:
            break
    return w * ratio, intercept


def _one(sets: list[np.ndarray], y: np.ndarray, cost: float, rounds: int) -> tuple[np.ndarray, float]:
    counts = {c: np.bincount(np.concatenate([s for s, v in zip(sets, y) if v == c] or [np.zeros(0, int)]), minlength=BUCKETS) + 1.0 for c in (1, -1)}
    ratio = np.log((counts[1] / counts[1].sum()) / (counts[-1] / counts[-1].sum()))
    # an n-gram in under three documents says nothing about others
    ratio[counts[1] + counts[-1] < 5] = 0
    return _descend(sets, y, ratio, cost, rounds)


def fit(sets: list[np.ndarray], labels: np.ndarray, cost: float = 0.01, rounds: int = 12, folds: int = 3) -> Model:
    """Fits weights to all rows, and the curve from margins to scores to margins of folds that were held out."""
    y = np.where(labels > 0, 1, -1)
    if len(y) == 0 or abs(y.sum()) == len(y):
        share = (np.sum(y > 0) + 1) / (len(y) + 2)
        return Model(np.zeros(BUCKETS), 0.0, 1.0, float(np.log(share / (1 - share))))
    fold, margins = np.arange(len(y)) % folds, np.zeros(len(y))
    for k in range(folds):
        rest = np.flatnonzero(fold != k)
        if abs(y[rest].sum()) < len(rest):
            w, b = _one([sets[i] for i in rest], y[rest], cost, rounds)
            for i in np.flatnonzero(fold == k):
                margins[i] = w[sets[i]].sum() + b
    slope, shift = _curve(margins, y > 0)
    w, b = _one(sets, y, cost, rounds)
    return Model(w, b, slope, shift)


def _curve(margin: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps with a slight pull to slope 1."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        h = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - positive) * margin).sum() + 0.01 * (a - 1), (p - positive).sum() + 0.01 * b])
        m = np.array([[(h * margin**2).sum() + 0.01, (h * margin).sum()], [(h * margin).sum(), h.sum() + 0.01]])
        da, db = np.linalg.solve(m, g)
        a, b = a - float(np.clip(da, -1, 1)), b - float(np.clip(db, -1, 1))
    return max(a, 1e-3), b


def train(docs: DataFrame, labels: DataFrame, where: Column | None = None, rows: int = TRAIN_ROWS) -> Model:
    """Learns labels.quality of at most `rows` labelled documents; where: which ids may be learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.chunks(batch):
                sets = [s.astype("<u4").tobytes() for s in indicators(part.column("text"))]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "label": part.column("label"), "s": pa.array(sets, pa.binary())})

    sample = labelled_rows(docs, labels, "quality", rows, where).select(F.col("doc_id").cast("string"), F.col("label").cast("int"), "text")
    seen = sample.mapInArrow(run, "doc_id string, label int, s binary").groupBy("doc_id").agg(F.min(F.struct("label", "s")).alias("r")).orderBy("doc_id").toArrow()  # bounded by rows
    pairs = seen.column("r").to_pylist()
    return fit([np.frombuffer(r["s"], "<u4").astype(np.int64) for r in pairs], np.array([r["label"] for r in pairs], int))


def keep_accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that the model accepts, with their own columns, whatever their names."""
    rows, own = renamed(docs)
    return classify(rows, model, keep=own).where("predicted = 1").select(*[f"`{c}`" for c in own]).toDF(*docs.columns)


def classify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Every row with score and predicted. keep: columns to carry along, by default all but text."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted") and (keep is not None or c != "text")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**17 weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.chunks(batch):
                score = shared.value.score(indicators(part.column("text")))
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in keep} | {"score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))})

    frame = docs.select(*[f"`{c}`" for c in dict.fromkeys([*keep, "text"])])
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name in keep] + ["score double", "predicted int"])
    return frame.mapInArrow(run, fields)
