"""Language identification with error-correcting output codes.

Each learned language gets a codeword of +1 and -1. One logistic classifier a bit,
over normalised counts of hashed two- and three-byte n-grams, predicts that bit.
A text goes to the language whose codeword is nearest under a weighted logistic
loss; the weights are the accuracies of each bit on each language. If the second
is nearly as near, the answer is flagged as ambiguous.

The classifiers learn from a bounded sample (`TRAIN_ROWS` rows, spread over the
languages); every prediction reads the whole text.

Null texts and texts without a letter are `und` with score 0. If nothing can be
learned, every text is `und`; with one language, all others get it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkit as K
from tessera.llm.shared import narrow, remainder, stored

TRAIN_ROWS = 3000
BUCKETS = 4096
AMBIGUOUS = 0.2


class Codes(NamedTuple):
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share of the scores, and the lead over the second."""
        bits = x @ self.weights + self.bias
        loss = np.stack([(np.logaddexp(0, -bits * c) * t).sum(axis=1) for c, t in zip(self.code, self.trust)], axis=1)
        near = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * self.code.shape[1])
        share = near / near.sum(axis=1, keepdims=True)
        best = np.argmin(loss, axis=1)
        score = share[np.arange(len(x)), best]
        second = np.sort(share, axis=1)[:, -2] if share.shape[1] > 1 else np.zeros(len(x))
        return best, score, score - second


def counts(column: pa.Array) -> np.ndarray:
    """Hashed n-gram counts of each text, by square roots and to length 1; ASCII capitals count as small."""
    data, bounds = K.text_bytes(column)
    value = K._ASCII_LOWER[data].astype(np.uint32)
    hashed = []
    for n in (2, 3):
        code = np.full(max(len(value) - n + 1, 0), n, np.uint32)
        for k in range(n):
            code = code * np.uint32(257) + value[k : k + len(code)]
        code *= np.uint32(2654435761)
        hashed.append(((code ^ (code >> np.uint32(15))) % np.uint32(BUCKETS)).astype(np.int64))
    out = np.zeros((len(column), BUCKETS), np.float32)
    for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
        for n, h in zip((2, 3), hashed):
            if b - n + 1 > a:
                out[i] += np.bincount(h[a : b - n + 1], minlength=BUCKETS)
    np.sqrt(out, out=out)
    length = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return out / np.maximum(length, 1e-9)


def codewords(n: int) -> np.ndarray:
    """All splits into two sides for up to five languages; beyond, random dense codes of about 10 log2(n) bits."""
    if n <= 5:
        splits = max(1, 2 ** max(0, n - 1) - 1)
        return np.array([[1 if c == 0 or (bit + 1) >> (c - 1) & 1 == 0 else -1 for bit in range(splits)] for c in range(n)], int).reshape(n, splits)
    rng, bits = np.random.default_rng(11), int(np.ceil(10 * np.log2(n)))
    tries = [rng.choice([-1, 1], (n, bits)) for _ in range(200)]
    apart = [min((a != b).sum() for i, a in enumerate(t) for b in t[:i]) if n <= 60 else 0 for t in tries]
    return tries[int(np.argmax(apart))]


def fit(x: np.ndarray, languages: list[str], rounds: int = 200, rate: float = 20.0, l2: float = 1e-4) -> Codes:
    """All bits at once, by gradient steps with momentum on the logistic loss; languages weigh the same."""
    names = sorted(set(languages))
    y = np.array([names.index(v) for v in languages], int)
    code = codewords(len(names))
    target = code[y].astype(np.float32)
    w, b = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    share = (1 / (len(names) * np.maximum(np.bincount(y, minlength=len(names)), 1)))[y][:, None].astype(np.float32)
    for _ in range(rounds if len(names) > 1 else 0):
        slope = -target * share / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30)))
        vw, vb = 0.9 * vw - rate * (x.T @ slope + l2 * w), 0.9 * vb - rate * 0.1 * slope.sum(axis=0)
        w, b = w + vw, b + vb
    right = np.sign(x @ w + b) == target
    trust = np.array([np.maximum(right[y == c].mean(axis=0), 1e-3) for c in range(len(names))]).reshape(len(names), code.shape[1])
    return Codes(names, code, w, b, trust / np.maximum(trust.sum(axis=1, keepdims=True), 1e-9))


def train(docs: DataFrame, where: Column | None = None, rows: int = TRAIN_ROWS) -> Codes:
    """Learns docs.lang from at most `rows` rows, the same number for each language where there are so many."""
    known = docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    if where is not None:
        known = known.where(where)
    known = known.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    known = known.withColumn("hash", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    sizes = stored(known.groupBy("lang").agg(F.count("*").alias("size")), "language-sizes")
    each = max(1, rows // max(1, sizes.count()))
    # about as many of each language as are wanted, and a few more, by a bound on the hash; the rest is cut below
    share = F.least(F.lit(1.0), (each + 4 * F.sqrt(F.lit(each)) + 8) / F.col("size"))
    picked = stored(known.join(narrow(sizes), "lang").where(F.col("hash") < share * (1 << 40)).select("doc_id", "lang", "hash"), "language-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.chunks(batch):
                x = (counts(part.column("text")) * 65535).astype("<u2")
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "hash": part.column("hash"), "lang": part.column("lang"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    sample = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(narrow(picked), "doc_id").select(F.col("doc_id").cast("string"), "hash", "lang", "text")
    seen = sample.mapInArrow(run, "doc_id string, hash long, lang string, x binary").groupBy("doc_id").agg(F.min(F.struct("hash", "lang", "x")).alias("r")).orderBy("r.hash", "doc_id").toArrow()  # about `rows` rows
    pairs, taken = [], Counter()
    for r in seen.column("r").to_pylist():
        taken[r["lang"]] += 1
        if taken[r["lang"]] <= each:
            pairs.append(r)
    x = np.stack([np.frombuffer(r["x"], "<u2") for r in pairs]).astype(np.float32) / 65535 if pairs else np.zeros((0, BUCKETS), np.float32)
    return fit(x, [r["lang"] for r in pairs])


def has_letter(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    data, bounds = K.text_bytes(column)
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    total = np.concatenate([[0], np.cumsum(ascii_letter)])[bounds]
    found = np.diff(total) > 0
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in column[int(i)].as_py() or "")
    return found


def identify(docs: DataFrame, codes: Codes, keep: list[str] | None = None, ambiguous: float = AMBIGUOUS) -> DataFrame:
    """Every row with lang_pred, score (0 to 1) and ambiguous. keep: columns to carry along, by default doc_id."""
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in ("lang_pred", "score", "ambiguous")]
    shared = docs.sparkSession.sparkContext.broadcast(codes)  # BUCKETS weights a bit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.languages, "und"], dtype=object)
        for batch in batches:
            for part in K.chunks(batch):
                for a in range(0, part.num_rows, 1000):
                    rows = part.slice(a, 1000)
                    if len(names) > 1:
                        best, score, lead = shared.value.decode(counts(rows.column("text")))
                    else:
                        best, score, lead = np.zeros(rows.num_rows, int), np.zeros(rows.num_rows), np.ones(rows.num_rows)
                    none = ~has_letter(rows.column("text"))
                    best, score = np.where(none, len(names) - 1, best), np.where(none, 0.0, score)
                    yield pa.RecordBatch.from_pydict({c: rows.column(c) for c in keep} | {"lang_pred": pa.array(names[best], pa.string()), "score": pa.array(score, pa.float64()), "ambiguous": pa.array(~none & (lead < ambiguous))})

    frame = docs.select(*dict.fromkeys([*keep, "text"]))
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name in keep] + ["lang_pred string", "score double", "ambiguous boolean"])
    return frame.mapInArrow(run, fields)


def held_out_identification(docs: DataFrame, divisor: int = 4, left_out: int = 2) -> DataFrame:
    """Predictions for all rows by a model that never saw the rows whose id hashes to `left_out`."""
    codes = train(docs, remainder("doc_id", divisor) != left_out)
    found = identify(docs, codes)
    return found.withColumn("held_out", F.coalesce(remainder("doc_id", divisor) == left_out, F.lit(False)))
