"""Quality rules: document statistics, two base rules and a verdict of boosted trees.

Statistics come from the bytes of whole texts, vectorised over a batch. The trees
learn from a bounded sample of labelled documents (`TRAIN_ROWS`) and are scored
from flat node arrays in every task; the forest's size is fixed by its rounds and
depth. Where more symbols, repeated lines or repeated words can only speak
against a document, the trees are constrained to be monotonic.

Null and empty texts have no words and fail the base rule. Without labels, or
with labels of one kind, the trees give a constant, and the base rules decide
unless that constant is below a half. Repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import boosted
from tessera.llm import textkit as K
from tessera.llm.shared import labelled_rows

TRAIN_ROWS = 8000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the trees and the direction in which each may move the score.
FEATURES = {"n_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "digit_share": 0, "mark_share": 0, "lines": 0, "words_a_line": 0, "distinct_share": 0, "bang_share": -1}

_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_MARK = np.isin(np.arange(256), [ord(c) for c in ".,;:?\"'()-"])
_BANG = np.arange(256) == ord("!")
_FIRST = (np.arange(256) & 0xC0) != 0x80


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of set flags between neighbouring bounds."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[bounds])


def _row_key(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    return K.mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _first_of_kind(key: np.ndarray) -> np.ndarray:
    """True at the first place of each value."""
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True
    return first


def statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The five counts and the features of each text."""
    w = K.words(column, K.SPACE_WORDS, lower=False)
    data, n = w.data, len(column)
    _, bounds = K.text_bytes(column)
    n_words = np.diff(w.first)
    row = np.repeat(np.arange(n), n_words)
    in_word = K.SPACE_WORDS[data]
    word_chars = _sums(in_word & _FIRST[data], bounds)
    n_symbols = _sums(_SYMBOL[data], bounds)

    # lines: a row's bytes cut at \n; those without a word don't count
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([bounds[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([bounds[1:], breaks]), kind="stable")
    line_row = np.repeat(np.arange(n), _sums(data == 10, bounds) + 1)
    worded = np.diff(np.searchsorted(w.start, np.stack([start, end], axis=1)), axis=1)[:, 0] > 0 if len(start) else np.zeros(0, bool)
    start, end, line_row = start[worded], end[worded], line_row[worded]
    fresh = _first_of_kind(_row_key(K.hash_spans(data, start, end), line_row))
    n_dup_lines = np.bincount(line_row[~fresh], minlength=n)
    n_lines = np.bincount(line_row, minlength=n)

    # windows of three words that a row holds twice or more
    covered = np.zeros(len(w.hash), bool)
    if len(w.hash) >= 3:
        h = w.hash
        rolled = K.mix(h[:-2] * K._STEPS[0] + h[1:-1] * K._STEPS[1] + h[2:] * K._STEPS[2])
        at = np.flatnonzero(row[2:] == row[:-2])
        key = _row_key(rolled[at], row[at])
        order = np.argsort(key, kind="stable")
        same = np.concatenate([[False], key[order][1:] == key[order][:-1]]) if len(order) else np.zeros(0, bool)
        twice = same.copy()
        twice[:-1] |= same[1:]
        again = at[order[twice]]
        for k in range(3):
            covered[again + k] = True
    n_repeat = np.bincount(row[covered], minlength=n)
    n_distinct = np.bincount(row[_first_of_kind(_row_key(w.hash, row))], minlength=n)

    counts = np.stack([n_words, word_chars, n_symbols, n_dup_lines, n_repeat], axis=1).astype(np.int64)
    chars, some = np.maximum(_sums(_FIRST[data], bounds), 1), np.maximum(n_words, 1)
    share = lambda table: _sums(table[data], bounds) / chars
    features = np.stack([n_words, word_chars / some, n_symbols / chars, n_dup_lines / np.maximum(n_lines, 1), n_repeat / some, share(_UPPER), share(_DIGIT), share(_MARK), n_lines, n_words / np.maximum(n_lines, 1), n_distinct / some, share(_BANG)], axis=1)
    return counts, features.astype(float)


def base_failed(counts: np.ndarray) -> np.ndarray:
    """Under 50 words, or over half of them in repeated windows."""
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> boosted.Forest:
    """Fits the trees to labels.quality of at most `rows` labelled documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.chunks(batch):
                _, x = statistics(part.column("text"))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "label": part.column("label"), "x": pa.array(list(x), pa.list_(pa.float64()))})

    sample = labelled_rows(docs, labels, "quality", rows).select(F.col("doc_id").cast("string"), F.col("label").cast("int"), "text")
    seen = sample.mapInArrow(run, "doc_id string, label int, x array<double>").groupBy("doc_id").agg(F.min(F.struct("label", "x")).alias("s")).orderBy("doc_id").collect()  # bounded by rows
    x = np.array([r["s"]["x"] for r in seen], float).reshape(len(seen), len(FEATURES))
    y = np.array([r["s"]["label"] for r in seen], float)
    return boosted.fit(x, y, np.array(list(FEATURES.values())))


def score_quality(docs: DataFrame, forest: boosted.Forest, keep: list[str] | None = None) -> DataFrame:
    """Every row with the five counts, base_failed, score and kept. keep: columns to carry along, by default doc_id."""
    out = [*COUNTS, "base_failed", "score", "kept"]
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in out]
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # rounds * 2**(depth+1) nodes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.chunks(batch):
                counts, x = statistics(part.column("text"))
                score, failed = shared.value.score(x), base_failed(counts)
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in keep} | {c: pa.array(counts[:, i]) for i, c in enumerate(COUNTS)} | {"base_failed": pa.array(failed), "score": pa.array(score), "kept": pa.array(~failed & (score >= 0.5))})

    frame = docs.select(*keep, "text")
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name != "text" or "text" in keep] + [f"{c} long" for c in COUNTS] + ["base_failed boolean", "score double", "kept boolean"])
    return frame.mapInArrow(run, fields)
