"""Vectorised reading of Arrow text columns: bytes, words, shingles.

All helpers work on the UTF-8 buffer of one Arrow array, so no Python string is
made per word. Words are 64-bit hashes of their bytes; two different words meet
with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
CHUNK_BYTES = 1 << 19

_U = np.uint64
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=_U)
_STEPS = np.array([pow(0xA0761D6478BD642F, j + 1, 1 << 64) for j in range(64)], dtype=_U)
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32

#: Bytes that belong to words split at ASCII white space: [^\x20\x09-\x0D]+
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes that belong to words of digits, letters and non-ASCII signs, in lower case.
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True


class Words(NamedTuple):
    """hash: one per word; first: index of each row's first word, and the total; start, end: bytes in data."""

    hash: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's bounds in them; null reads as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `size` bytes of text each; a row is never cut."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(lengths) - lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def words(column: pa.Array, kind: np.ndarray, lower: bool) -> Words:
    """Every word of every row; `kind` tells which bytes belong to words."""
    data, bounds = text_bytes(column)
    if lower:
        data = _ASCII_LOWER[data]
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = kind[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside[:-1]
    at = bounds[(bounds < len(data))]
    edge = inside != before
    starts_at = edge & inside
    ends_at = edge & before
    cut = at[before[at] & inside[at]]
    starts_at[cut] = True
    ends_at[cut] = True
    start, end = np.flatnonzero(starts_at), np.flatnonzero(ends_at)
    return Words(hash_spans(data, start, end), np.searchsorted(start, bounds), start, end, data)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for each pair of bounds."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray((len(data) + 8,), dtype="<u8", buffer=padded.data, strides=(1,))
    length = end - start
    h = mix((eights[start] & _MASK[np.minimum(length, 8)]) + _U(0x9E3779B97F4A7C15) * length.astype(_U))
    more, k = np.flatnonzero(length > 8), 8
    while len(more):
        rest = length[more] - k
        h[more] = mix((h[more] * _U(0xD6E8FEB86659FD93)) ^ (eights[start[more] + k] & _MASK[np.minimum(rest, 8)]))
        more, k = more[rest > 8], k + 8
    return h


def shingles(hashes: np.ndarray, first: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and each row's bounds in them.

    A row of fewer words, but not none, has its whole sequence as one shingle.
    """
    counts = np.diff(first)
    n = len(hashes)
    rolled = np.zeros(max(n - k + 1, 0), dtype=_U)
    for j in range(k):
        rolled += hashes[j : j + len(rolled)] * _STEPS[j]
    per_row = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    bounds = np.concatenate([[0], np.cumsum(per_row)])
    out = np.zeros(bounds[-1], dtype=_U)
    row = np.repeat(np.arange(len(counts)), per_row)
    at = first[:-1][row] + (np.arange(bounds[-1]) - bounds[:-1][row])
    whole = counts[row] >= k
    out[whole] = mix(rolled[at[whole]])
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        h = counts[short].astype(_U)
        for j in range(k - 1):
            has = np.flatnonzero(counts[short] > j)
            h[has] = mix(h[has] * _U(0xE7037ED1A0B428DB) + hashes[first[:-1][short[has]] + j])
        out[bounds[:-1][short]] = h
    return out, bounds


def row_sets(values: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct values of each row."""
    return [np.unique(values[a:b]) for a, b in zip(bounds, bounds[1:])]
