"""Benchmark decontamination with suffix arrays of the training text.

Each task cuts its documents into shards. A shard's suffix array is built by prefix
doubling: ranks of the first 1, 2, 4 .. words of each place, every level from the one
before. Every suffix of every benchmark item is then looked up by binary search, the
ranks of its own first 1, 2, 4 .. words first, then, from the longest such stretch
down, the rest. That gives each suffix its longest verbatim match and the range of
places that have it; the ranges at window depth give the words that windows cover.

A match of LEAD words or more lies in a run of places whose next LEAD words all occur
in some item, so only such runs, with a gap after each, go into the array; its size
follows the overlap and not the corpus. Items of fewer words go in as places of their
own. Items of equal words are searched once and keep all their ids; windows that the
same items have share one list of them.

Only one block of the benchmark is held in each task. Its words are counted first;
beyond `block_words` it is cut into blocks by item, and the documents pass one block
after the other, written to the shared folder in between.

Null text has no words and no hits. Empty tables give empty results, an empty
benchmark leaves every document clean. Repeated rows and repeated ids stay, each
row for itself. Columns that clash with the operator's own are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkit as K
from tessera.llm.shared import renamed, stored

WINDOW = 13
SHARD_BYTES = 4 << 20
BLOCK_WORDS = 4_000_000
LEAD = 4
_SPAN = "struct<begin:long,end:long,item:string,item_begin:long,match_begin:long,length:long>"


class TestSuffixes:
    """All suffixes of the items of one block; items of equal words are one.

    names: for each distinct item, its ids as text. sets: the distinct lists of
    items that some window has; window_set: the list of the window at each place,
    -1 where none begins.
    """

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int):
        w = K.words(pa.array(texts, pa.string()), K.ALNUM_WORDS, lower=True)
        same: dict[bytes, int] = {}
        names: list[set[str]] = []
        kept: list[np.ndarray] = []
        for i, (a, b) in enumerate(zip(w.first.tolist(), w.first[1:].tolist())):
            if b > a:
                k = same.setdefault(w.hash[a:b].tobytes(), len(same))
                if k == len(names):
                    names.append(set())
                    kept.append(w.hash[a:b])
                names[k] |= {ids[i]} if ids[i] is not None else set()
        self.names = [sorted(x) for x in names]
        counts = np.array([len(x) for x in kept], np.int64)
        self.words = np.concatenate(kept) if kept else np.zeros(0, np.uint64)
        ends = np.cumsum(counts)
        self.item = np.repeat(np.arange(len(kept)), counts)
        self.begin = np.arange(len(self.words)) - np.repeat(ends - counts, counts)
        self.left = np.repeat(ends, counts) - np.arange(len(self.words))
        self.depth = np.where(self.left >= window, window, np.where((self.begin == 0), self.left, 0))
        self._window_sets()
        #: for each length of lead, the sorted leads and their places: LEAD for suffixes of so many words, less for shorter items
        self.leads: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in range(1, LEAD + 1):
            at = np.flatnonzero(self.left >= LEAD if k == LEAD else (self.begin == 0) & (self.left == k))
            if len(at):
                lead = _lead(self.words, k)[at]
                order = np.argsort(lead, kind="stable")
                self.leads[k] = lead[order], at[order]

    def _window_sets(self) -> None:
        self.window_set, self.sets = np.full(len(self.words), -1, np.int64), []
        at = np.flatnonzero(self.depth > 0)
        if not len(at):
            return
        key = np.zeros(len(at), np.uint64)
        for j in range(int(self.depth.max())):
            has = self.depth[at] > j
            key[has] = K.mix(key[has] * np.uint64(0x9E3779B97F4A7C15) + self.words[at[has] + j])
        _, gram = np.unique(key, return_inverse=True)
        pairs = np.unique(np.stack([gram, self.item[at]], axis=1), axis=0)
        items = np.split(pairs[:, 1], np.flatnonzero(np.diff(pairs[:, 0])) + 1)
        known: dict[bytes, int] = {}
        of_gram = np.array([known.setdefault(x.tobytes(), len(known)) for x in items])
        self.sets = [np.frombuffer(x, np.int64) for x in known]
        self.window_set[at] = of_gram[gram]


def _lead(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each place on; places near the end get some value."""
    out = np.zeros(len(words), np.uint64)
    for j in range(min(k, len(words))):
        out[: len(words) - j] += words[j:] * K._STEPS[j]
    return K.mix(out)


class Shard(NamedTuple):
    """levels: ranks of the first 1, 2, 4 .. words at each place, 0 for a gap; keys: what each level's ranks from 1 on stand for.

    array: places in the order of their suffixes. A gap is less than any word.
    """

    levels: list[np.ndarray]
    keys: list[np.ndarray]
    array: np.ndarray


def suffix_array(words: np.ndarray, gap: np.ndarray, longest: int) -> Shard:
    """The suffix array by prefix doubling, up to suffixes that differ within `longest` words or end at a gap.

    At each level the ranks of all places come from one sort of pairs of ranks of
    the level before. The gap counts as the least word.
    """
    keys, rank = np.unique(words[~gap], return_inverse=True)
    first = np.zeros(len(words), np.int64)
    first[~gap] = rank + 1
    levels, all_keys, width, base = [first], [keys], 1, np.int64(len(words) + 1)
    while width < longest:
        now = levels[-1]
        ahead = np.zeros(len(words), np.int64)
        ahead[: max(0, len(words) - width)] = now[width:]
        both = now * base + ahead
        keys, rank = np.unique(both, return_inverse=True)
        levels.append(np.where(gap, 0, rank + 1))
        all_keys.append(keys)
        width *= 2
    places = np.flatnonzero(~gap)
    return Shard(levels, all_keys, places[np.argsort(levels[-1][places], kind="stable")])


def _test_ranks(shard: Shard, tests: TestSuffixes, active: np.ndarray, size: int) -> list[np.ndarray]:
    """For each level, the rank of the first 1, 2, 4 .. words of the active test places in the shard; 0 where it has no such stretch.

    Stretches end with the item: only whole ones have a rank.
    """
    here = np.zeros(len(tests.words) + 1, np.int64)
    out, width, base = [], 1, np.int64(size + 1)
    for level, keys in enumerate(shard.keys):
        if level == 0:
            want, ok = tests.words[active], np.ones(len(active), bool)
        else:
            ahead = np.minimum(active + width // 2, len(tests.words))
            whole = tests.left[active] >= width
            a, b = out[-1][active], np.where(whole, out[-1][ahead], 0)
            want, ok = a * base + b, (a > 0) & (b > 0)
        at = np.searchsorted(keys, want)
        ok &= keys[np.minimum(at, len(keys) - 1)] == want
        ranks = here.copy()
        ranks[active[ok]] = at[ok] + 1
        out.append(ranks)
        width *= 2
    return out


def _narrow(shard: Shard, level: int, low: np.ndarray, high: np.ndarray, depth: np.ndarray, want: np.ndarray, right: bool) -> np.ndarray:
    """Binary search in ranges of the array by the rank, at a level, of what follows `depth` words."""
    low, high = low.copy(), high.copy()
    ranks, array = shard.levels[level], shard.array
    while len(live := np.flatnonzero(low < high)):
        mid = (low[live] + high[live]) // 2
        at = array[mid] + depth[live]
        have = np.where(at < len(ranks), ranks[np.minimum(at, len(ranks) - 1)], 0)
        up = have <= want[live] if right else have < want[live]
        low[live[up]], high[live[~up]] = mid[up] + 1, mid[~up]
    return low


def search(shard: Shard, ranks: list[np.ndarray], places: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest match, of at most `bound` words, of the test suffix at each place, and the range [low, high) of the array that has it."""
    n = len(places)
    bound = np.minimum(bound, 1 << (len(ranks) - 1))  # the array is in order so far, and no match is longer
    low, high, length = np.zeros(n, np.int64), np.full(n, len(shard.array), np.int64), np.zeros(n, np.int64)
    # the longest level may fit more than once, each shorter one once after it
    for level in range(len(ranks) - 1, -1, -1):
        live = np.arange(n)
        while len(live):
            live = live[length[live] + (1 << level) <= bound[live]]
            want = ranks[level][places[live] + length[live]]
            live, want = live[want > 0], want[want > 0]
            a = _narrow(shard, level, low[live], high[live], length[live], want, right=False)
            b = _narrow(shard, level, a, high[live], length[live], want, right=True)
            live, a, b = live[b > a], a[b > a], b[b > a]
            low[live], high[live] = a, b
            length[live] += 1 << level
            if level < len(ranks) - 1:
                break
    return length, low, high


class Hits(NamedTuple):
    """What one row shares with the benchmark: words that windows cover, items, and each stretch's longest match."""

    spans: list[tuple[int, int]]
    items: list[int]
    matches: list[tuple[int, int, int, int]]  # item, begin in the item, begin in the row, words


def shard_hits(column: pa.Array, tests: TestSuffixes) -> tuple[np.ndarray, dict[int, Hits]]:
    """Words of each row, and the hits of rows that have some."""
    w = K.words(column, K.ALNUM_WORDS, lower=True)
    counts, hits = np.diff(w.first), {}
    if not len(w.hash) or not tests.leads:
        return counts, hits
    row = np.repeat(np.arange(len(counts)), counts)
    rest = w.first[1:][row] - np.arange(len(row))
    runs, active = [], []  # begin and end of runs of words in the array; test places that can match
    for k, (leads, at) in tests.leads.items():
        lead = _lead(w.hash, k)
        near = np.minimum(np.searchsorted(leads, lead), len(leads) - 1)
        found = np.flatnonzero((leads[near] == lead) & (rest >= k))
        if not len(found):
            continue
        if k == LEAD:  # neighbouring places are one run
            new = np.concatenate([[True], (np.diff(found) > 1) | (row[found[1:]] != row[found[:-1]])])
            begins = found[new]
            ends = found[np.append(np.flatnonzero(new)[1:], len(found)) - 1] + k
        else:
            begins, ends = found, found + k
        runs.append(np.stack([begins, ends], axis=1))
        some = np.unique(lead[found])
        a, b = np.searchsorted(leads, some, side="left"), np.searchsorted(leads, some, side="right")
        active.append(at[np.repeat(a, b - a) + _count_up(b - a)])
    if not runs:
        return counts, hits
    runs, active = np.concatenate(runs), np.unique(np.concatenate(active))
    size = runs[:, 1] - runs[:, 0] + 1  # and a gap
    source = np.repeat(runs[:, 0], size) + _count_up(size)
    gap = np.zeros(len(source), bool)
    gap[np.cumsum(size) - 1] = True
    words = np.where(gap, 0, w.hash[np.minimum(source, len(w.hash) - 1)])
    # all places of an active suffix take part, its last LEAD words too
    reach = np.unique(np.minimum((active[:, None] + np.arange(LEAD)).ravel(), len(tests.words) - 1))
    shard = suffix_array(words, gap, int(min(tests.left[active].max(), size.max())))
    ranks = _test_ranks(shard, tests, reach, len(words))
    longest, low, high = search(shard, ranks, active, tests.left[active])

    windows = np.flatnonzero((tests.depth[active] > 0) & (longest >= tests.depth[active]))
    if not len(windows):
        return counts, hits
    asked = active[windows]
    _, first, last = search(shard, ranks, asked, tests.depth[asked])
    # equal windows have one range
    depth, of_set = tests.depth[asked], tests.window_set[asked]
    _, once = np.unique(first * (depth.max() + 1) + depth, return_index=True)
    first, last, depth, of_set = first[once], last[once], depth[once], of_set[once]
    which = np.repeat(np.arange(len(once)), last - first)
    at = source[shard.array[np.repeat(first, last - first) + _count_up(last - first)]]
    in_row, begin, end = row[at], at - w.first[row[at]], at - w.first[row[at]] + depth[which]

    # the suffix of each place: of those whose longest match lies there the one with most words, else one whose window does
    slots, words_there = np.full(len(shard.array), -1, np.int64), np.zeros(len(shard.array), np.int64)
    for j, x, y, n in [*zip(asked[once].tolist(), first.tolist(), last.tolist(), depth.tolist()), *(x[1:] for x in sorted(zip(longest[windows].tolist(), asked.tolist(), low[windows].tolist(), high[windows].tolist(), longest[windows].tolist())))]:
        slots[x:y], words_there[x:y] = j, n
    filled = np.flatnonzero(slots >= 0)
    filled = filled[np.argsort(words_there[filled], kind="stable")]
    suffix, length = np.full(len(w.hash), -1, np.int64), np.zeros(len(w.hash), np.int64)
    suffix[source[shard.array[filled]]], length[source[shard.array[filled]]] = slots[filled], words_there[filled]

    order = np.lexsort((end, begin, in_row))
    in_row, begin, end, of_set = in_row[order], begin[order], end[order], of_set[which][order]
    for a, b in _groups(in_row):
        i = int(in_row[a])
        spans = merge(begin[a:b], end[a:b])
        items = np.unique(np.concatenate([tests.sets[s] for s in np.unique(of_set[a:b])])).tolist()
        matches = []
        for x, y in spans:
            k = w.first[i] + x + int(np.argmax(length[w.first[i] + x : w.first[i] + y]))
            matches.append((int(tests.item[suffix[k]]), int(tests.begin[suffix[k]]), int(k - w.first[i]), int(length[k])))
        hits[i] = Hits(spans, items, matches)
    return counts, hits


def _count_up(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. for each size in turn."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _groups(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, int)
    return zip(cuts.tolist(), cuts[1:].tolist())


def merge(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint intervals that cover the given ones, which come sorted by begin."""
    out: list[tuple[int, int]] = []
    for a, b in zip(begin.tolist(), end.tolist()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _both(a: list[dict], b: list[dict]) -> list[dict]:
    """Spans of two blocks as one: what touches is one span, with the longer of its matches."""
    out: list[dict] = []
    for x in sorted([*a, *b], key=lambda s: (s["begin"], s["end"])):
        if out and x["begin"] <= out[-1]["end"]:
            last = out[-1]
            out[-1] = (last if last["length"] >= x["length"] else x) | {"begin": last["begin"], "end": max(last["end"], x["end"])}
        else:
            out.append(x)
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, keep: list[str] | None = None) -> DataFrame:
    """Every document row with n_words, spans, items (ids as text) and longest.

    keep: columns of `docs` to return beside them, by default all but text.
    spans: word intervals that windows cover, each with the longest verbatim match that
    was found in it: an item that has it (of equal ones the smallest id), where it begins
    in the item and in the document, and its words. A suffix counts with its longest
    match in the shard, and with its window wherever that occurs.
    longest: words of the longest of these matches; 0 if none.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text"))
    total = bench.agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(total / 2 / block_words))
    keep = [c for c in docs.columns if c != "text"] if keep is None else keep
    keep = [c for c in keep if c not in ("n_words", "spans", "items", "longest")]
    plain = docs.select(*[f"`{c}`" for c in keep], "text", F.lit(0).cast("long").alias("n_words"), F.expr(f"cast(array() as array<{_SPAN}>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"), F.lit(0).cast("long").alias("longest"))
    schema = plain.schema
    for k in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).collect()  # bounded by block_words
        tests = spark.sparkContext.broadcast(TestSuffixes([r["id"] for r in rows], [r["text"] for r in rows], window))
        last = k == blocks - 1
        out_schema = schema if not last else schema.__class__([f for f in schema.fields if f.name != "text"])
        plain = plain.mapInArrow(_searcher(tests, keep, last), out_schema)
        if not last:  # tasks hold one block at a time
            plain = stored(plain, "contamination")
            tests.unpersist()
    return plain


def _searcher(tests, keep: list[str], last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.chunks(batch, size=SHARD_BYTES):
                counts, hits = shard_hits(part.column("text"), tests.value)
                spans, items, longest = (part.column(c) for c in ("spans", "items", "longest"))
                if hits:
                    kind, names = spans.type, tests.value.names
                    spans, items, longest = spans.to_pylist(), items.to_pylist(), longest.to_pylist()
                    for i, hit in hits.items():
                        found = [{"begin": a, "end": b, "item": next(iter(names[m[0]]), None), "item_begin": m[1], "match_begin": m[2], "length": m[3]} for (a, b), m in zip(hit.spans, hit.matches)]
                        spans[i] = _both(spans[i], found)
                        items[i] = sorted({*items[i], *(x for k in hit.items for x in names[k])})
                        longest[i] = max(longest[i], *(m[3] for m in hit.matches))
                    spans, items, longest = pa.array(spans, kind), pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int64())
                columns = {c: part.column(c) for c in keep}
                if not last:
                    columns["text"] = part.column("text")
                columns |= {"n_words": pa.array(counts.astype(np.int64)), "spans": spans, "items": items, "longest": longest}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def judge(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated: hit words are at least a twentieth of all."""
    found = found.withColumn("n_hit", F.expr("aggregate(spans, 0L, (n, x) -> n + x.end - x.begin)"))
    return found.select(
        *[f"`{c}`" for c in found.columns if c not in ("n_items", "items_sha256", "contaminated")],
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        F.coalesce((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")), F.lit(False)).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with their own columns and whole texts."""
    rows, own = renamed(docs)
    found = judge(find_contamination(rows, benchmark, window, keep=own))
    return found.where(~F.col("contaminated")).select(*[f"`{c}`" for c in own]).toDF(*docs.columns)
