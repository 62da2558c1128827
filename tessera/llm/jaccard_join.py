"""Near-duplicate documents by an exact Jaccard join on word shingles.

Two documents link when 100 * shared >= 80 * united distinct five-word shingles.
A document with n shingles needs at least T = ceil(0.8 n) of them in a partner: the
T-occurrence problem over its inverted lists. DivideSkip sets the L longest lists
aside, merges the short ones, and probes the long ones by binary search for those
documents only that occur T - L times in the short ones. It runs twice:

* over the cluster, with L = T - 1: the n - T + 1 short lists of all documents are
  merged in ranges of hashes, and every document that occurs in one is a candidate;
* over the candidates of a document, which are sent to it with their sets: here L
  follows from T and the longest list, and what remains reaches the overlap.

1. Documents with equal sets become one class; only classes are compared.
2. One order of shingles holds for all: those that tasks saw often come last. The
   counts cover all documents but only steer the order; any order is right.
3. Each class posts its first n - T + 1 shingles to ranges of hashes; a range's task
   merges the sorted postings into lists. Lists of up to PAIR_LIST classes give pairs,
   but not where both have one shingle just before this one in the common order: the
   list of that one has the pair. Nor where too few shingles follow: a pair that
   links has enough from its first common shingle on. Longer lists give pairs of
   each member with HEADS of the list only, and their members are remembered.
4. Pairs whose sizes or parity bitmaps prove too little overlap go. For the rest,
   partners are sent to the smaller class, in groups of GROUP, and searched there.
5. Links make components. A long list is open if its members lie in several. The
   members of all open lists are joined once more, by themselves: with the exact
   counts among them, what most of them share comes last and lists are short. Now
   only pairs between components are made, and of all lists that have no more than
   `pair_list` of them a member. Lists that are open then go on to the next round, in
   which the bound is twice as high, so rounds end. No link between two components
   is missed.

Postings of a class are sent once a task. Lists of shingles that tasks saw often are
split by class over several tasks. Nothing is dropped or capped.

Null text and texts without words have no shingles and are their own component;
fewer than five words count as one shingle. Rows of one id are each their own
document. Rows without an id link like others, but component_id is the smallest id
that a component has. Other columns than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkit as K
from tessera.llm.components import components, longs
from tessera.llm.shared import drop_stored, free_name, narrow, stored

PERCENT = 80
OFTEN = 4  # a task reports shingles that it saw in so many classes
ORDER_ROWS = 500_000  # reported shingles whose order is known in every task, the most frequent ones
PAIR_LIST = 48  # longest list of which all pairs are made
SPLIT_LIST = 2000  # classes of a list in one task
RANGE_POSTINGS = 400_000  # postings in one range of hashes
FOLD = 128  # bytes of the bitmaps that go with members of open lists
HEADS = 6  # members of a long list that all others are paired with
GROUP = 64  # partners that are searched with one copy of a class
SEARCHED = 1_000_000  # shingles of partners that a task searches at once
_NONE = np.uint64(0)


def least_overlap(a, b, percent: int = PERCENT):
    """Smallest number of shared members with 100 * shared >= percent * united, for sets of a and b members."""
    return -(-percent * (a + b) // (100 + percent))


def short_lists(n: int, percent: int = PERCENT) -> int:
    """Lists that remain when the T - 1 longest are set aside."""
    return n - -(-percent * n // 100) + 1


def class_of(members: np.ndarray) -> int:
    """A 64-bit signature of a set of shingles."""
    h = K.mix(members + np.uint64(0x632BE59BD9B4E019))
    parts = np.array([np.bitwise_xor.reduce(h), h.sum(dtype=np.uint64), len(members)], np.uint64)
    return int(K.mix((K.mix(parts) * K._STEPS[:3]).sum(keepdims=True)).view(np.int64)[0])


def bitmap(members: np.ndarray) -> np.ndarray:
    """Parity of the members that fall on each bit; 64 bits at least, else about one for each member."""
    bits = 1 << max(6, int(len(members) - 1).bit_length())
    odd = np.bincount((members % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def fold(members: np.ndarray) -> np.ndarray:
    """The parity bitmap on FOLD bytes, as 64-bit words."""
    odd = np.bincount((members % np.uint64(FOLD * 8)).astype(np.int64), minlength=FOLD * 8) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def most_overlap(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> int:
    """An upper bound of the overlap: each differing bit stands for a member of one side only."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return (n_a + n_b - int(np.bitwise_count(a ^ b).sum())) // 2


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part in K.chunks(batch):
            w = K.words(part.column("text"), K.SPACE_WORDS, lower=True)
            yield part, K.row_sets(*K.shingles(w.hash, w.first))


def survey(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text_key, n, class, bits) of each document, and rows (often, times) of shingles that tasks saw often."""
    ids = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def report() -> pa.RecordBatch:
            values, times = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            keep = times >= OFTEN
            n = int(keep.sum())
            held.clear()
            return row(pa.nulls(n, schema[0].type), *[pa.nulls(n, pa.int64())] * 3, pa.nulls(n, pa.binary()), pa.array(values[keep].view(np.int64)), pa.array(times[keep]))

        for part, sets in _sets(batches):
            keys = [class_of(s) if len(s) else None for s in sets]
            n = len(sets)
            schema = part.schema
            row = lambda *c: pa.RecordBatch.from_arrays(list(c), names=["doc_id", "text_key", "n", "class", "bits", "often", "times"])
            yield row(part.column("doc_id"), part.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), pa.array([bitmap(s).tobytes() for s in sets], pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()))
            for s, key in zip(sets, keys):
                if key is not None and key not in seen:
                    seen.add(key)
                    held.append(s)
                    size += len(s)
            if size > 4_000_000:
                yield report()
                size = 0
        if held:
            yield report()

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, f"doc_id {ids}, text_key long, n long, class long, bits binary, often long, times long")


class Order:
    """The common order of shingles: unreported ones first, then by times seen; within that by hash."""

    def __init__(self, often: np.ndarray, times: np.ndarray):
        order = np.argsort(often)
        self.often, self.times = often[order], times[order]

    def seen(self, members: np.ndarray) -> np.ndarray:
        if not len(self.often):
            return np.zeros(len(members), np.int64)
        at = np.minimum(np.searchsorted(self.often, members), len(self.often) - 1)
        return np.where(self.often[at] == members, self.times[at], 0)


class Postings:
    """The short-list postings of classes, packed by range of hashes.

    before: the class's shingle before this one in the common order, 0 for its first.
    left: how many of the class's shingles come from this one on.
    split: the shingles are so frequent that their lists lie in several ranges.
    labels, folds: the components of the classes and their bitmaps folded to FOLD bytes, where components are known.
    """

    SCHEMA = "range int, split boolean, hashes binary, classes binary, sizes binary, befores binary, lefts binary, labels binary, folds binary"

    def __init__(self, ranges: int, percent: int):
        self.ranges, self.percent, self.size = ranges, percent, 0
        self.held: list[tuple[np.ndarray, ...]] = []

    def add(self, key: int, members: np.ndarray, times: np.ndarray, label: int | None = None) -> None:
        first = np.lexsort((K.mix(members), times))[: short_lists(len(members), self.percent)]
        n = len(first)
        # where components are known, a list must be seen whole
        spread = np.maximum(1, -(-times[first] // SPLIT_LIST)) if label is None else np.ones(n, np.int64)
        self.held.append((members[first], np.full(n, key, np.int64).view(np.uint64), spread, np.full(n, len(members), np.uint32), np.concatenate([[_NONE], members[first[:-1]]]), (len(members) - np.arange(n)).astype(np.uint32), np.full(n if label is not None else 0, label or 0, np.int64), np.repeat(fold(members)[None], n if label is not None else 0, axis=0)))
        self.size += n

    def flush(self) -> pa.RecordBatch:
        h, c, s, n, f, m, l, w = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.size = [], 0
        piece = K.mix(c ^ np.uint64(0xA5A5A5A5)) % s.astype(np.uint64)
        at = ((h >> np.uint64(16)) + piece * np.uint64(0x9E3779B1)) % np.uint64(self.ranges) * np.uint64(2) + (s > 1)
        o = np.argsort(at, kind="stable")
        h, c, n, f, m, at, l = h[o], c[o], n[o], f[o], m[o], at[o], l[o] if len(l) else l
        w = w[o] if len(w) else w
        cut = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]])
        some = list(zip(cut, cut[1:]))
        packed = {k: pa.array([x[a:b].tobytes() for a, b in some], pa.binary()) for k, x in (("hashes", h), ("classes", c), ("sizes", n), ("befores", f), ("lefts", m), ("labels", l), ("folds", w))}
        return pa.RecordBatch.from_pydict({"range": pa.array([int(at[a]) // 2 for a, _ in some], pa.int32()), "split": pa.array([bool(at[a] % 2) for a, _ in some]), **packed})


def post(docs: DataFrame, order, ranges: int, percent: int) -> DataFrame:
    """The postings of the classes of all texts, in the common order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        postings = Postings(ranges, percent)
        for _, sets in _sets(batches):
            for s in sets:
                if len(s) and (key := class_of(s)) not in seen:
                    seen.add(key)
                    postings.add(key, s, order.value.seen(s))
            if postings.size > 1_000_000:
                yield postings.flush()
        if postings.held:
            yield postings.flush()

    return docs.select("text").mapInArrow(run, Postings.SCHEMA)


def post_again(sets: DataFrame, ranges: int, percent: int) -> DataFrame:
    """The postings of classes (class, members, label) in the order of the exact counts among themselves.

    All shingles go to ranges of hashes, which count them, and back to their classes.
    """

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                raw = part.column("members").to_pylist()
                h = longs(raw)
                c = np.repeat(part.column("class").to_numpy(), [len(x) // 8 for x in raw])
                at = ((h >> np.uint64(16)) % np.uint64(ranges)).astype(np.int32)
                o = np.argsort(at, kind="stable")
                h, c, at = h[o], c[o], at[o]
                cut = np.flatnonzero(np.diff(at, prepend=-1, append=-1)).tolist()
                yield pa.RecordBatch.from_pydict({"range": pa.array(at[cut[:-1]]), "hashes": pa.array([h[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary()), "classes": pa.array([c[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw: tuple[list[bytes], list[bytes]] = ([], [])
        for batch in batches:
            for held, name in zip(raw, ("hashes", "classes")):
                held += batch.column(name).to_pylist()
        h, c = longs(raw[0]), longs(raw[1]).view(np.int64)
        _, which, counts = np.unique(h, return_inverse=True, return_counts=True)
        o = np.argsort(c, kind="stable")
        h, c, times = h[o], c[o], counts[which][o].astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1], [True]])) if len(c) else np.zeros(1, int)
        for k in range(0, len(cut) - 1, 20_000):
            some = list(zip(cut[k : k + 20_000].tolist(), cut[k + 1 : k + 20_001].tolist()))
            yield pa.RecordBatch.from_pydict({"class": pa.array(c[[a for a, _ in some]]), "hashes": pa.array([h[a:b].tobytes() for a, b in some], pa.binary()), "times": pa.array([times[a:b].tobytes() for a, b in some], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        postings, now, label, hashes, times = Postings(ranges, percent), None, None, [], []

        def add() -> None:
            if hashes:
                postings.add(now, longs(hashes), longs(times).view(np.int64), label)

        for batch in batches:
            for key, h, t, own in zip(*(batch.column(k).to_pylist() for k in ("class", "hashes", "times", "label"))):
                if key != now:
                    add()
                    now, label, hashes, times = key, None, [], []
                if own is not None:
                    label = own
                else:
                    hashes.append(h)
                    times.append(t)
            if postings.size > 1_000_000:
                yield postings.flush()
        add()
        if postings.held:
            yield postings.flush()

    counted = sets.mapInArrow(scatter, "range int, hashes binary, classes binary").repartitionById(ranges, F.col("range")).mapInArrow(count, "class long, hashes binary, times binary")
    rows = counted.unionByName(sets.select("class", "label"), allowMissingColumns=True)
    return rows.repartition(ranges, "class").sortWithinPartitions("class").mapInArrow(run, Postings.SCHEMA)


def merge_lists(posted: DataFrame, ranges: int, percent: int = PERCENT, pair_list: int | None = None) -> DataFrame:
    """Rows (a, b, list): pairs of classes from short lists (list null), and members a of long ones (list: its shingle, b: its first member here).

    Pairs whose sizes alone rule a link out are not made, nor those that share the
    shingle before or have too few shingles left. The first common shingle of two
    classes that link passes all three. Members of a long list that no other one
    can link to from there on are left out.
    """
    pair_list = pair_list or PAIR_LIST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, tuple[list[bytes], ...]] = {k: ([], [], [], [], [], [], []) for k in (False, True)}
        for batch in batches:
            for split, *raw in zip(*(batch.column(k).to_pylist() for k in ("split", "hashes", "classes", "sizes", "befores", "lefts", "labels", "folds"))):
                for x, y in zip(held[split], raw):
                    x.append(y)
        for split, raw in held.items():
            h, c = longs(raw[0]), longs(raw[1]).view(np.int64)
            n, f, m = np.frombuffer(b"".join(raw[2]), "<u4").astype(np.int64), longs(raw[3]), np.frombuffer(b"".join(raw[4]), "<u4").astype(np.int64)
            labels = longs(raw[5]).view(np.int64)
            l = labels if len(labels) else c
            folds = longs(raw[6]).reshape(-1, FOLD // 8)
            for x in raw:
                x.clear()
            o = np.lexsort((c, l, h))
            h, c, n, f, m, l = h[o], c[o], n[o], f[o], m[o], l[o]
            stands = o  # where a posting's bitmap stands
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            h, c, n, f, m, l = h[fresh], c[fresh], n[fresh], f[fresh], m[fresh], l[fresh]
            stands = stands[fresh]

            def fitting(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                """Which pairs can link by their bitmaps: each differing bit stands for a member of one side only."""
                out = np.ones(len(x), bool)
                for k in range(0, len(x) if len(folds) else 0, 100_000):
                    a, b = x[k : k + 100_000], y[k : k + 100_000]
                    apart = np.bitwise_count(folds[stands[a]] ^ folds[stands[b]]).sum(axis=1, dtype=np.int64)
                    out[k : k + 100_000] = (n[a] + n[b] - apart) // 2 >= least_overlap(n[a], n[b], percent)
                return out

            cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]])) if len(h) else np.zeros(1, int)
            size, at = np.diff(cut), cut[:-1]
            # members stand by component; each is paired with all of the list that come after its own
            run = np.ones(len(h), bool)
            run[1:] = (h[1:] != h[:-1]) | (l[1:] != l[:-1])
            ends = np.append(np.flatnonzero(run)[1:], len(h))[np.cumsum(run) - 1] if len(h) else np.zeros(0, int)
            after = np.repeat(cut[1:], size) - ends
            all_ = np.add.reduceat(after, at) if len(at) else size
            short = (all_ <= pair_list * size // (2 if l is c else 1)) & (all_ > 0) & (not split)
            whose = np.flatnonzero(short[np.repeat(np.arange(len(size)), size)] & (after > 0))
            pairs: list[np.ndarray] = []
            for some in np.split(whose, np.flatnonzero(np.diff(np.cumsum(after[whose]) // 2_000_000)) + 1) if len(whose) else ():
                x = np.repeat(some, after[some])
                y = np.repeat(ends[some], after[some]) + np.arange(len(x)) - np.repeat(np.cumsum(after[some]) - after[some], after[some])
                fits = (np.minimum(m[x], m[y]) >= least_overlap(n[x], n[y], percent)) & ((f[x] != f[y]) | (f[x] == _NONE))
                x, y = x[fits], y[fits]
                close = fitting(x, y)
                x, y = x[close], y[close]
                pairs.append(np.stack([np.minimum(c[x], c[y]), np.maximum(c[x], c[y])], axis=1))
                if sum(map(len, pairs)) > 2_000_000:
                    yield from _pair_rows(pairs)
                    pairs = []
            for k in np.flatnonzero(~short & (all_ > 0) | (split & (size > 0))):
                own = slice(at[k], at[k] + size[k])
                members = c[own] if split else c[own][_wanted(n[own], m[own], percent)]
                if len(members) > 1 or split:
                    # some members stand for the list, or for its largest components
                    own_labels, place = np.unique(l[own], return_inverse=True)
                    by_hash = np.argsort(K.mix(c[own].view(np.uint64)), kind="stable")
                    if l is c:
                        heads = c[own][by_hash[:HEADS]]
                    else:
                        _, firsts = np.unique(place[by_hash], return_index=True)
                        heads = c[own][by_hash[firsts]][np.argsort(-np.bincount(place), kind="stable")[:HEADS]]
                    x, y = np.tile(members, len(heads)), np.repeat(heads, len(members))
                    pairs.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1)[x != y])
                    if sum(map(len, pairs)) > 2_000_000:
                        yield from _pair_rows(pairs)
                        pairs = []
                    yield pa.RecordBatch.from_pydict({"a": pa.array(members), "b": pa.array(np.full(len(members), members[0])), "list": pa.array(np.full(len(members), h[at[k]].view(np.int64)))})
            yield from _pair_rows(pairs)

    return posted.repartitionById(ranges, F.col("range")).mapInArrow(run, "a long, b long, list long")


def _pair_rows(pairs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    both = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
    both = np.unique(np.ascontiguousarray(both).view([("a", np.int64), ("b", np.int64)]).ravel()) if len(both) else np.zeros(0, [("a", np.int64), ("b", np.int64)])
    for k in range(0, len(both), 100_000):
        some = both[k : k + 100_000]
        yield pa.RecordBatch.from_pydict({"a": pa.array(some["a"].copy()), "b": pa.array(some["b"].copy()), "list": pa.nulls(len(some), pa.int64())})


def _wanted(n: np.ndarray, left: np.ndarray, percent: int) -> np.ndarray:
    """Which members of a list have another one there that they can link to, by sizes n and shingles left from the list's on.

    Members a and b can if least_overlap(a, b) is no more than what either has left,
    so if b has no more than `most` shingles, and a no more than b allows.
    """
    most = left * (100 + percent) // percent - n
    order = np.argsort(n, kind="stable")
    n, most = n[order], most[order]
    upto = np.searchsorted(n, most, side="right")  # partners small enough: the first so many
    # the two largest allowances among them, as one may be the member's own
    place = np.arange(len(n))
    best = np.maximum.accumulate(most)
    is_new = np.concatenate([[True], most[1:] > best[:-1]])
    holder = np.maximum.accumulate(np.where(is_new, place, 0))
    second = np.full(len(n), np.iinfo(np.int64).min)
    first_two = [np.iinfo(np.int64).min] * 2
    for i, x in enumerate(most.tolist()):
        if x > first_two[0]:
            first_two = [x, first_two[0]]
        elif x > first_two[1]:
            first_two[1] = x
        second[i] = first_two[1]
    last = np.maximum(upto - 1, 0)
    allows = np.where(holder[last] == place, second[last], best[last])
    out = np.zeros(len(n), bool)
    out[order] = (upto > 0) & (allows >= n)
    return out


def _plausible(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
        need = least_overlap(n_a, n_b, percent)
        keep = np.minimum(n_a, n_b) >= need
        bits_a, bits_b = batch.column("bits_a"), batch.column("bits_b")
        for i in np.flatnonzero(keep):
            a, b = (np.frombuffer(x[int(i)].as_buffer(), np.uint8) for x in (bits_a, bits_b))
            keep[i] = most_overlap(a, b, int(n_a[i]), int(n_b[i])) >= need[i]
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def t_occurrence(queries: list[np.ndarray], partners: list[np.ndarray], query: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which partners reach the required overlap with their query; `query` has the number of each partner's.

    The partners of a query are indexed by its members. Of these inverted lists L
    long ones are set aside. The short ones are merged, for all queries at once, by
    counting; a partner that occurs T - L times in them is probed in each long list
    by binary search.
    """
    n_q, n_p = (np.array([len(x) for x in some], np.int64) for some in (queries, partners))
    if not len(partners) or not n_q.sum():
        return np.zeros(len(partners), bool)
    need = least_overlap(n_q[query], n_p, percent)
    possible = need <= np.minimum(n_q[query], n_p)
    # lists are numbered as the members of the queries stand in a row
    salt = np.uint64(0x9E3779B97F4A7C15)
    of = np.repeat(np.arange(len(queries)), n_q)
    keys = K.mix(np.concatenate(queries) ^ (of.astype(np.uint64) * salt))
    order = np.argsort(keys)
    keys = keys[order]
    owner = np.repeat(np.arange(len(partners)), n_p)
    wanted = K.mix(np.concatenate(partners) ^ (query[owner].astype(np.uint64) * salt))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    has = keys[at] == wanted
    lists, owner = order[at[has]], owner[has]
    size = np.bincount(lists, minlength=len(of))

    least = np.full(len(queries), np.iinfo(np.int64).max)
    np.minimum.at(least, query[possible], need[possible])
    longest = np.zeros(len(queries), np.int64)
    np.maximum.at(longest, of, size)
    aside = np.minimum(least - 1, np.maximum(1, (np.minimum(least, 1 << 40) / (0.01 * np.log2(longest + 1) + 1)).astype(np.int64)))
    by_size = np.lexsort((-size, of))
    rank = np.empty(len(of), np.int64)
    rank[by_size] = np.arange(len(of)) - (np.cumsum(n_q) - n_q)[of]
    long_ = rank < aside[of]

    short = ~long_[lists]
    times = np.bincount(owner[short], minlength=len(partners))
    left = np.flatnonzero(possible & (times >= need - aside[query]))
    postings = np.sort(lists[~short] * len(partners) + owner[~short])
    some = np.flatnonzero(long_)
    count = np.bincount(of[some], minlength=len(queries))
    first, probes = (np.cumsum(count) - count)[query[left]], count[query[left]]
    probe = some[np.repeat(first, probes) + np.arange(int(probes.sum())) - np.repeat(np.cumsum(probes) - probes, probes)] if len(some) else some
    who = np.repeat(left, probes)
    asked = probe * len(partners) + who
    at = np.minimum(np.searchsorted(postings, asked), max(len(postings) - 1, 0))
    times += np.bincount(who[postings[at] == asked], minlength=len(partners)) if len(postings) else 0
    out = np.zeros(len(partners), bool)
    out[left] = times[left] >= need[left]
    return out


def divide_skip(query: np.ndarray, others: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """Which of the other sets reach the required overlap with the query."""
    return np.flatnonzero(t_occurrence([query], others, np.zeros(len(others), np.int64), percent)).tolist()


def _set_rows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, members) of the wanted (class, doc), each once; several texts may share an id, only one with the class answers.

    wanted may have other columns, which are carried along.
    """
    rows = docs.select(F.col("doc_id").alias("_id"), "text").join(narrow(wanted), F.col("_id").eqNullSafe(F.col("doc")))
    keep = [f for f in rows.schema if f.name not in ("_id", "doc", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches):
            right = pa.array([len(s) > 0 and class_of(s) == k for s, k in zip(sets, part.column("class").to_pylist())])
            out = pa.RecordBatch.from_pydict({f.name: part.column(f.name) for f in keep} | {"members": pa.array([s.tobytes() for s in sets], pa.binary())})
            yield out.filter(right)

    return rows.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["members binary"]))


def verify(pairs: DataFrame, classes: DataFrame, fetch, percent: int) -> DataFrame:
    """The pairs (a, b) that link. Partners go to class a in groups; a's own set goes to each group.

    fetch: gives rows of (class, doc, groups) their members. A class is fetched once,
    with all groups of up to GROUP that it goes to at a time.
    """
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    grouped = pairs.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    group = F.struct("a", "part")
    goes = grouped.select(F.col("b").alias("class"), group.alias("group")).unionByName(grouped.select(F.col("a").alias("class"), group.alias("group")).distinct())
    lists = goes.groupBy("class", F.pmod(F.xxhash64("group"), F.lit(256)).alias("some")).agg(F.collect_list("group").alias("groups"))
    rows = fetch(stored(lists.join(classes.select("class", "doc"), "class").select("class", "doc", "groups"), "partners"))
    rows = rows.select("class", "members", F.explode("groups").alias("g")).select("g.a", "g.part", "class", "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, names, partners, others, query, size, group = [], [], [], [], [], 0, None

        def answer() -> pa.RecordBatch:
            found = np.flatnonzero(t_occurrence(queries, partners, np.array(query, np.int64), percent))
            return pa.RecordBatch.from_pydict({"a": pa.array([names[query[i]] for i in found], pa.int64()), "b": pa.array([others[i] for i in found], pa.int64())})

        for batch in batches:
            for a, part, key, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "class", "members"))):
                if group != (a, part):
                    if size > SEARCHED:
                        yield answer()
                        queries, names, partners, others, query, size = [], [], [], [], [], 0
                    group = (a, part)
                    queries.append(np.zeros(0, np.uint64))
                    names.append(a)
                members = np.frombuffer(raw, "<u8")
                if key == a:
                    queries[-1] = members
                else:
                    partners.append(members)
                    others.append(key)
                    query.append(len(queries) - 1)
                    size += len(members)
        if partners:
            yield answer()

    dealt = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("class") != F.col("a"))
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _search(merged: DataFrame, classes: DataFrame, fetch, percent: int) -> DataFrame:
    """Links (a, b) among the pairs of short lists and of members of long ones with the first member."""
    heads = merged.where(F.col("list").isNotNull()).select("list", "b").distinct()
    first = heads.groupBy("list").agg(F.min("b").alias("a"))
    pairs = merged.select("a", "b").unionByName(heads.join(first, "list").select("a", "b")).where(F.col("a") != F.col("b"))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda x: classes.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    judged = pairs.join(side("a"), "a").join(side("b"), "b")
    close = stored(judged.mapInArrow(lambda batches: _plausible(batches, percent), "a long, b long"), "pairs")
    links = stored(verify(close, classes, fetch, percent), "links")
    drop_stored(close)
    return links


def _open_members(merged: DataFrame, labels: DataFrame) -> DataFrame:
    """(class, label) of long lists whose members lie in several components."""
    long_lists = merged.where(F.col("list").isNotNull()).select("list", F.col("a").alias("class")).distinct()
    named = long_lists.join(labels.withColumnRenamed("node", "class"), "class", "left").select("list", "class", F.coalesce("label", "class").alias("label"))
    several = named.groupBy("list").agg(F.min("label").alias("x"), F.max("label").alias("y")).where(F.col("x") != F.col("y")).select("list")
    return named.join(several, "list").select("class", "label").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document row."""
    return with_components(docs, percent).select("doc_id", "n_shingles", "component_id")


def with_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, component) of every document row.

    text_key tells the texts of one id apart, component (null for rows without shingles) the components.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    surveyed = stored(survey(docs), "survey")
    base = surveyed.where(F.col("n").isNotNull()).select("doc_id", "text_key", "n", "class", "bits")
    classes = stored(base.where(F.col("class").isNotNull()).groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("doc"), "n", "bits")).alias("s")).select("class", "s.doc", "s.n", "s.bits"), "classes")

    often = surveyed.where(F.col("often").isNotNull()).groupBy("often").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "often").limit(ORDER_ROWS).toArrow()
    order = spark.sparkContext.broadcast(Order(often.column(0).to_numpy().view(np.uint64), often.column(1).to_numpy()))  # ORDER_ROWS at most
    total = classes.agg(F.sum(F.ceil(F.col("n") * (100 - percent) / 100) + 1)).first()[0] or 0
    # by the postings alone: the pairs of two classes that meet in several lists are made once a range
    ranges = max(1, -(-int(total) // RANGE_POSTINGS))
    merged = stored(merge_lists(post(docs, order, ranges, percent), ranges, percent), "lists")

    links = _search(merged, classes, lambda wanted: _set_rows(docs, wanted), percent)
    labels = components(links, "a", "b")

    pair_list = PAIR_LIST
    while not (open_ := stored(_open_members(merged, labels), "open-members")).isEmpty():
        known = classes.join(narrow(open_), "class")
        done = merged, links
        sets = stored(_set_rows(docs, known.select("class", "label", "doc")).dropDuplicates(["class"]), "open-sets")
        pair_list *= 2
        # as many ranges as these few members need: a class sends a row to each
        some = max(1, (known.agg(F.sum("n")).first()[0] or 0) // RANGE_POSTINGS)
        merged = stored(merge_lists(post_again(sets, some, percent), some, percent, pair_list), "lists")
        links = stored(links.unionByName(_search(merged, known, lambda wanted, sets=sets: wanted.join(sets.drop("label"), "class"), percent)), "links")
        labels = components(links, "a", "b")
        drop_stored(*done, sets)

    labelled = classes.select("class", "doc").join(labels.withColumnRenamed("node", "class"), "class", "left").select("class", "doc", F.coalesce("label", "class").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("doc").alias("component"))
    by_class = stored(labelled.join(smallest, "label").select("class", "component", "label"), "components")
    return base.join(by_class, "class", "left").select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.col("label").alias("component"))


def keep_first(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component, that of the smallest id, with all its columns.

    Rows are told apart by id and text: of several texts of that id one stays, and of
    rows of one id and text the one with the least other columns. Rows without an id
    go if their component has one, else all stay.
    """
    found = stored(with_components(docs, percent).select("doc_id", "text_key", "component_id", "component"), "near-duplicates")
    same = F.col("doc_id").eqNullSafe(F.col("component_id"))
    firsts = found.where(same & F.col("doc_id").isNotNull() & F.col("component").isNotNull())
    several = stored(firsts.groupBy("doc_id", "component").agg(F.count("*").alias("rows"), F.min("text_key").alias("stays")).where("rows > 1"), "several-rows")
    other_texts = firsts.join(several, ["doc_id", "component"]).where(F.col("text_key") != F.col("stays")).select("doc_id", "text_key")
    id_, key = (free_name(x, docs.columns) for x in ("gone_id", "gone_text"))
    on = F.col("doc_id").eqNullSafe(F.col(id_)) & F.xxhash64("text").eqNullSafe(F.col(key))
    gone = stored(found.where(~same).select("doc_id", "text_key").unionByName(other_texts).distinct().toDF(id_, key), "gone")
    left = docs.join(narrow(gone), on, "left_anti")
    if several.isEmpty():
        return left
    again = narrow(several.select(F.col("doc_id").alias(id_), F.col("stays").alias(key)))
    rest = free_name("rest", docs.columns)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    # maps have no order, but their JSON has
    by = F.struct(*[F.to_json(F.struct(f"`{c}`")) if "map<" in docs.schema[c].dataType.simpleString() else F.col(f"`{c}`") for c in others] or [F.lit(0)])
    rows = left.join(again, on, "left_semi").groupBy("doc_id", "text").agg(F.min_by(F.struct(*[f"`{c}`" for c in others] or [F.lit(0).alias("none")]), by).alias(rest))
    once = rows.select("doc_id", "text", *[F.col(rest)[c].alias(c) for c in others]).select(*[f"`{c}`" for c in docs.columns])
    return left.join(again, on, "left_anti").unionByName(once)
