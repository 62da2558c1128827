"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search walks over the signs of a text. At each place it keeps the best way to
get there as one backpointer; only places within the longest piece can still be
continued, so the window has that length. Whenever all backpointer paths from the
window meet in one boundary, the pieces before it are fixed and leave memory.

Two kinds of model files exist, and both give the library's own ids:

* unigram: a path's worth is the sum of its pieces' scores, unknown signs cost the
  lowest score less 10;
* BPE: a piece may follow another only if merging the two pieces' signs by rank
  gives just these two pieces again. Greedy merging of any prefix ends in exactly
  one piece that is allowed so, hence exactly one path survives at each place, and
  it is the greedy merging.

No piece has the space sign after another sign, so all paths meet before each space,
and what lies between is searched as a word of its own. The new words of a part of a
table are searched at once, sign by sign: places that words share, their common
beginnings, are one, and numpy looks at all places of one distance from the start
together. Words that were searched are kept in a bounded cache.

Null text counts as empty and has no ids. Unknown signs become byte pieces, so
decoding gives back the normalised text. Repeated rows are encoded each for
itself; extra columns are carried along.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import textkit as K

SPACE = "▁"
CACHE = 240_000  # words held while a task runs
PAIRS = 600_000  # pairs of pieces held in a worker
FEW, LONG = 32, 64  # of the words over LONG signs, the FEW longest are searched one by one
COMMIT_EVERY = 64  # signs between looks for a boundary where all paths meet
PART_BYTES = 1 << 20  # text whose new words are searched together
_UNKNOWN_COST = 10.0


class Trie:
    """The pieces as a trie. Edges stand sorted by state and sign; `piece` has the id of the piece that ends in a state, or -1."""

    def __init__(self, ids: dict[str, int]):
        step, piece = {}, [-1]
        for text, i in ids.items():
            at = 0
            for sign in text:
                key = at << 21 | ord(sign)
                if (to := step.get(key)) is None:
                    to = step[key] = len(piece)
                    piece.append(-1)
                at = to
            piece[at] = i
        keys = np.fromiter(step.keys(), np.int64, len(step))
        order = np.argsort(keys)
        self.keys, self.to, self.piece = keys[order], np.fromiter(step.values(), np.int64, len(step))[order], np.array(piece)

    def next(self, states: np.ndarray, signs: np.ndarray) -> np.ndarray:
        """Where each state goes with a sign; -1 for nowhere."""
        want = states << 21 | signs
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.to[at], -1)


class Following:
    """Which pairs of pieces may follow one another, as far as that was asked; pairs are numbers."""

    def __init__(self, may_follow):
        self.may_follow = may_follow
        self.known, self.fresh = ((np.zeros(0, np.int64), np.zeros(0, bool)) for _ in range(2))

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = table
        if not len(keys):
            return np.zeros(len(pairs), bool), np.zeros(len(pairs), bool)
        at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
        return keys[at] == pairs, values[at]

    @staticmethod
    def _with(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = np.concatenate([table[0], keys]), np.concatenate([table[1], values])
        order = np.argsort(keys, kind="stable")
        return keys[order], values[order]

    def settle(self) -> None:
        """New answers join the known ones; beyond PAIRS all are forgotten."""
        self.known = self._with(self.known, *self.fresh) if len(self.known[0]) + len(self.fresh[0]) <= PAIRS else self.fresh
        self.fresh = (np.zeros(0, np.int64), np.zeros(0, bool))

    def __call__(self, pairs: np.ndarray) -> np.ndarray:
        seen, out = self._find(self.known, pairs)
        for table_is_new in (False, True):
            rest = np.flatnonzero(~seen)
            if not len(rest):
                break
            if table_is_new:
                asked = np.unique(pairs[rest])
                self.fresh = self._with(self.fresh, asked, self.may_follow(asked))
            seen[rest], out[rest] = self._find(self.fresh, pairs[rest])
        return out & seen


class SentencePieces:
    def __init__(self, path: str, cache: int = CACHE):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.pieces = [self.model.id_to_piece(i) for i in range(size)]
        normal = [i for i in range(size) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in normal}
        self.scores = {self.pieces[i]: self.model.get_score(i) for i in normal}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(size) if self.model.is_byte(i)}
        self.unknown = self.model.unk_id()
        self.longest = max(map(len, self.ids))
        self.unigram = model_kind(path) == 1
        self.floor = min(self.scores.values(), default=0.0) - _UNKNOWN_COST
        self.words_split = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.chunk = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self._limit, self._apart = cache, {}
        # ids of words as bytes, in two generations: what is not used again leaves with the older one
        self._words: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._prepare()
        self._trie = Trie(self.ids)
        self._score = np.full(size, self.floor)
        self._score[list(self.ids.values())] = list(self.scores.values())
        self._follows = Following(self._may_follow)
        self._merging()

    def release(self) -> None:
        """Gives back the memory of words; which pieces may follow which stays known."""
        self._words, self._old = {}, {}

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; their new words are searched together."""
        normal = [self.model.normalize(x) for x in texts]
        parts = [self.chunk(x) if self.words_split else [x] * bool(x) for x in normal]
        words, old = self._words, self._old
        needed = set().union(*parts)
        new = []
        for word in needed - words.keys():
            if (ids := old.get(word)) is None:
                new.append(word)
            else:
                words[word] = ids
        for word, runs in self.search_words(new):
            words[word] = runs[0] if len(runs) == 1 else b"".join(runs)
        self._follows.settle()
        out = [np.frombuffer(b"".join(map(words.__getitem__, x)), "<i4") for x in parts]
        if len(words) >= self._limit // 2:
            self._old, self._words = {w: i for w, i in words.items() if len(w) <= 64}, {}
        return out

    def _unknown_ids(self, signs: str) -> list[int]:
        return [self.bytes[x] for x in signs.encode()] if self.bytes else [self.unknown]

    def search(self, text: str) -> list[np.ndarray]:
        """Runs of ids, each fixed as soon as all surviving paths agreed on it."""
        return [np.frombuffer(run, "<i4") for _, runs in self.search_words([text]) for run in runs]

    def search_words(self, words: list[str]) -> Iterator[tuple[str, list[bytes]]]:
        """Each distinct word with its runs of ids, as soon as its end is reached.

        All words are at the same distance from their start. Numbers of places grow
        with that distance; the held ones begin with `base`. A place has the place
        before its last piece, that piece and, for unigram models, its worth. What
        may go on from a place are candidates: the place where a piece would begin,
        its last piece and worth, and the state of the trie.
        """
        words = set(words)
        alone = heapq.nlargest(FEW, (w for w in words if len(w) > LONG), key=len)
        for word in alone:
            yield word, list(self._search_alone(word))
        words = sorted(words.difference(alone))
        length = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        first = np.cumsum(length) - length
        runs: dict[int, list[bytes]] = {}
        start = np.zeros(len(words), np.int64)  # the place from which a word's ids are still to come
        yield from (("", []) for w in words if not w)
        live = np.flatnonzero(length > 0)
        node = np.zeros(len(live), np.int64)  # of each living word, among the places of this distance
        held, base, total = [(np.zeros(1, np.int64), np.full(1, -1), np.zeros(1))], 0, 1
        begin, left, value, state, owner = (np.zeros(0, x) for x in (np.int64, np.int64, float, np.int64, np.int64))
        far = 0
        while len(live):
            sign, far = flat[first[live] + far], far + 1
            new = np.ones(len(live), bool)
            new[1:] = (node[1:] != node[:-1]) | (sign[1:] != sign[:-1])
            parent, here = node[new], sign[new]
            node = np.cumsum(new) - 1
            before = total - len(held[-1][0])  # number of the first place of the distance before
            # candidates go on into each place that comes after theirs
            sizes = np.bincount(owner, minlength=len(held[-1][0]))
            starts = np.cumsum(sizes) - sizes
            times = sizes[parent]
            which = np.repeat(starts[parent], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            owner = np.concatenate([np.repeat(np.arange(len(parent)), times), np.arange(len(parent))])
            begin = np.concatenate([begin[which], before + parent])
            left = np.concatenate([left[which], held[-1][1][parent]])
            value = np.concatenate([value[which], held[-1][2][parent]])
            state = self._trie.next(np.concatenate([state[which], np.zeros(len(parent), np.int64)]), here[owner])
            alive = np.flatnonzero(state >= 0)
            alive = alive[np.lexsort((begin[alive], owner[alive]))]
            begin, left, value, state, owner = begin[alive], left[alive], value[alive], state[alive], owner[alive]

            # an unknown sign, or one that nothing else allows, is a piece of its own
            known = self._trie.next(np.zeros(len(here), np.int64), here)
            piece = np.where(known >= 0, self._trie.piece[known], -1)
            back, last = before + parent, np.where(piece >= 0, piece, len(self.pieces) + here)
            worth = held[-1][2][parent] + self.floor
            ends = np.flatnonzero(self._trie.piece[state] >= 0)
            found = self._trie.piece[state[ends]]
            if self.unigram:
                at, gain = owner[ends], value[ends] + self._score[found]
                order = np.lexsort((begin[ends], -gain, at))
                at, gain, found, from_ = at[order], gain[order], found[order], begin[ends][order]
                best = np.flatnonzero(np.diff(at, prepend=-1))
                best = best[(gain[best] > worth[at[best]]) | (piece[at[best]] >= 0)]
                back[at[best]], last[at[best]], worth[at[best]] = from_[best], found[best], gain[best]
            else:
                allowed = ends[self._follows((left[ends] + 1) * len(self.pieces) + found)]
                at = owner[allowed]
                best = np.flatnonzero(np.diff(at, prepend=-1))
                back[at[best]], last[at[best]] = begin[allowed[best]], self._trie.piece[state[allowed[best]]]
            held.append((back, last, worth))
            now, total = total, total + len(back)

            over = length[live] == far
            commit = far % COMMIT_EVERY == 0
            if over.any() or commit:
                places = [np.concatenate([h[k] for h in held]) for k in (0, 1)]
            for w, ids in self._paths(places, base, live[over], now + node[over], start) if over.any() else ():
                yield words[w], [*runs.pop(w, []), ids]
            live, node = live[~over], node[~over]
            if commit and len(live):
                meet = self._meeting(places[0], base, now + np.arange(len(back)), owner, begin)[node]
                for w, ids in self._paths(places, base, live, meet, start):
                    if ids:
                        runs.setdefault(w, []).append(ids)
                start[live] = meet
                while base + len(held[0][0]) <= meet.min() and len(held) > 1:
                    base += len(held.pop(0)[0])

    def _search_alone(self, text: str) -> Iterator[bytes]:
        """The runs of one word: the same places, candidates and boundaries, without numpy."""
        base, back, worth, last, size = 0, [0], [0.0], [-1], len(self.pieces)
        for end in range(1, len(text) + 1):
            best, at, found = None, end - 1, self.ids.get(text[end - 1], size + ord(text[end - 1]))
            for begin in range(max(base, end - self.longest), end):
                piece = self.ids.get(text[begin:end])
                if piece is None:
                    continue
                if self.unigram:
                    gain = worth[begin - base] + self._score[piece]
                    if best is None or gain > best:
                        best, at, found = gain, begin, piece
                elif self._stay_apart((last[begin - base] + 1) * size + piece):
                    at, found = begin, piece
                    break
            back.append(at)
            last.append(found)
            worth.append(worth[end - 1 - base] + self.floor if best is None else best)
            if end % COMMIT_EVERY == 0 or end == len(text):
                open_ = {end} if end == len(text) else set(range(max(base, end - self.longest + 1), end + 1))
                while len(open_) > 1:
                    far = max(open_)
                    open_.discard(far)
                    open_.add(max(back[far - base], base))
                if (meet := open_.pop()) > base:
                    places = [np.array(back) - base, np.array(last)]
                    yield from (ids for _, ids in self._paths(places, 0, np.zeros(1, np.int64), np.array([meet - base]), np.zeros(1, np.int64)))
                    for held in (back, worth, last):
                        del held[: meet - base]
                    base = meet

    def _paths(self, places: list[np.ndarray], base: int, words: np.ndarray, at: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """The ids on the way from each word's start to a place."""
        back, last = places
        whose, found, at, left = [], [], at.copy(), np.arange(len(words))
        while len(left := left[at[left] > start[words[left]]]):
            whose.append(left)
            found.append(last[at[left] - base])
            at[left] = back[at[left] - base]
        whose, found = (np.concatenate(x[::-1]) if x else np.zeros(0, np.int64) for x in (whose, found))
        order = np.argsort(whose, kind="stable")
        ids, cuts = found[order], np.cumsum(np.bincount(whose, minlength=len(words)))
        strange = ids >= len(self.pieces)
        with_strange = set(whose[order][strange].tolist())
        packed = ids.astype("<i4").tobytes()
        for k, (w, a, b) in enumerate(zip(words.tolist(), [0, *cuts.tolist()], cuts.tolist())):
            if k in with_strange:
                out: list[int] = []
                for i in ids[a:b].tolist():
                    if i < len(self.pieces):
                        out.append(i)
                    elif self.bytes or not out or out[-1] != self.unknown:
                        out += self._unknown_ids(chr(i - len(self.pieces)))
                yield w, array("i", out).tobytes()
            else:
                yield w, packed[4 * a : 4 * b]

    def _meeting(self, back: np.ndarray, base: int, places: np.ndarray, owner: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """For each place, the last boundary that all paths which can still go on there share: its own and its candidates'."""
        whose, at = np.concatenate([np.arange(len(places)), owner]), np.concatenate([places, begin])
        order = np.argsort(whose, kind="stable")
        whose, at = whose[order], at[order]
        cuts = np.flatnonzero(np.diff(whose, prepend=-1))
        while True:
            high, low = np.maximum.reduceat(at, cuts), np.minimum.reduceat(at, cuts)
            move = (at == high[whose]) & (high > low)[whose]
            if not move.any():
                return low
            at = np.where(move, np.maximum(back[at - base], base), at)

    def _merging(self) -> None:
        """What the last merge of each piece joins, its rank, and which pairs of pieces make a piece.

        A piece that merging by rank does not arrive at has no rank. Signs were never merged.
        """
        n, score, ids = len(self.pieces), self.scores.get, self.ids
        self._rank, self._parts = np.full(n, np.inf), np.full((n, 2), -1)
        pairs: dict[int, int] = {}
        for text, i in ids.items():
            signs, joined = list(text), None
            while len(signs) > 1 and (at := self._next_merge(signs)) >= 0:
                joined = signs[at], signs[at + 1]
                signs[at : at + 2] = [signs[at] + signs[at + 1]]
            if len(signs) == 1:
                self._rank[i] = -score(text) if joined else -np.inf
                if joined:
                    self._parts[i] = ids.get(joined[0], -1), ids.get(joined[1], -1)
            for cut in range(1, len(text)):
                a, b = ids.get(text[:cut]), ids.get(text[cut:])
                if a is not None and b is not None:
                    pairs[a * n + b] = i
        keys = np.array(sorted(pairs), np.int64)
        self._pairs = keys, np.array([pairs[k] for k in keys.tolist()], np.int64)
        # pieces with parts of a worse rank than the whole, and what they are parts of
        self._odd = np.zeros(n, bool)
        for i in sorted(ids.values(), key=lambda i: len(self.pieces[i])):
            parts = self._parts[i]
            self._odd[i] = parts[0] >= 0 and (self._odd[parts].any() or (self._rank[parts] >= self._rank[i]).any()) or self._rank[i] == np.inf

    def _may_follow(self, pairs: np.ndarray) -> np.ndarray:
        """Whether merging by rank turns two pieces' signs into just these two pieces; the left one may be missing, at the start.

        Goes back in time: the later of the two pieces at the border is split, until
        both are signs. The pieces stay apart unless, at some time, the two at the
        border make a piece of a better rank than the merges that they go on into.
        Parts of a piece have a better rank than the piece; of equal merges the left one is
        first. Pairs with one of the few pieces of which that is not true are merged instead.
        """
        n = len(self.pieces)
        a, b = pairs // n - 1, pairs % n
        rank = np.append(self._rank, -np.inf)  # the last for signs that are no piece, which never merge
        alone, a = a < 0, np.where(a < n, a, n)
        apart = (rank[b] < np.inf) & (alone | (rank[a] < np.inf))
        live = np.flatnonzero(apart & ~alone & (a < n))
        a, b = a[live], b[live]
        after_a, after_b = np.full(len(live), np.inf), np.full(len(live), np.inf)
        keys, made = self._pairs
        while len(live):
            want = a * n + b
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            whole = np.where(keys[at] == want, -self._score[made[at]], np.inf) if len(keys) else np.full(len(want), np.inf)
            cross = (whole < after_a) & (whole <= after_b) & np.isfinite(whole)
            apart[live[cross]] = False
            later_a = rank[a] > rank[b]
            go = ~cross & (np.isfinite(rank[a]) | np.isfinite(rank[b]))
            live, a, b, after_a, after_b, later_a = (x[go] for x in (live, a, b, after_a, after_b, later_a))
            after_a, after_b = np.where(later_a, rank[a], after_a), np.where(later_a, after_b, rank[b])
            a, b = np.where(later_a, self._parts[a, 1], a), np.where(later_a, b, self._parts[b, 0])
        odd = np.append(self._odd, False)
        a, b = pairs // n - 1, pairs % n
        for k in np.flatnonzero(odd[b] | (a >= 0) & odd[np.clip(a, 0, n)]):
            apart[k] = self._stay_apart(int(pairs[k]))
        return apart

    def _stay_apart(self, pair: int) -> bool:
        """_may_follow of one pair, by merging."""
        if (known := self._apart.get(pair)) is not None:
            return known
        if len(self._apart) >= PAIRS // 4:
            self._apart.clear()
        left, right = pair // len(self.pieces) - 1, self.pieces[pair % len(self.pieces)]
        left = "" if left < 0 else self.pieces[left] if left < len(self.pieces) else chr(left - len(self.pieces))
        signs, border = list(left + right), len(left)
        while len(signs) > 1 and (at := self._next_merge(signs)) >= 0:
            if at == border - 1:  # signs of both pieces would merge
                signs = []
                break
            signs[at : at + 2] = [signs[at] + signs[at + 1]]
            border -= at < border
        self._apart[pair] = found = signs == ([left, right] if left else [right])
        return found

    def _next_merge(self, signs: list[str]) -> int:
        """Where the best pair of neighbours stands, of equal ones the first; -1 if none makes a piece."""
        best, at = None, -1
        for k, value in enumerate(map(self.scores.get, map(str.__add__, signs, signs[1:]))):
            if value is not None and (best is None or value > best):
                best, at = value, k
        return at

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; control pieces are left out, unknown ones are shown as the library shows them."""
        texts = self._texts
        out = "".join([texts[i] for i in ids.tolist()])
        if self._has_bytes(out):
            out = _BYTE_RUN.sub(lambda m: bytes(ord(c) - 0xF0000 for c in m[0]).decode("utf-8", "replace"), out)
        return out[1:] if self._dummy and out.startswith(" ") else out

    def _prepare(self) -> None:
        special = {i: "" for i in range(len(self.pieces)) if self.model.is_control(i)} | {self.unknown: " \u2047 "}
        by_byte = {i: chr(0xF0000 + b) for b, i in self.bytes.items()}
        self._texts = [special.get(i, by_byte.get(i, p.replace(SPACE, " "))) for i, p in enumerate(self.pieces)]
        self._dummy = self.model.normalize("a").startswith(SPACE)
        self._has_bytes = _BYTE_RUN.search


_BYTE_RUN = re.compile("[\U000F0000-\U000F00FF]+")


def model_kind(path: str) -> int:
    """trainer_spec.model_type of a model file: 1 unigram, 2 BPE."""
    with open(path, "rb") as f:
        return next((v for k, v in _fields(next((v for k, v in _fields(f.read()) if k == 2), b"")) if k == 3), 1)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol-buffer message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = number(at)
        if tag & 7 == 0:
            value, at = number(at)
        elif tag & 7 == 2:
            size, at = number(at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if tag & 7 == 1 else 4
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


_LOADED: dict[str, SentencePieces] = {}


def loaded(path: str) -> SentencePieces:
    """One model in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = SentencePieces(path)
    return _LOADED[path]


def encode_pieces(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """Every row with ids and n_ids of its whole text. keep: columns to carry along, by default doc_id."""
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in ("ids", "n_ids")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in batches:
            for part in K.chunks(batch, size=PART_BYTES):
                ids = model.encode_all([x or "" for x in part.column("text").to_pylist()])
                n = np.array([len(x) for x in ids], np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in keep} | {"ids": flat, "n_ids": pa.array(n)})
        model.release()

    frame = docs.select(*dict.fromkeys([*keep, "text"]))
    return frame.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name in keep] + ["ids array<int>", "n_ids long"]))


def decode_pieces(encoded: DataFrame, path: str, into: str = "decoded") -> DataFrame:
    """Every row with the text of its ids beside its other columns; null ids give null."""
    keep = [c for c in encoded.columns if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ids = part.column("ids")
                texts = [model.decode(x.values.to_numpy()) if x.is_valid else None for x in ids]
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in keep} | {into: pa.array(texts, pa.string())})

    frame = encoded.select(*keep)
    return frame.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema] + [f"{into} string"]))
