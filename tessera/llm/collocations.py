"""Phrase collocation mining by pivot partitioning.

A phrase is a run of two or three words inside a piece of a text. Each occurrence
of a phrase belongs to its rarest word, the pivot (the first of equal ones).
Words are counted first. Then every text is rewritten: words under the minimum
count become gaps, and around each word the fragment is cut out that holds only
words that are more frequent, two on each side at most. Fragments go to the
bucket of their pivot; there the phrases that the pivot owns are counted, and only
those that reach the minimum leave. So every occurrence is counted in one bucket.

* Order: the `TABLE` most frequent words are numbered by frequency; all other words
  are rarer than these and ordered among themselves by hash. A word's number, or
  its hash with the top bit set, is its id; the largest id of a phrase is its pivot.
  Only this table is broadcast, 12 bytes a word.
* Buckets hold about `BUCKET_WORDS` words of text each, whatever the size of the
  input. A pivot of more than `HOT` occurrences would fill a bucket alone: its
  phrases are counted in each part of the text first and go, with their counts,
  to buckets by phrase.
* A row carries all fragments of one part of the text for one bucket, as arrays of
  ids; a task holds one bucket at a time.

Words are 64-bit hashes of their bytes and language in all this; words of the
phrases found are joined to them at the end. Scores are exact decimals.

Null text is empty; a null language is `und`. Repeated rows count as often as they
stand there. An empty table gives no rows. Other columns are not read, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import textkit as K
from tessera.llm.shared import stored

MIN_COUNT = 10
TABLE = 1 << 20
HOT = 1 << 18
BUCKET_WORDS = 1 << 20
COUNT_BYTES = 4 << 20  # text whose words a task counts at once
CUT_BYTES = 2 << 20  # text that a task cuts into fragments at once

_U = np.uint64
_TOP = _U(1 << 63)
_GAP = _U(2**64 - 1)
_ENDS = np.isin(np.arange(256), list(b".,;:!?\n\x0b\x0c\r"))
#: Bytes that belong to words of a piece.
_IN_WORD = ~(_ENDS | np.isin(np.arange(256), [0x20, 0x09]))
_SHAPES = [(left, right) for left in range(3) for right in range(3) if left or right]


class Order(NamedTuple):
    """The most frequent words by hash, their numbers by frequency, how many of them are hot, and if they are all that reach the minimum."""

    hash: np.ndarray
    number: np.ndarray
    hot: int
    complete: bool

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """The id of each word; words that are known to be rare are gaps."""
        other = np.full(len(hashes), _GAP) if self.complete else hashes | _TOP
        if not len(self.hash):
            return other
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.where(self.hash[at] == hashes, self.number[at].astype(_U), other)


class Run(NamedTuple):
    """hash: of each word with its language; piece: a number that changes where pieces end; row: of each word; words: as they stand in the text."""

    hash: np.ndarray
    piece: np.ndarray
    row: np.ndarray
    words: K.Words


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))


def _runs(batch: pa.RecordBatch) -> Run:
    w = K.words(batch.column(0), _IN_WORD, lower=True)
    row = np.repeat(np.arange(batch.num_rows), np.diff(w.first))
    data, bounds = K.text_bytes(batch.column(1))
    lang = K.mix(K.hash_spans(data, bounds[:-1], bounds[1:]) + _U(1))
    ends = np.concatenate([[0], np.cumsum(_ENDS[w.data])])
    return Run(K.mix(w.hash ^ lang[row]), ends[w.start] + row, row, w)


def _parts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about `most` bytes of text."""
    held, size = [], 0
    for batch in batches:
        for part in K.chunks(batch, size=most):
            held.append(part)
            size += pc.sum(pc.binary_length(part.column(0))).as_py() or 0
            if size >= most:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, h, f) of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, COUNT_BYTES):
            r = _runs(batch)
            h, at, n = np.unique(r.hash, return_index=True, return_counts=True)
            start, length = r.words.start[at], (r.words.end - r.words.start)[at]
            offsets = np.concatenate([[0], np.cumsum(length)])
            flat = r.words.data[np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])]
            words = pa.Array.from_buffers(pa.large_binary(), len(h), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))])
            langs = batch.column(1).take(pa.array(r.row[at]))
            yield pa.RecordBatch.from_arrays([langs.cast(pa.string()), words.cast(pa.large_string()).cast(pa.string()), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "word", "h", "n"])

    counted = _rows(docs).select("text", "lang").mapInArrow(run, "lang string, word string, h long, n long")
    return counted.groupBy("lang", "word", "h").agg(F.sum("n").alias("f"))


def _order(frequent: DataFrame, table: int, hot: int) -> Order:
    """The order of words; at most `table` of them come to the driver, as two numbers each."""
    known = frequent.count()
    least = 0
    if known > table:  # the smallest count of which, and of all larger ones, the table has room
        sizes = frequent.groupBy(F.floor(F.log2("f") * 16).alias("b")).agg(F.count("*").alias("k"), F.max("f").alias("top")).orderBy(F.desc("b")).collect()  # about a thousand rows
        total = 0
        for size in sizes:
            total += size["k"]
            if total > table:
                least = size["top"] + 1
                break
    rows = frequent.where(F.col("f") >= least).select("h", "f").toArrow()
    h, f = rows.column(0).to_numpy().view(_U), rows.column(1).to_numpy()
    number = np.empty(len(h), np.uint32)
    number[np.lexsort((h, -f))] = np.arange(len(h), dtype=np.uint32)
    by_hash = np.argsort(h)
    return Order(h[by_hash], number[by_hash], int((f > hot).sum()), len(h) == known)


def _shift(ids: np.ndarray, piece: np.ndarray, by: int) -> np.ndarray:
    """The id `by` words further in the same piece, a gap where there is none."""
    out = np.full(len(ids), _GAP)
    if by > 0:
        same = piece[by:] == piece[:-by]
        out[:-by][same] = ids[by:][same]
    else:
        same = piece[-by:] == piece[:by]
        out[-by:][same] = ids[:by][same]
    return out


def fragments(ids: np.ndarray, piece: np.ndarray) -> list[tuple[tuple[int, int], np.ndarray]]:
    """For each shape (words before the pivot, words after it) the fragments as rows of ids, the pivot at its place."""
    l1, l2, r1, r2 = (_shift(ids, piece, k) for k in (-1, -2, 1, 2))
    pivot = ids != _GAP
    left1, right1 = pivot & (l1 < ids), pivot & (r1 <= ids)
    left = left1.astype(np.int8) + (left1 & (l2 < ids))
    right = right1.astype(np.int8) + (right1 & (r2 <= ids))
    columns = (l2, l1, ids, r1, r2)
    out = []
    for before, after in _SHAPES:
        at = np.flatnonzero((left == before) & (right == after))
        out.append(((before, after), np.stack([c[at] for c in columns[2 - before : 3 + after]], axis=1)))
    return out


def owned(shape: tuple[int, int], rows: np.ndarray) -> Iterator[np.ndarray]:
    """The phrases of two or three words around the pivot of each fragment, as rows of three ids, the third one a gap for two words."""
    before, after = shape
    for start in range(before - 2, before + 1):
        for size in (2, 3):
            if start >= 0 and start <= before < start + size <= before + 1 + after:
                out = np.full((len(rows), 3), _GAP)
                out[:, :size] = rows[:, start : start + size]
                yield out


def _phrase_hash(rows: np.ndarray) -> np.ndarray:
    return K.mix(K.mix(K.mix(rows[:, 0]) * _U(3) + rows[:, 1]) * _U(5) + rows[:, 2])


def _counted(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different phrases and their counts."""
    _, at, group = np.unique(_phrase_hash(rows), return_index=True, return_inverse=True)
    return rows[at], np.bincount(group, weights=None if n is None else n, minlength=len(at)).astype(np.int64)


def _by_bucket(bucket: np.ndarray, kind: int, rows: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield int(bucket[a]), kind, rows[a:b]


def frequent_phrases(docs: DataFrame, order: Order, buckets: int, least: int) -> DataFrame:
    """(g1, g2, g3, a): ids of the words of each phrase with at least `least` occurrences, g3 null for two words."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(order)  # TABLE words at most
    counted_kind = len(_SHAPES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, CUT_BYTES):
            r = _runs(batch)
            out, hot = [], []
            for kind, (shape, rows) in enumerate(fragments(shared.value.ids(r.hash), r.piece)):
                pivot = rows[:, shape[0]]
                is_hot = pivot < shared.value.hot
                out += _by_bucket(K.mix(pivot[~is_hot]) % _U(buckets), kind, rows[~is_hot])
                hot += owned(shape, rows[is_hot])
            if hot:
                rows, n = _counted(np.concatenate(hot), None)
                out += _by_bucket(_phrase_hash(rows) % _U(buckets), counted_kind, np.column_stack([rows, n.astype(_U)]))
            for a in range(0, len(out), 1024):
                some = out[a : a + 1024]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.int32()), pa.array([x[1] for x in some], pa.int8()), pa.array([x[2].tobytes("F") for x in some], pa.binary())], ["bucket", "kind", "ids"])

    def mine(kinds: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        rows, n = [], []
        for kind, found in kinds:
            for phrases in [found[:, :3]] if kind == counted_kind else owned(_SHAPES[kind], found):
                rows.append(phrases)
                n.append(found[:, 3].astype(np.int64) if kind == counted_kind else np.ones(len(phrases), np.int64))
        rows, n = _counted(np.concatenate(rows), np.concatenate(n))
        rows, n = rows[n >= least], n[n >= least]
        g3 = np.ascontiguousarray(rows[:, 2])
        ids = [np.ascontiguousarray(rows[:, k]).view(np.int64) for k in range(2)]
        return pa.RecordBatch.from_arrays([*map(pa.array, ids), pa.array(g3.view(np.int64), mask=g3 == _GAP), pa.array(n)], ["g1", "g2", "g3", "a"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for bucket, kind, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if bucket != now and held:
                    yield mine(held)
                    held = []
                now = bucket
                width = 4 if kind == counted_kind else sum(_SHAPES[kind]) + 1
                held.append((kind, np.frombuffer(raw, "<u8").reshape(width, -1).T))
        if held:
            yield mine(held)

    rows = _rows(docs).select("text", "lang").mapInArrow(cut, "bucket int, kind tinyint, ids binary")
    n = min(buckets, max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions()))
    dealt = rows.repartitionById(n, F.col("bucket") % n).sortWithinPartitions("bucket")
    return dealt.mapInArrow(gather, "g1 long, g2 long, g3 long, a long")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in decimals of 38 digits, for counts of up to 15."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(left) * wide(right))


def collocations(docs: DataFrame, shown: int = 2000, min_count: int = MIN_COUNT, covered: int = 50, table: int = TABLE, hot: int = HOT, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best `shown` phrases of each language.

    A phrase is left out if a longer frequent one that holds it has at least
    `covered` hundredths of its occurrences.
    """
    spark = docs.sparkSession
    counts = stored(count_words(docs), "words")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = counts.where(F.col("f") >= min_count)
    order = _order(frequent, table, hot)
    n_words = counts.agg(F.sum("f")).first()[0] or 0
    phrases = stored(frequent_phrases(docs, order, max(1, -(-n_words // bucket_words)), min_count), "phrases")
    shared = spark.sparkContext.broadcast(order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = shared.value.ids(batch.column(2).to_numpy().view(_U))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids.view(np.int64)), batch.column(3)], ["lang", "word", "id", "f"])

    words = stored(frequent.mapInArrow(number, "lang string, word string, id long, f long"), "numbered")
    one = lambda k: words.select(F.col("id").alias(f"g{k}"), F.col("word").alias(f"w{k}"), F.col("f").alias(f"f{k}"), *([F.col("lang")] if k == 1 else []))
    pairs = phrases.where("g3 IS NULL").drop("g3").join(one(1), "g1").join(one(2), "g2")
    triples = phrases.where("g3 IS NOT NULL")
    holding = triples.select("g1", "g2", "a").unionByName(triples.select(F.col("g2").alias("g1"), F.col("g3").alias("g2"), "a")).groupBy("g1", "g2").agg(F.max("a").alias("longer"))
    pairs = pairs.join(holding, ["g1", "g2"], "left").where(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True)))
    two = phrases.where("g3 IS NULL")
    triples = (
        triples.join(one(1), "g1").join(one(2), "g2").join(one(3), "g3")
        .join(two.select("g1", "g2", F.col("a").alias("f12")), ["g1", "g2"])
        .join(two.select(F.col("g1").alias("g2"), F.col("g2").alias("g3"), F.col("a").alias("f23")), ["g2", "g3"])
    )
    cut = lambda left, right: F.struct(_score(F.col("a"), left, right).alias("score"), left.alias("l"), right.alias("r"))
    first, last = cut(F.col("f1"), F.col("f23")), cut(F.col("f12"), F.col("f3"))
    found = pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", cut(F.col("f1"), F.col("f2")).alias("cut")).unionByName(
        triples.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(last["score"] < first["score"], last).otherwise(first).alias("cut"))
    )
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= shown)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
