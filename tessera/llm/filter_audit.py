"""Filter interaction audit: what each filter removes, alone and after others, in every order.

Each text is judged where it is read. For the identity filter rows are routed as
an RDD by the xxhash of their text: every hash has a chain of the different texts
that share it, and each text in the chain keeps the smallest id that has it, so
all other ids leave the chain as they are met. Copies are taken out before the
shuffle already, so at most one row of a text leaves each task (one for each
`HELD_BYTES` of text), however many copies it has; the rest moves without its
text. After the shuffle rows are sorted by hash, and one chain at a time is held.

Which filters a document fails is a mask; combineByKey adds up how many documents
of a part have each mask, and how many of them are good or toxic. All orders of
the filters follow from these counts, whatever the number of documents.

Null text is empty; a null part is the empty string. Rows of one id and text are
no copies of each other, but each of them counts; a null id is never a copy, and
no row is a copy of it. An id with several labels counts with the largest. An
empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby, permutations
from typing import NamedTuple

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

HELD_BYTES = 32 << 20  # text that the chains of a task hold before the shuffle
ROUTED_BYTES = 64 << 20  # text in one partition after it, at most, where texts differ
_UPPER = bytes(range(65, 91))
_SIGNS = b"#$%&*|"


class Measures(NamedTuple):
    """What the filters look at; words are runs without ASCII white space."""

    raw: bytes
    n_chars: int
    n_words: int
    n_distinct: int


def measure(text: str) -> Measures:
    raw = text.encode()
    words = raw.split()
    return Measures(raw, len(text), len(words), len(set(words)))


def _without(raw: bytes, signs: bytes) -> int:
    """How many of the signs a text holds."""
    return len(raw) - len(raw.translate(None, signs))


#: Filters by letter: true for a text that fails.
FILTERS: dict[str, Callable[[Measures], bool]] = {
    "A": lambda m: m.n_words < 200,
    "B": lambda m: 100 * m.n_distinct < 50 * m.n_words,
    "C": lambda m: 100 * _without(m.raw, _UPPER) > 3 * m.n_chars,
    "D": lambda m: _without(m.raw, _SIGNS) > 0,
}
IDENTITY = "E"


class _Chains:
    """The different texts of some hashes, each with the smallest id that has it.

    An entry is [text, id, mask, {part: rows of this id}].
    """

    def __init__(self, mask_of: Callable[[str], int], copy_bit: int):
        self.by_key: dict[int, list[list]] = {}
        self.mask_of, self.copy_bit, self.held = mask_of, copy_bit, 0

    def meet(self, key: int, text: str, doc: object, parts: dict[str, int], mask: int | None = None) -> Iterator[tuple]:
        """Takes in rows of an id; gives (id, part, mask, rows) of those that are copies."""
        chain = self.by_key.setdefault(key, [])
        for entry in chain:
            if entry[0] == text:
                break
        else:
            self.held += len(text)
            chain.append([text, doc, self.mask_of(text) if mask is None else mask, parts])
            return
        if doc == entry[1]:
            for part, n in parts.items():
                entry[3][part] = entry[3].get(part, 0) + n
            return
        lose, gone = (entry[1], entry[3]) if doc < entry[1] else (doc, parts)
        if doc < entry[1]:
            entry[1], entry[3] = doc, parts
        for part, n in gone.items():
            yield lose, part, entry[2] | self.copy_bit, n

    def kept(self) -> Iterator[tuple[int, list]]:
        for key, chain in self.by_key.items():
            for entry in chain:
                yield key, entry
        self.by_key, self.held = {}, 0


def failures(docs: DataFrame, part: str = "lang", filters: dict[str, Callable[[Measures], bool]] = FILTERS) -> RDD:
    """RDD of (doc_id, part, mask, rows). Bit i of a mask is the i-th filter, and the last bit says that a smaller id has the same text."""
    tests, copy_bit, held = list(filters.values()), 1 << len(filters), HELD_BYTES
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("key"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // ROUTED_BYTES))

    def mask_of(value: str) -> int:
        m = measure(value)
        return sum(1 << i for i, fails in enumerate(tests) if fails(m))

    def before(it: Iterator) -> Iterator[tuple]:
        chains = _Chains(mask_of, copy_bit)
        for doc, where, value, key in it:
            if doc is None:
                yield key, (None, (doc, where, mask_of(value), 1))
                continue
            for gone in chains.meet(key, value, doc, {where: 1}):
                yield hash(gone[0]), (None, gone)
            if chains.held > held:
                yield from chains.kept()
        yield from chains.kept()

    def after(it: Iterator) -> Iterator[tuple]:
        for key, same in groupby(it, lambda row: row[0]):
            chains = _Chains(mask_of, copy_bit)
            for _, value in same:
                if value[0] is None:
                    yield value[1]
                else:
                    yield from chains.meet(key, value[0], value[1], value[3], value[2])
            for _, (_, doc, mask, parts) in chains.kept():
                for where, rows_ in parts.items():
                    yield doc, where, mask, rows_

    return rows.rdd.mapPartitions(before).repartitionAndSortWithinPartitions(n, lambda key: key % n).mapPartitions(after)


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "lang", filters: dict[str, Callable[[Measures], bool]] = FILTERS) -> RDD:
    """RDD of (part, counts): for each mask the documents, those labelled good and those labelled toxic."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    schema = StructType([StructField("doc_id", kind), StructField("part", StringType()), StructField("mask", IntegerType()), StructField("n", LongType())])
    judged = spark.createDataFrame(failures(docs, part, filters), schema, verifySchema=False)
    known = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = judged.join(known, "doc_id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))
    width = 2 << len(filters)

    def add(counts: np.ndarray, row: tuple) -> np.ndarray:
        mask, n, good, toxic = row
        counts[mask] += (n, n * good, n * toxic)
        return counts

    pairs = rows.rdd.map(lambda r: (r[0], tuple(r)[1:]))
    return pairs.combineByKey(lambda row: add(np.zeros((width, 3), np.int64), row), add, lambda a, b: a + b)


def orders(part: str, counts: np.ndarray, letters: str) -> Iterator[tuple]:
    """A row for each order of the filters and each step in it."""
    masks = np.arange(len(counts))
    fails = [(masks >> i) & 1 == 1 for i in range(len(letters))]
    steps, share = [], dict.fromkeys(letters, 0)
    for order in permutations(range(len(letters))):
        gone = np.zeros(len(counts), bool)
        for step, i in enumerate(order, 1):
            removed = counts[fails[i] & ~gone].sum(axis=0)
            redundant = counts[fails[i] & gone, 0].sum()
            gone = gone | fails[i]
            share[letters[i]] += int(removed[0])
            steps.append(("".join(letters[k] for k in order), step, letters[i], counts[~gone, 0].sum(), removed, redundant, counts[1 << i, 0]))
    for name, step, letter, kept, removed, redundant, alone in steps:
        yield part, name, step, int(kept), int(removed[0]), int(redundant), int(alone), int(removed[1]), int(removed[2]), share[letter]


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", filters: dict[str, Callable[[Measures], bool]] = FILTERS) -> DataFrame:
    """A row per part, order of the filters and step: documents kept, removed, redundant, failing this filter only, good and toxic ones lost, and the filter's removals over all orders."""
    letters = "".join(filters) + IDENTITY
    rows = mask_counts(docs, labels, part, filters).flatMap(lambda x: orders(x[0], x[1], letters))
    return docs.sparkSession.createDataFrame(rows, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long", verifySchema=False)
