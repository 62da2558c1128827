"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of all hashes, so sketches
of long and short documents are drawn at one rate: sketches merge by uniting
them, and the share of one document that another contains is the share of its
kept hashes. Short documents would keep nothing; so a sketch also keeps its FLOOR
smallest hashes, which merge as well, and says up to which hash it is complete. Two
sketches are compared up to where both are complete; documents of FLOOR shingles
or fewer are compared exactly.

Shingles are of five words `[^\\x20\\x09-\\x0D]+` in ASCII lower case; a text of fewer
words, but not none, is one shingle. Equal texts have equal fingerprints.

`tail_edits` puts each document beside the one that follows it. Documents are
dealt to blocks by ranges of their ids, whose bounds come from the ids alone; the
first document of a block is sent to the block before it too. Blocks are sorted
and streamed, so a task holds one Arrow batch.

Null and empty texts, and those without words, have an empty sketch: alike to one
another, and to nothing else. Rows of one id follow each other in the order of
their texts, and all lie in one block. A row without id has no place in the order
and no next document: its text is not edited, near_next is null. A single
document follows itself. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkit as K

RATE = 8  # one of so many hashes is kept
FLOOR = 64
_ALL = 2**64 - 1


class Sketch(NamedTuple):
    """hashes: sorted; whole: every shingle's hash up to this one is kept."""

    hashes: np.ndarray
    whole: int

    def text(self) -> str:
        return base64.b64encode(np.array([self.whole, *self.hashes], "<u8").tobytes()).decode()

    @staticmethod
    def of(text: str) -> Sketch:
        values = np.frombuffer(base64.b64decode(text), "<u8")
        return Sketch(values[1:], int(values[0]))

    @staticmethod
    def kept(hashes: np.ndarray, upto: int = _ALL, rate: int = RATE, floor: int = FLOOR) -> Sketch:
        """What a sketch keeps of distinct sorted hashes that are complete up to `upto`."""
        if len(hashes) <= floor:
            return Sketch(hashes, upto)
        whole = min(upto, max(_ALL // rate, int(hashes[floor - 1])))
        return Sketch(hashes[: np.searchsorted(hashes, np.uint64(whole), side="right")], whole)

    def merge(self, other: Sketch, rate: int = RATE, floor: int = FLOOR) -> Sketch:
        """The sketch of both documents together."""
        upto = min(self.whole, other.whole)
        both = np.union1d(self.hashes, other.hashes)
        return Sketch.kept(both[both <= np.uint64(upto)], upto, rate, floor)

    def shared(self, other: Sketch) -> tuple[int, int, int]:
        """Hashes of this one, of the other one and of both, as far as both are complete."""
        upto = np.uint64(min(self.whole, other.whole))
        a, b = self.hashes[: np.searchsorted(self.hashes, upto, side="right")], other.hashes[: np.searchsorted(other.hashes, upto, side="right")]
        return len(a), len(b), len(np.intersect1d(a, b, assume_unique=True))


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of the smaller document's shingles that the other one has; 1 for two without shingles."""
    if not len(a.hashes) or not len(b.hashes):
        return float(len(a.hashes) == len(b.hashes))
    n, m, both = a.shared(b)
    return both / min(n, m) if n and m else 0.0


def jaccard(a: Sketch, b: Sketch) -> float:
    """Estimated share of all shingles of two documents that both have; 1 for two without shingles."""
    if not len(a.hashes) and not len(b.hashes):
        return 1.0
    n, m, both = a.shared(b)
    return both / (n + m - both) if n or m else 0.0


def sketches(column: pa.Array, rate: int = RATE, floor: int = FLOOR) -> list[Sketch]:
    """The sketch of each text of an Arrow column."""
    w = K.words(column, K.SPACE_WORDS, lower=True)
    values, bounds = K.shingles(w.hash, w.first)
    return [Sketch.kept(s, rate=rate, floor=floor) for s in K.row_sets(values, bounds)]


def fingerprints(docs: DataFrame, keep: list[str] | None = None, rate: int = RATE, floor: int = FLOOR) -> DataFrame:
    """Every row with its fingerprint. keep: columns to carry along, by default doc_id."""
    keep = [c for c in (["doc_id"] if keep is None else keep) if c != "fingerprint"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.chunks(batch):
                texts = [s.text() for s in sketches(part.column("text"), rate, floor)]
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in keep} | {"fingerprint": pa.array(texts, pa.string())})

    frame = docs.select(*dict.fromkeys([*keep, "text"]))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name in keep]
    return frame.mapInArrow(run, ", ".join([*fields, "fingerprint string"]))


def edited(text: str, following: str | None) -> str:
    """The text whose last quarter is replaced by as much of the beginning of the following one."""
    n = len(text) // 4
    return text if following is None else text[: len(text) - n] + following[:n]


def _blocks(docs: DataFrame) -> tuple[list, int]:
    """The first id of each range of ids, and how many partitions there are. Reads ids only; as many rows as partitions come back."""
    n = max(docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull())
    firsts = ids.repartitionByRange(n, "doc_id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("first")).select("first").collect()
    return sorted(r["first"] for r in firsts), n


def tail_edits(docs: DataFrame, rate: int = RATE, floor: int = FLOOR) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, jaccard_edited, jaccard_next) of every row.

    near_* are containments of the smaller in the larger document.
    """
    firsts, n = _blocks(docs)
    bounds = np.array(firsts, object if firsts and isinstance(firsts[0], str) else None)

    @F.arrow_udf("array<int>")
    def blocks(ids: pa.Array, spread: pa.Array) -> pa.Array:
        """The block of an id, and the block before it too for the first id of one; any block for no id."""
        out = [[b] for b in spread.to_pylist()]
        given = np.flatnonzero(pc.is_valid(ids).to_numpy(zero_copy_only=False))
        if len(given):
            known = ids.take(pa.array(given))
            first = pc.is_in(known, pa.array(firsts, known.type)).to_numpy(zero_copy_only=False)
            for i, b, again in zip(given.tolist(), (np.searchsorted(bounds, known.to_numpy(zero_copy_only=False), side="right") - 1).tolist(), first.tolist()):
                out[i] = [b, (b - 1) % len(bounds)] if again else [b]
        return pa.array(out, pa.list_(pa.int32()))

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.select("doc_id", "text", F.posexplode(blocks("doc_id", F.pmod(F.xxhash64("text"), F.lit(n)).cast("int"))).alias("guest", "block"))
    sorted_ = dealt.repartitionById(n, F.col("block") % n).sortWithinPartitions("block", "guest", F.col("doc_id").asc_nulls_first(), "text")

    def measured(batch: pa.RecordBatch) -> list[tuple]:
        texts = batch.column(1)
        return list(zip(batch.column(0).to_pylist(), texts.to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), sketches(texts, rate, floor)))

    def result(pairs: list[tuple]) -> pa.RecordBatch:
        changed = [edited(a[1], b and b[1]) for a, b in pairs]
        after = sketches(pa.array(changed, pa.large_string()), rate, floor)
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array([a[0] for a, _ in pairs]).cast(kind),
                "n_chars": pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed], pa.string()),
                "fingerprint": pa.array([a[4].text() for a, _ in pairs], pa.string()),
                "edited_fingerprint": pa.array([s.text() for s in after], pa.string()),
                "near_edited": pa.array([containment(a[4], s) for (a, _), s in zip(pairs, after)], pa.float64()),
                "near_next": pa.array([containment(a[4], b[4]) if b else None for a, b in pairs], pa.float64()),
                "jaccard_edited": pa.array([jaccard(a[4], s) for (a, _), s in zip(pairs, after)], pa.float64()),
                "jaccard_next": pa.array([jaccard(a[4], b[4]) if b else None for a, b in pairs], pa.float64()),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (id, text, guest, block, sketch) in order; each waits for the row after it."""
        waiting = None
        for batch in batches:
            for part in K.chunks(batch):
                pairs = []
                for row in measured(part):
                    if waiting and not waiting[2]:
                        pairs.append((waiting, row if waiting[0] is not None and row[3] == waiting[3] else None))
                    waiting = row
                if pairs:
                    yield result(pairs)
        if waiting and not waiting[2]:
            yield result([(waiting, None)])

    kind = pa.string() if dict(docs.dtypes)["doc_id"] == "string" else pa.int32() if dict(docs.dtypes)["doc_id"] == "int" else pa.int64()
    fields = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, jaccard_edited double, jaccard_next double"
    return sorted_.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {fields}")
