"""Connected components of a graph of long ids, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import stored

EDGES = 300_000  # edges that one task holds


class Union:
    """Disjoint sets whose root is their smallest member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x], x = top, up
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars around the smallest member of each of its components."""
    union = Union()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            union.join(a, b)
    nodes = list(union.parent)
    yield pa.RecordBatch.from_pydict({"u": pa.array(nodes, pa.int64()), "v": pa.array([union.root(x) for x in nodes], pa.int64())})


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) of every node with an edge to another one; label is the smallest node of its component.

    Edges are first reduced to stars in partitions of EDGES at most. If there are
    several, rounds of large and small stars join them; each writes its edges to
    the shared folder. Rounds grow with the logarithm of the longest path and end
    when the edges no longer change.
    """
    pairs = stored(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where(F.col("u") != F.col("v")), "pairs")
    parts = max(1, -(-pairs.count() // EDGES))
    dealt = pairs.coalesce(1) if parts == 1 else pairs.repartition(parts)
    now = stored(dealt.mapInArrow(_forests, "u long, v long").where(F.col("u") != F.col("v")), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before, seen = (None, mark(now)) if parts > 1 else (0, 0)
    while seen != before:
        now = stored(_small_star(_large_star(now)), "edges")
        before, seen = seen, mark(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def longs(raw: list[bytes]) -> np.ndarray:
    """Byte strings of little-endian 64-bit numbers as one array."""
    return np.frombuffer(b"".join(raw), "<u8")
