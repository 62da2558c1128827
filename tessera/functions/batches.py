"""Arrow batches in parts of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

PART_BYTES = 1 << 20  # rows of a part, unless it is one row


def parts(batch: pa.RecordBatch | pa.Array, most: int = PART_BYTES) -> Iterator[pa.RecordBatch | pa.Array]:
    """The rows of a batch, or the values of an array, in order, in slices of at most `most` bytes, or of one row.

    What is made of Python objects from a slice takes memory by these bytes, whatever number of rows Spark sends at once.
    """
    n = len(batch)
    if n > 1 and batch.nbytes > most:
        yield from parts(batch.slice(0, n // 2), most)
        yield from parts(batch.slice(n // 2), most)
    elif n:
        yield batch
