"""A stage that asks a model, given as a Python function, once a row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def ask(rows: DataFrame, prompt: str, call: Callable[[str], str | None], into: str = "answer") -> DataFrame:
    """Rows with the model's answer to the prompt column; a call that fails gives null and does not end the job.

    Write the result before it is used twice: each evaluation calls again.
    """
    keep = [c for c in rows.columns if c != into]

    def answer(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return call(text)
        except Exception:  # the model is not ours
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = [answer(p) for p in batch.column(prompt).to_pylist()]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in keep} | {into: pa.array(answers, pa.string())})

    kept = rows.select(*keep)
    return kept.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"{into} string"]))
