"""Sentences of award texts and what they quote of a student's terms, with places."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tessera.functions import claims, spans
from tessera.functions import text as T
from tessera.functions.batches import parts

GENERATED, TITLE_AGAIN, PUBLISHED = "llm_generated", "federal_description_only", "held_as_published"
ROWS = "array<struct<term:string,origin:string,field:string,sentence:string,offsets:array<struct<begin:int,end:int>>,truncated_start:boolean,truncated_end:boolean>>"


@F.arrow_udf(ArrayType(StructType([StructField("begin", IntegerType()), StructField("end", IntegerType())])))
def sentence_spans(texts: pa.Array) -> pa.Array:
    """The places of all sentences of a text, behind a heading, where one of them is to be chosen."""
    found = ([{"begin": a, "end": b} for a, b in spans.sentences(x, spans.CHOOSING, spans.prose_begin(x))] for x in texts.to_pylist())
    return pa.array(found, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))


@F.arrow_udf(IntegerType())
def prose_begin(texts: pa.Array) -> pa.Array:
    """Where a text begins behind its heading."""
    return pa.array([spans.prose_begin(x) for x in texts.to_pylist()], pa.int32())


@F.arrow_udf(ArrayType(StringType()))
def sentences(texts: pa.Array) -> pa.Array:
    """The sentences of a text, each exactly as it stands there. A text is cut in one pass, whatever number it has."""

    def cut(x: str | None) -> list[str] | None:
        return None if x is None else [x[a:b] for a, b in spans.sentences(x, spans.CHOOSING, spans.prose_begin(x))]

    kind = pa.list_(pa.string())
    done = [pa.array(map(cut, part.to_pylist()), kind) for part in parts(texts)]
    return pa.concat_arrays(done) if done else pa.array([], kind)


def provenance(title: Column, abstract: Column, generated: Column) -> Column:
    """What a stored abstract is: as published, the title again, or written by a model."""
    clean = lambda c: T.normal_key(F.coalesce(c, F.lit("")))
    again = (clean(abstract) != "") & (clean(abstract) == clean(title))
    return F.when(~F.coalesce(generated, F.lit(False)), PUBLISHED).when(again, TITLE_AGAIN).otherwise(GENERATED)


def fit_evidence(awards: DataFrame, key: str = "award") -> DataFrame:
    """(key, basis, rows, matched, total): a quotation for each of the student's terms that an award's text has.

    awards: key, terms (array<struct<term,origin>>, null if they were not loaded), title,
    abstract, generated. A text that a model wrote is not searched, and matched is null
    then; where the abstract is the title again there is one text. A null `generated`
    is no statement: all is null but the key. Each text is split once for all terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole)):
            out = [_evidence(*r) for r in zip(*(batch.column(i).to_pylist() for i in range(1, 5)))]
            rows = [r and r[0] for r in out]
            totals = [r and r[1] for r in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), pa.array(rows, _ROWS), pa.array(totals, pa.int32())], [key, "basis", "rows", "total"])

    known = awards.select(key, "terms", "title", "abstract", F.when(F.col("generated").isNotNull(), provenance(F.col("title"), F.col("abstract"), F.col("generated"))).alias("basis"))
    found = known.mapInArrow(run, f"`{key}` {awards.schema[key].dataType.simpleString()}, basis string, rows {ROWS}, total int")
    return found.select(key, "basis", "rows", F.when(F.col("basis") != GENERATED, F.size("rows")).alias("matched"), "total")


_ROWS = pa.list_(
    pa.struct([("term", pa.string()), ("origin", pa.string()), ("field", pa.string()), ("sentence", pa.string()), ("offsets", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), ("truncated_start", pa.bool_()), ("truncated_end", pa.bool_())])
)


def _evidence(terms: list[dict] | None, title: str | None, abstract: str | None, basis: str | None) -> tuple[list[dict], int] | None:
    """Rows and the number of different terms; null without a basis or terms."""
    if terms is None or basis is None:
        return None
    wanted = {}
    for t in terms:
        clean = spans.collapsed(t and t["term"])
        if clean:
            wanted.setdefault(clean.casefold(), (clean, t["origin"]))
    fields = [] if basis == GENERATED else [("title", title)] if basis == TITLE_AGAIN else [("title", title), ("abstract", abstract)]
    sources = [(name, spans.Source(value)) for name, value in fields if value]
    rows = []
    for term, origin in wanted.values():
        for name, source in sources:
            found = source.quote(term)
            if found and found.offsets:
                rows.append({"term": term, "origin": origin, "field": name} | found._asdict() | {"offsets": [{"begin": a, "end": b} for a, b in found.offsets]})
                break
    return rows, len(wanted)


def summary_faults(rows: DataFrame, key: str, summaries: str, title: str, source: str) -> DataFrame:
    """(key, faults): for each of an array of one-sentence summaries the reasons against it, given title and text.

    Title and text are indexed once for all summaries of a row. A null array gives null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole)):
            out = []
            for listed, head, text in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                ground = claims.Ground(head, text) if listed else None
                out.append(listed and [ground.faults(s) for s in listed])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.list_(pa.string())))], [key, "faults"])

    return rows.select(key, summaries, title, source).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, faults array<array<string>>")
