"""Rules on terms, people and pages against hand-made cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import awards, lists, people, profile
from tessera.operators import tables as O


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "text, n",
    [
        ("We use R and Python.", 1), ("R&D costs", 0), ("R-loop", 0), ("I/R injury", 0), ("(R/Python) packages", 1), ("Python/R tools", 1), ("R++ is not R#", 0), ("R. norvegicus", 0),
        ("Todd R. Manini", 0), ("analysed in R. We go on", 1), ("analysed in R.", 1), ("R", 1), ("for", 0), (None, 0), ("", 0), ("R, R and R", 3),
    ],
)
def test_single_letters(spark, text, n):
    assert one(spark, profile.places(F.lit("R"), F.lit(text).cast("string"))["n"]) == n


def test_front_hits_are_ranked(spark):
    abstract = "Cells matter. " + "Filler words go on and on here. " * 6 + "It ends with genomics and Biology at the Department of Biology Studies, and yeast."
    terms = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(o).alias("origin")) for t, o in (("yeast", "ai_suggested"), ("genomics", "narrative"), ("cells", "ai_suggested"), ("rivers", "cv"), ("absent", "cv"))])
    found = one(spark, profile.front_hits(terms, F.lit("On rivers"), F.lit(None).cast("string"), F.lit(abstract)))
    assert [r["term"] for r in found["rows"]] == ["rivers", "cells", "genomics"] and found["total"] == 4
    assert [r["field"] for r in found["rows"]] == ["title", "abstract", "abstract"] and found["rows"][1]["shown"] == "Cells"
    nothing = F.lit(None).cast("array<struct<term:string,origin:string>>")
    assert one(spark, profile.front_hits(nothing, F.lit("a"), F.lit("b"), F.lit("c"))) is None
    named = F.array(F.struct(F.lit("Ecology").alias("term"), F.lit("cv").alias("origin")))
    late = "Long text about other things entirely. " * 4 + "Held at the Institute for Ecology and Evolution."
    found = one(spark, profile.front_hits(named, F.lit("t"), F.lit(None).cast("string"), F.lit(late)))
    assert found["rows"] == [] and found["total"] == 1


def test_window_around_a_term(spark):
    text = "word " * 100 + "target " + "more " * 100
    at = text.index("target")
    w = one(spark, profile.window(F.lit(text), F.lit(at), F.lit(at + 6), 60))
    assert w["text"] == text[w["begin"] : w["begin"] + len(w["text"])] and "target" in w["text"] and len(w["text"]) <= 60 and w["cut_before"] and w["cut_after"]
    assert text[w["begin"] - 1] == " " and not w["text"].endswith(" ")
    short = one(spark, profile.window(F.lit("a target b"), F.lit(2), F.lit(8), 60))
    assert (short["text"], short["begin"], short["cut_before"], short["cut_after"]) == ("a target b", 0, False, False)


def test_people(spark):
    read = one(spark, people.co_investigators(F.lit('[{"name":"LI, BO","title":"PROFESSOR OF LAW"},{"name":null}]')))
    assert [(r["name"], r["title"]) for r in read] == [("LI, BO", "Professor of law")]
    assert one(spark, people.co_investigators(F.lit("not json"))) is None or one(spark, people.co_investigators(F.lit("not json"))) == []
    assert one(spark, people.co_investigators(F.lit("[]"))) == []
    assert one(spark, awards.kind_tag(F.lit("training"))) == "Training program" and one(spark, awards.kind_tag(F.lit("research_project"))) is None


def test_lists_with_skips(spark):
    values = F.array(*[F.lit(x) for x in ("A b", "a  B", "C", " ", "D")])
    assert one(spark, lists.distinct_ignoring_case(values, F.array(F.lit("c ")))) == ["A b", "D"]


def test_changes_to_tables(spark):
    m = spark.createDataFrame([(1, "saved"), (2, "emailed"), (3, None)], "id int, status string")
    left, refused = O.undo(m, m.select("id"), ["id"])
    assert [tuple(r) for r in left.collect()] == [(2, "emailed")] == [tuple(r) for r in refused.collect()]
    kids = spark.createDataFrame([(1, 10), (2, None), (3, 30)], "kid int, parent int")
    parents = spark.createDataFrame([(10,)], "id int")
    assert sorted(map(tuple, O.set_null(kids, parents, "parent", "id").collect())) == [(1, 10), (2, None), (3, None)]
    rows = spark.createDataFrame([(None, 1, 1), (None, 1, 1), ("a", 1, 5), ("a", 2, 4)], "k string, at int, v int")
    assert sorted(map(tuple, O.last_of_batch(rows, "k", ["at"]).collect()), key=repr) == [("a", 2, 4), (None, 1, 1), (None, 1, 1)]


def test_batches_are_whole(spark):
    rows = spark.range(0, 1000).selectExpr("(id * 7919) % 1009 AS k").repartition(7)
    found = sorted((r["k"], r["batch"]) for r in O.batches(rows, 30, "k").collect())
    assert found == [(k, i // 30) for i, k in enumerate(sorted((i * 7919) % 1009 for i in range(1000)))]
    texts = rows.selectExpr("concat('é', k) AS k").unionByName(spark.createDataFrame([(None,), ("z",), ("z",)], "k string"))
    ordered = sorted([f"é{(i * 7919) % 1009}" for i in range(1000)] + ["z", "z"])
    assert sorted(((r["k"] or "", r["batch"]) for r in O.batches(texts, 30, "k").collect()), key=lambda x: (x[1], x[0])) == [(k, i // 30) for i, k in enumerate(["", *ordered])]
    assert O.batches(rows.limit(0), 30, "k").collect() == []


def test_append(spark, tmp_path):
    from tessera.sources.tables import append

    for k in (1, 2):
        append(spark.createDataFrame([(k,)], "id int"), f"{tmp_path}/t")
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [1, 2]
