"""Logs and logged tables through failures; rules counted while rows are written."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators import tables as O
from tessera.streaming import logs


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_batch_that_is_run_again_adds_nothing(spark, tmp_path):
    folder, rows = str(tmp_path / "log"), spark.createDataFrame([(1, "sent"), (2, None)], "id long, event string")
    assert logs.read_log(spark, folder, "id long, event string").collect() == []
    logs.append_batch(rows, 0, folder)
    logs.append_batch(rows.where("id = 1"), 1, folder)
    once = rows_of(logs.read_log(spark, folder, "id long, event string"))
    logs.append_batch(rows, 0, folder)
    logs.append_batch(rows.where("id = 1"), 1, folder)
    assert rows_of(logs.read_log(spark, folder, "id long, event string")) == once == [(1, "sent", 0), (1, "sent", 1), (2, None, 0)]


def test_a_batch_that_broke_off_is_not_read(spark, tmp_path):
    folder = str(tmp_path / "log")
    for n in range(2):
        logs.append_batch(spark.range(3), n, folder)
    (tmp_path / "log" / "batch=1" / "_SUCCESS").unlink()
    assert logs.read_log(spark, folder, "id long").count() == 3
    logs.append_batch(spark.range(3), 1, folder)
    assert logs.read_log(spark, folder, "id long").count() == 6


def test_a_stream_appends_each_file_once(spark, tmp_path):
    source, folder, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    spark.range(5).write.parquet(source)
    read = lambda: spark.readStream.schema("id long").parquet(source)
    logs.append_stream(read(), folder, state).awaitTermination(120)
    logs.append_stream(read(), folder, state).awaitTermination(120)
    assert logs.read_log(spark, folder, "id long").count() == 5
    spark.range(5, 7).write.mode("append").parquet(source)
    logs.append_stream(read(), folder, state).awaitTermination(120)
    assert [r["id"] for r in logs.read_log(spark, folder, "id long").orderBy("id").collect()] == list(range(7))


@pytest.fixture
def logged(spark, tmp_path):
    table = logs.LoggedTable(spark, str(tmp_path / "t"), "id")
    table.create(spark.createDataFrame([(1, "a", 1.5), (2, None, 2.0), (3, "c", None)], "id long, name string, amount double"))
    return table


def test_changes_are_logged_before_they_are_made(spark, logged):
    new = logged.read().withColumn("name", F.when(F.col("id") == 1, "x").when(F.col("id") == 2, "y")).withColumn("amount", F.when(F.col("id") == 3, 7.25).otherwise(F.col("amount")))
    assert logged.rewrite(new, ["name", "amount"]) == 1
    assert rows_of(logged.read()) == [(1, "x", 1.5), (2, "y", 2.0), (3, None, 7.25)]
    assert rows_of(logged.changes(1)) == [(1, "name", "a", "x"), (2, "name", None, "y"), (3, "amount", None, "7.25"), (3, "name", "c", None)]
    assert rows_of(logged.read(0)) == [(1, "a", 1.5), (2, None, 2.0), (3, "c", None)]
    assert logged.rewrite(logged.read(), ["name", "amount"]) == 2 and logged.changes(2).count() == 0


@pytest.mark.parametrize("half", [False, True])
def test_a_crash_between_log_and_table_is_recovered(spark, logged, monkeypatch, half):
    new = logged.read().withColumn("name", F.lit("z"))

    def crash(n):
        if half:  # some files, but not marked as written
            logged.read(0).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{logged.table}/version={n}")
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(logged, "_make", crash)
        with pytest.raises(RuntimeError):
            logged.rewrite(new, ["name"])
    assert logged.version() == 0 and rows_of(logged.read()) == [(1, "a", 1.5), (2, None, 2.0), (3, "c", None)]
    assert logged.recover() == 1 == logged.recover()
    assert rows_of(logged.read()) == [(1, "z", 1.5), (2, "z", 2.0), (3, "z", None)]


def test_a_crash_before_the_log_changes_nothing(spark, logged, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(logs, "change_log", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            logged.rewrite(logged.read(), ["name"])
    assert logged.recover() == 0


def test_rules_are_counted_while_rows_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 5.0), (2, "q", -1.0), (None, None, None), (4, "b", 11.0)], "id long, kind string, amount double")
    path = str(tmp_path / "out")
    assert O.write_checked(rows, path, ["id"], {"kind": ("a", "b")}, {"amount": (0, 10)}) == {"not null id": 1, "allowed kind": 1, "range amount": 2}
    assert spark.read.parquet(path).count() == 4
    assert O.write_checked(rows.where("id = 1"), path + "2", ["id"], {"kind": ("a",)}) == {} == O.write_checked(rows.limit(0), path + "3", ["id"], {})


def test_orphans(spark):
    children = spark.createDataFrame([(1, 10), (2, 11), (3, None), (4, 11)], "id long, parent long")
    parents = spark.createDataFrame([(10,), (10,), (None,)], "key long")
    assert rows_of(O.orphans(children, "parent", parents, "key")) == [(2, 11), (4, 11)]
    found = {r["rule"]: r["rows"] for r in O.key_faults(children, ["id"], ["parent"], {}, {"parent": (parents, "key")}).collect()}
    assert found == {"unique": 0, "not null parent": 1, "foreign parent": 2}
