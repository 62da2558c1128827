"""Logs that a replay does not repeat, and tables whose changes are logged before they are made.

A micro-batch goes to a folder named by its number and replaces what an earlier try
left there, so a batch that Spark runs again after a failure adds nothing. A table is
kept as versions: the changes of a version are written first, then the version. If a
run ends between the two, the next one makes the version from the log. What readers
see are whole versions and batches only: those that Spark has marked as written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.tables import change_log


def _path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _written(spark: SparkSession, path: str) -> bool:
    files, hadoop = _path(spark, f"{path}/_SUCCESS")
    return files.exists(hadoop)


def _numbers(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The numbers of the finished parts of a folder, in order: one name a version or batch comes to the driver."""
    files, hadoop = _path(spark, folder)
    if not files.exists(hadoop):
        return []
    found = [s.getPath().getName() for s in files.listStatus(hadoop)]
    return sorted(n for n in (int(x.split("=")[1]) for x in found if x.startswith(f"{name}=")) if _written(spark, f"{folder}/{name}={n}"))


def append_batch(rows: DataFrame, batch: int, folder: str) -> None:
    """Writes a batch under its number; a second write of it replaces the first."""
    rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def append_stream(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends what has arrived and ends; batches that are run again are written once."""
    return rows.writeStream.foreachBatch(lambda batch, number: append_batch(batch, number, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All rows of finished batches, with the number of their batch."""
    done = _numbers(spark, folder, "batch")
    whole = f"{schema}, batch long"
    if not done:
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("basePath", folder).parquet(*[f"{folder}/batch={n}" for n in done])


def with_changes(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with the new values of a log (key, column, old, new) of texts; keys that the log does not have stay as they are."""
    names = [c for c in rows.columns if c != key]
    latest = changes.groupBy(key).agg(*[F.max(F.when(F.col("column") == c, F.struct(F.col("new")))).alias(f"_{i}") for i, c in enumerate(names)])
    joined = rows.join(latest, key, "left")
    new = [F.when(F.col(f"_{i}").isNotNull(), F.col(f"_{i}.new").cast(rows.schema[c].dataType)).otherwise(F.col(c)).alias(c) for i, c in enumerate(names)]
    return joined.select(key, *new).select(*rows.columns)


class LoggedTable:
    """A table in versions, whose changes stand in a log before they are made."""

    def __init__(self, spark: SparkSession, folder: str, key: str):
        self.spark, self.key = spark, key
        self.table, self.log = f"{folder}/table", f"{folder}/log"

    def create(self, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.table}/version=0")

    def version(self) -> int:
        return _numbers(self.spark, self.table, "version")[-1]

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.table}/version={self.version() if version is None else version}")

    def recover(self) -> int:
        """Makes the versions that are logged and not yet written; gives the version that holds now."""
        now = self.version()
        for n in _numbers(self.spark, self.log, "version"):
            if n > now:
                self._make(n)
                now = n
        return now

    def rewrite(self, rows: DataFrame, columns: list[str]) -> int:
        """Logs what rows change in columns, then makes the new version."""
        old, n = self.read(self.recover()), self.version() + 1
        change_log(old, rows, self.key, columns).write.mode("overwrite").parquet(f"{self.log}/version={n}")
        self._make(n)
        return n

    def changes(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.log}/version={version}")

    def _make(self, n: int) -> None:
        with_changes(self.read(n - 1), self.changes(n), self.key).write.mode("overwrite").parquet(f"{self.table}/version={n}")
