"""Reports on the state of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot(rows: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """One row of conditional counts."""
    return rows.agg(*[F.count_if(c).alias(name) for name, c in measures.items()])


def health(rows: DataFrame, active: Column, generated: Column, unresolved: Column) -> DataFrame:
    counts = rows.agg(F.count("*").alias("total"), F.count_if(active).alias("active"), F.count_if(generated).alias("generated"), F.count_if(unresolved).alias("unresolved"))
    return counts.withColumn("ended", F.col("total") - F.col("active")).withColumn("generated_ratio", F.when(F.col("total") > 0, F.round(F.try_divide(F.col("generated"), F.col("total")), 3)).otherwise(0.0))


def population(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, filled, share) of every column, in one pass."""
    counts = rows.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in columns])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in columns])
    return counts.select("n", F.explode(each).alias("e")).select("e.column", "e.filled", F.coalesce(F.round(F.try_divide(F.col("e.filled"), F.col("n")), 4), F.lit(0.0)).alias("share"))


def starved(sources: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    """Sources of which nothing was fetched."""
    return sources.join(fetched.select(key).distinct(), key, "left_anti")


def newest_record(stored: DataFrame, records: DataFrame) -> DataFrame:
    """(id, record) of the latest record of the same project and subproject that is newer than the stored one and no supplement.

    stored: id, core, sub, year; records: record, core, sub, year, supplement. Missing subprojects are equal.
    """
    s, r = stored.alias("s"), records.where(~F.coalesce("supplement", F.lit(False))).alias("r")
    met = s.join(r, (F.col("s.core") == F.col("r.core")) & F.col("s.sub").eqNullSafe(F.col("r.sub")) & (F.col("r.year") > F.col("s.year")))
    return met.groupBy("s.id").agg(F.max(F.struct("r.year", "r.record")).alias("m")).select("id", F.col("m.record").alias("record"))
