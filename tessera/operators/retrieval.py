"""Ranking awards for a student: nearest vectors, what was swiped, paging over raw positions, look-ups."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import awards, scores, text

#: Agencies whose awards name neither abstract nor investigator.
UNNAMED_SOURCES = tuple(awards.AGENCIES.values())


def student_vector(students: DataFrame, student: object, key: str = "vec_id", column: str = "embedding") -> list[float]:
    """The vector of one student; raises where there is none to compare with."""
    row = students.where(F.col(key) == student).select(column).first()
    if row is None or row[0] is None or not any(row[0]):
        raise ValueError("STUDENT_EMBEDDING_MISSING")
    return row[0]


def nearest(items: DataFrame, vector: list[float], threshold: float, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, similarity) of items nearer than the threshold; null and zero vectors drop out."""
    found = items.select(key, scores.cosine(F.col(column), scores.vector(vector)).alias("similarity"))
    return found.where(F.col("similarity") > threshold)


def unswiped(items: DataFrame, swipes: DataFrame, key: str = "grant_id") -> DataFrame:
    """Items that the student has neither saved, skipped nor written to."""
    return items.join(swipes.select(key), key, "left_anti")


def top(ranked: DataFrame, limit: int, offset: int = 0, score: str = "similarity", key: str = "grant_id") -> DataFrame:
    return ranked.orderBy(F.desc(score), key).offset(offset).limit(limit)


def excluded(source: Column, name: Column, mode: str = "off") -> Column:
    """Whether an award may not enter a deck: unnamed sources, all of them or those without a resolved name."""
    unnamed = F.coalesce(source, F.lit("")).isin(*UNNAMED_SOURCES)
    return unnamed & ~text.is_resolved(name) if mode == "resolved_only" else unnamed


class Page(NamedTuple):
    rows: DataFrame
    state: DataFrame


def raw_offset_page(ranked: DataFrame, keep: Column, limit: int, offset: int, batch: int, calls: int, order: list[Column]) -> Page:
    """A page of kept rows from position `offset` of the ranking, and where the next page begins.

    Positions count all ranked rows. Of the window of calls * batch positions, the
    first `limit` kept rows form the page. state has one row: next_offset and
    exhausted. Only rows up to the window's end are numbered.
    """
    window = batch * calls
    ahead = ranked.orderBy(*order).limit(offset + window)  # rows the walk may look at
    placed = ahead.withColumn("position", F.row_number().over(Window.orderBy(*order))).where(F.col("position") > offset)
    kept = placed.where(keep).orderBy("position").limit(limit)
    last = kept.agg(F.count("*").alias("kept"), F.max("position").alias("last"))
    total = ranked.agg(F.count("*").alias("n"))
    full = (F.col("kept") == limit) & (F.lit(limit) > 0)
    rest = F.col("n") - offset
    state = last.crossJoin(total).select(
        F.when(full, F.col("last")).when(rest < window, F.greatest(F.col("n"), F.lit(offset))).otherwise(F.lit(offset + window)).cast("long").alias("next_offset"),
        F.when(full, (F.col("last") == F.col("n")) & (rest % batch != 0)).otherwise(rest < window).alias("exhausted"),
    )
    return Page(kept, state)


def with_details(hits: DataFrame, details: DataFrame, key: str, prefer_left: list[str], right_only: list[str]) -> DataFrame:
    """Hits with their details: a hit's own value first, then the stored one."""
    joined = hits.alias("l").join(details.alias("r"), F.col(f"l.{key}") == F.col(f"r.{key}"), "left")
    own = [F.col(f"l.{c}") for c in hits.columns if c not in prefer_left]
    return joined.select(*own, *[F.coalesce(f"l.{c}", f"r.{c}").alias(c) for c in prefer_left], *[F.col(f"r.{c}") for c in right_only])


def other_awards(awards: DataFrame, today: Column, shown: int = 5) -> DataFrame:
    """(award, person, others): up to `shown` other active awards of the same person, latest end first.

    Without a person the list is null; with one but no other award it is empty.
    Only the first `shown` + 1 awards of a person can be on a list, so these are
    ranked once a person and joined to all of the person's awards.
    """
    active = awards.where(F.col("person").isNotNull() & (F.col("end").isNull() | (F.col("end") >= today)))
    by_end = Window.partitionBy("person").orderBy(F.desc_nulls_first("end"), "award")
    ranked = active.withColumn("rank", F.row_number().over(by_end)).where(F.col("rank") <= shown + 1)
    lists = ranked.groupBy("person").agg(F.array_sort(F.collect_list(F.struct("rank", "award"))).alias("first"))  # shown + 1 at most
    others = F.slice(F.filter(F.transform("first", lambda x: x["award"]), lambda a: a != F.col("award")), 1, shown)
    none = F.array().cast("array<long>")
    return awards.join(lists, "person", "left").select("award", "person", F.when(F.col("person").isNotNull(), F.coalesce(others, none)).alias("others"))


def saved_order(saved: DataFrame) -> DataFrame:
    """Written-to awards first, then by score with unknown ones as 0."""
    return saved.orderBy(F.col("status") != "emailed", F.desc(F.coalesce("score", F.lit(0))), "grant_id")


def keyset_page(rows: DataFrame, after: object, limit: int, key: str) -> DataFrame:
    """The next rows by key after the last one seen."""
    return rows.where(F.col(key) > after).orderBy(key).limit(limit)
