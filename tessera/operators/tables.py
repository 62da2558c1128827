"""Keeping tables: keepers of duplicates, re-pointing, upserts and state changes, each as a new table.

Parquet tables know no UPDATE, so every operator returns the table as it shall be;
write it to another path than the one that is read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

#: What stands for a missing value in a duplicate's key; a real value of this kind counts as missing (fixed values).
MISSING = {"double": -1.0, "date": "1900-01-01", "string": "~"}

STATES = ("skipped", "saved", "emailed")
OUTREACH = ("sent", "no_reply", "replied", "interview", "joined", "declined")
ANSWERED = ("replied", "interview", "joined")


def filled(column: str, kind: str) -> Column:
    return F.coalesce(F.col(column), F.lit(MISSING[kind]).cast(kind))


def keepers(rows: DataFrame, keys: list[Column], prefer: list[Column], key: str = "id") -> DataFrame:
    """(loser, keeper) of each duplicate; the keeper is the first by `prefer`, then by key.

    Groups are found by one aggregate, and the keeper is joined back to the losers:
    no group is gathered in one task.
    """
    named = rows.select(F.col(key).alias("row"), *[k.alias(f"k{i}") for i, k in enumerate(keys)], F.struct(*[F.when(p, 0).otherwise(1).alias(f"p{i}") for i, p in enumerate(prefer)], F.col(key).alias("row")).alias("order"))
    on = [f"k{i}" for i in range(len(keys))]
    first = named.groupBy(*on).agg(F.min("order").alias("first"), F.count("*").alias("n")).where(F.col("n") > 1).select(*on, F.col("first.row").alias("keeper"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in on]
    pairs = named.alias("a").join(first.alias("b"), [*same])
    return pairs.where(F.col("a.row") != F.col("b.keeper")).select(F.col("a.row").alias("loser"), F.col("b.keeper").alias("keeper"))


def repoint(matches: DataFrame, losers: DataFrame, child: str = "grant_id", owner: str = "student_id") -> DataFrame:
    """Matches with losers replaced by keepers; one that would collide with the owner's own match of the keeper goes, as does a second one."""
    moved = matches.join(losers, F.col(child) == F.col("loser"), "left")
    stay = moved.where(F.col("keeper").isNull()).select(*matches.columns)
    held = stay.select(F.col(owner).alias("_owner"), F.col(child).alias("_child"))
    free = moved.where(F.col("keeper").isNotNull()).join(held, (F.col(owner) == F.col("_owner")) & (F.col("keeper") == F.col("_child")), "left_anti")
    pointed = free.select(*[F.col("keeper").alias(child) if c == child else F.col(c) for c in matches.columns])
    first = Window.partitionBy(owner, child).orderBy(*[c for c in matches.columns if c not in (owner, child)])
    return stay.unionByName(pointed.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n"))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], update: list[str] | None = None) -> DataFrame:
    """Stored rows with the incoming columns where keys meet, and the incoming rows whose keys are new.

    Columns that incoming lacks keep their stored values. A null key meets nothing;
    incoming must have each key once (see first_of_batch).
    """
    given = [c for c in (update or incoming.columns) if c not in keys]
    known = stored.where(" and ".join(f"{k} is not null" for k in keys))
    old, new = known.alias("o"), incoming.where(" and ".join(f"{k} is not null" for k in keys)).withColumn("_new", F.lit(True)).alias("n")
    both = old.join(new, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    pick = []
    for c in stored.columns:
        if c in keys:
            pick.append(F.coalesce(f"n.{c}", f"o.{c}").alias(c))
        elif c in given:
            pick.append(F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            pick.append(F.col(f"o.{c}").alias(c))
    rest = incoming.where(" or ".join(f"{k} is null" for k in keys))
    alone = stored.where(" or ".join(f"{k} is null" for k in keys))
    return both.select(*pick).unionByName(alone).unionByName(rest, allowMissingColumns=True).select(*stored.columns)


def first_of_batch(batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key by an explicit order; rows without a key all stay."""
    ranked = batch.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("_n = 1").drop("_n").unionByName(batch.where(F.col(key).isNull()))


def keep_unread(new: Column, old: Column, fetched: Column) -> Column:
    """A new value only if the agency was asked; else a missing one cannot erase what is stored."""
    return F.when(fetched.isNotNull(), new).otherwise(F.coalesce(new, old))


def update_where(rows: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Rows with new values where a condition is true; running it again changes nothing if the condition then fails."""
    hit = F.coalesce(condition, F.lit(False))
    return rows.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns])


def without_orphans(children: DataFrame, parents: DataFrame, child: str, parent: str) -> DataFrame:
    """Children whose parent is still there: what a cascading delete leaves."""
    return children.join(parents.select(F.col(parent).alias("_p")).distinct(), F.col(child) == F.col("_p"), "left_semi")


def new_titles(found: DataFrame, stored_titles: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """Found rows whose title is neither stored nor on an earlier found row."""
    keyed = found.withColumn("_key", key)
    fresh = keyed.join(stored_titles.select(F.col("title_key").alias("_stored")).distinct(), F.col("_key") == F.col("_stored"), "left_anti")
    return fresh.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).where("_n = 1").drop("_n", "_key")


def outreach_change(matches: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Outreach states of written-to matches; the first answer stamps responded_at once. Unknown states change nothing."""
    joined = matches.join(changes.select("match_id", F.col("outreach_status").alias("_next")), "match_id", "left")
    allowed = F.coalesce((F.col("status") == "emailed") & F.col("_next").isin(*OUTREACH), F.lit(False))
    answered = allowed & F.col("_next").isin(*ANSWERED)
    values = {"outreach_status": F.when(allowed, F.col("_next")).otherwise(F.col("outreach_status")), "responded_at": F.when(answered, F.coalesce("responded_at", now)).otherwise(F.col("responded_at"))}
    return joined.select(*[values[c].alias(c) if c in values else F.col(c) for c in matches.columns])


def first_contact(matches: DataFrame, sent: DataFrame, now: Column) -> DataFrame:
    """Matches with a sent mail: contacted_at is stamped once and a status beyond sent does not fall back."""
    joined = matches.join(sent.select("match_id").distinct().withColumn("_sent", F.lit(True)), "match_id", "left")
    values = {"status": F.lit("emailed"), "contacted_at": F.coalesce("contacted_at", now), "outreach_status": F.coalesce("outreach_status", F.lit("sent"))}
    return joined.select(*[F.when(F.col("_sent"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in matches.columns])


def change_log(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, old, new) of every value that differs, null-safe; write it before the new table."""
    both = old.alias("o").join(new.alias("n"), key)
    changes = F.filter(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"o.{c}").cast("string").alias("old"), F.col(f"n.{c}").cast("string").alias("new")) for c in columns]), lambda x: ~x["old"].eqNullSafe(x["new"]))
    return both.select(key, F.explode(changes).alias("c")).select(key, "c.column", "c.old", "c.new")


def rule_counts(required: list[str], allowed: dict[str, tuple[str, ...]], ranges: dict[str, tuple[float, float]] | None = None) -> dict[str, Column]:
    """For each rule the count of rows that break it: presence, an allowed set, a range; only presence minds nulls."""
    counts = {f"not null {c}": F.count_if(F.col(c).isNull()) for c in required}
    counts |= {f"allowed {c}": F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*v)) for c, v in allowed.items()}
    return counts | {f"range {c}": F.count_if(~F.col(c).between(*v)) for c, v in (ranges or {}).items()}


def write_checked(rows: DataFrame, path: str, required: list[str], allowed: dict[str, tuple[str, ...]], ranges: dict[str, tuple[float, float]] | None = None) -> dict[str, int]:
    """Writes rows as Parquet and gives the broken rules with their rows, counted while they are written."""
    seen = Observation()
    rows.observe(seen, F.count("*").alias("rows"), *[c.alias(rule) for rule, c in rule_counts(required, allowed, ranges).items()]).write.parquet(path)
    return {rule: n for rule, n in seen.get.items() if n and rule != "rows"}


def orphans(children: DataFrame, child: str, parents: DataFrame, parent: str) -> DataFrame:
    """Rows that name a parent that there is not; a null names none."""
    return children.where(F.col(child).isNotNull()).join(parents.select(F.col(parent).alias("_parent")).distinct(), F.col(child) == F.col("_parent"), "left_anti")


def key_faults(rows: DataFrame, key: list[str], required: list[str], allowed: dict[str, tuple[str, ...]], foreign: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """(rule, rows): how many rows break uniqueness, presence, an allowed set or name a parent that there is not."""
    repeated = rows.groupBy(*key).count().where("count > 1").agg(F.lit("unique").alias("rule"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows"))
    for child, (parents, parent) in (foreign or {}).items():
        repeated = repeated.unionByName(orphans(rows, child, parents, parent).agg(F.lit(f"foreign {child}").alias("rule"), F.count("*").alias("rows")))
    tests = [F.struct(F.lit(rule).alias("rule"), n.alias("rows")) for rule, n in rule_counts(required, allowed).items()]
    return rows.agg(F.array(*tests).alias("t")).select(F.explode("t").alias("t")).select("t.*").unionByName(repeated) if tests else repeated


def batches(items: DataFrame, size: int, key: str) -> DataFrame:
    """Items with the number of their batch of `size`, in order of key.

    The first key of each range is fixed first, so that counting the ranges and numbering
    the rows in them agree; a range is numbered in one task. Keys are numbers, texts or
    dates; rows without one come first.
    """
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = items.select(key).where(F.col(key).isNotNull()).repartitionByRange(n, key).groupBy(F.spark_partition_id()).agg(F.min(key).alias("first"))
    firsts = sorted(r["first"] for r in ranges.collect())  # one a range

    @F.arrow_udf("int")
    def part(keys: pa.Array) -> pa.Array:
        return pa.array([max(0, bisect_right(firsts, k) - 1) if k is not None else 0 for k in keys.to_pylist()], pa.int32())

    spread = items.withColumn("_part", part(F.col(key)))
    counts = spread.groupBy("_part").count()
    before = counts.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_base"))  # a row a range
    placed = spread.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(key)))
    return placed.join(F.broadcast(before), "_part").withColumn("batch", F.floor((F.col("_base") + F.col("_n") - 1) / size)).drop("_part", "_n", "_base")


def match_states(matches: DataFrame, shown: DataFrame) -> DataFrame:
    """Matches after swipes: the latest swipe of a match decides; its score is the shown one, else the stored, else 100 times the dot product.

    shown: student_id, grant_id, at, status, score, dot. Swipes with unknown states count for nothing.
    """
    key = ["student_id", "grant_id"]
    latest = shown.where(F.col("status").isin(*STATES)).groupBy(*key).agg(F.max_by(F.struct("status", "score", "dot"), F.struct("at", "status")).alias("s")).select(*key, "s.*")
    both = matches.alias("m").join(latest.alias("n"), key, "full_outer")
    fallback = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(F.col("n.dot") * 100).cast("int")))
    return both.select(*key, F.coalesce("n.status", "m.status").alias("status"), F.when(F.col("n.status").isNull(), F.col("m.score")).otherwise(F.coalesce("n.score", "m.score", fallback)).alias("score"))


def answer_faults(asked: DataFrame, answered: DataFrame, required: list[str], share: float = 0.1) -> DataFrame:
    """(fault, rows) of a batch of records: more than asked, not asked for, twice, without a key, too many missing.

    asked: id; answered: id, record. Faults that do not occur have no row.
    """
    from tessera.functions.records import has_keys

    n = asked.agg(F.count("*").alias("asked"))
    known = answered.join(asked.select("id", F.lit(True).alias("_asked")), "id", "left")
    counts = known.agg(
        F.count("*").alias("rows"), F.count_if(F.col("_asked").isNull()).alias("not_asked"), (F.count("*") - F.count_distinct("id")).alias("twice"),
        F.count_if(~has_keys(F.col("record"), required)).alias("missing_key"), F.count_distinct(F.when(F.col("_asked"), F.col("id"))).alias("found"),
    ).crossJoin(n)
    absent = F.col("asked") - F.col("found")
    tests = {"too_many": F.greatest(F.lit(0), F.col("rows") - F.col("asked")), "not_asked": F.col("not_asked"), "twice": F.col("twice"), "missing_key": F.col("missing_key"), "absent": F.when(absent > F.col("asked") * share, absent).otherwise(0)}
    each = counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("fault"), v.cast("long").alias("rows")) for k, v in tests.items()])).alias("f"))
    return each.select("f.*").where("rows > 0")


def once_per_value(rows: DataFrame, columns: list[str], rule: Callable[..., list[Column]]) -> DataFrame:
    """Rows with the columns that a rule makes of the given ones alone; it is applied once to each combination of values.

    For costly rules on values that come again in many rows, as names of institutions do. Nulls are values too.
    """
    keys = [f"_value{i}" for i in range(len(columns))]
    values = rows.select(*[F.col(c).alias(k) for c, k in zip(columns, keys)]).distinct()
    made = values.select(*keys, *rule(*map(F.col, keys)))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(columns, keys)])
    return rows.join(made, same).drop(*keys)


def quotes(evidence: DataFrame) -> DataFrame:
    """(award, sentence, terms): each quoted sentence once, with the terms found in it in order."""
    return evidence.groupBy("award", "sentence").agg(F.array_sort(F.collect_set("term")).alias("terms"))  # the student's terms at most


def undo(matches: DataFrame, wanted: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Matches without those to be undone, and the refused ones: who was written to stays."""
    asked = matches.join(wanted.select(*keys).distinct(), keys, "left_semi")
    refused = asked.where(F.coalesce(F.col("status") == "emailed", F.lit(False)))
    return matches.join(asked.where(F.coalesce(F.col("status") != "emailed", F.lit(True))).select(*keys), keys, "left_anti"), refused


def set_null(children: DataFrame, parents: DataFrame, child: str, parent: str) -> DataFrame:
    """Children whose parent is gone lose the reference and stay."""
    known = parents.select(F.col(parent).alias("_parent")).distinct()
    joined = children.join(known, F.col(child) == F.col("_parent"), "left")
    return joined.withColumn(child, F.col("_parent")).select(*children.columns)


def touched(old: DataFrame, new: DataFrame, key: str, columns: list[str], stamp: str, now: Column) -> DataFrame:
    """New rows; the stamp is renewed where a column differs from the old row or there was none."""
    before = old.select(F.col(key).alias("_key"), F.col(stamp).alias("_stamp"), F.struct(*columns).alias("_old"))
    same = F.col("_old").eqNullSafe(F.struct(*columns)) & F.col("_key").isNotNull()
    return new.join(before, F.col(key) == F.col("_key"), "left").withColumn(stamp, F.when(same, F.col("_stamp")).otherwise(now)).drop("_key", "_stamp", "_old")


def next_page(shown: DataFrame, page: DataFrame, key: str) -> DataFrame:
    """What is shown with the rows of a page that are not yet."""
    return shown.unionByName(page.join(shown.select(key), key, "left_anti"))


def merged_hits(first: DataFrame, second: DataFrame, term: str) -> DataFrame:
    """Hits of two searches; the second's only for terms that the first lacks, whatever their case."""
    folded = F.lower(F.trim(F.col(term)))
    seen = first.select(folded.alias("_term")).distinct()
    return first.unionByName(second.withColumn("_term", folded).join(seen, "_term", "left_anti").drop("_term"))


def answers_to_batch(answers: DataFrame, batch: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Answers to a batch's own rows, and whether the row is gone by now."""
    own = answers.join(batch.select(key).distinct(), key, "left_semi")
    held = current.select(key, F.lit(False).alias("gone")).distinct()
    return own.join(held, key, "left").withColumn("gone", F.coalesce("gone", F.lit(True)))


def last_of_batch(batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key in some order; rows without a key all stay."""
    row = F.struct(*order, *[c for c in batch.columns if c not in order and c != key])
    last = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(row).alias("_row")).select(key, "_row.*")
    return last.select(*batch.columns).unionByName(batch.where(F.col(key).isNull()))
