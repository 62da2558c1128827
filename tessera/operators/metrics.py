"""Funnel, traffic and experiment metrics over telemetry events.

Events have session_id, event_name, page_name, metadata (JSON text) and created_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stages, pages, allowed keys and the events that reach a stage (fixed values).
STAGES = ("Landed (Onboarding)", "Finished Onboarding (Reached Swiper)", "Opened Outreach Composer", "Copied Pitch", "Marked as Reached Out")
PAGES = ("onboarding", "dashboard", "email_review", "analytics")
SAFE_KEYS = ("is_test", "tester_name", "variant", "answer", "price", "target", "save_method", "has_parser_error", "synthesis_duration_ms", "decision_duration_ms", "draft_modified_chars_diff")
_REACHED = {"outreach_marked_sent": 5, "email_copied": 4, "email_review_started": 3, "onboarding_completed": 2, "session_start": 1}


def is_test(metadata: Column) -> Column:
    """JSON true, or a text that says true in any case."""
    return F.coalesce(F.lower(F.get_json_object(metadata, "$.is_test")) == "true", F.lit(False))


def traffic(events: DataFrame, kind: str) -> DataFrame:
    test = is_test(F.col("metadata"))
    return events.where(test) if kind == "test" else events.where(~test) if kind == "real" else events


def stage_level(event: Column, page: Column) -> Column:
    """The furthest stage that an event proves; a later stage implies all before it."""
    level = F.lit(0)
    for name, reached in sorted(_REACHED.items(), key=lambda x: x[1]):
        level = F.greatest(level, F.when(event == name, reached).otherwise(0))
    return F.greatest(level, F.when(page == "onboarding", 1).otherwise(0))


def funnel(events: DataFrame) -> DataFrame:
    """(stage, name, sessions, percent): one pass to each session's furthest stage, then counts; percent of those who landed."""
    furthest = events.groupBy("session_id").agg(F.max(stage_level(F.col("event_name"), F.col("page_name"))).alias("level"))
    counts = furthest.agg(*[F.count_if(F.col("level") >= k).alias(f"s{k}") for k in range(1, 6)])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("stage"), F.lit(STAGES[k - 1]).alias("name"), F.col(f"s{k}").alias("sessions"), F.col("s1").alias("landed")) for k in range(1, 6)])).alias("r")).select("r.*")
    share = F.when(F.col("landed") > 0, F.round(F.lit(100.0) * F.col("sessions") / F.col("landed"), 1)).otherwise(0.0)
    return rows.select("stage", "name", "sessions", F.when(F.col("stage") == 1, 100.0).otherwise(share).alias("percent"))


def page_views(events: DataFrame) -> DataFrame:
    """(page, views): known pages even without views, and every other page that was seen."""
    known = events.sparkSession.createDataFrame([(p,) for p in PAGES], "page string")
    seen = events.where(F.col("event_type") == "page_view").groupBy(F.col("page_name").alias("page")).agg(F.count("*").alias("n"))
    return F.broadcast(known).join(seen, "page", "full_outer").select("page", F.coalesce("n", F.lit(0)).cast("long").alias("views"))


def testers(events: DataFrame) -> DataFrame:
    """(tester, sessions) of test traffic."""
    name = F.coalesce(F.nullif(F.get_json_object("metadata", "$.tester_name"), F.lit("")), F.lit("Unspecified Tester"))
    return traffic(events, "test").groupBy(name.alias("tester")).agg(F.count_distinct("session_id").alias("sessions"))


def swipe_ratio(events: DataFrame) -> DataFrame:
    saved, skipped = F.count_if(F.col("event_name") == "swipe_saved"), F.count_if(F.col("event_name") == "swipe_skipped")
    total = saved + skipped
    return events.agg(total.alias("total"), saved.alias("saved"), skipped.alias("skipped"), F.when(total > 0, F.round(F.lit(100.0) * F.try_divide(saved, total), 1)).otherwise(0.0).alias("save_ratio"))


def variants(events: DataFrame, names: tuple[str, ...] = ("subscription", "lifetime")) -> DataFrame:
    """(variant, views, yes, no, closes, conversion) by distinct sessions, from one row a session and variant."""
    answer, variant = F.lower("m.answer"), F.col("m.variant")
    kinds = {"views": F.col("event_name") == "paywall_view", "yes": (F.col("event_name") == "paywall_feedback") & (answer == "yes"), "no": (F.col("event_name") == "paywall_feedback") & (answer == "no"), "closes": F.col("event_name") == "paywall_close"}
    read = events.select("session_id", "event_name", F.from_json("metadata", "struct<variant:string,answer:string>").alias("m"))
    each = read.select("session_id", variant.alias("variant"), *[F.coalesce(c, F.lit(False)).alias(k) for k, c in kinds.items()]).where(F.col("variant").isin(*names))
    sessions = each.groupBy("variant", "session_id").agg(*[F.max(k).alias(k) for k in kinds])
    counts = sessions.groupBy("variant").agg(*[F.count_if(F.col(k)).alias(k) for k in kinds])
    return counts.withColumn("conversion", F.when(F.col("views") > 0, F.round(F.lit(100.0) * F.try_divide(F.col("yes"), F.col("views")), 1)).otherwise(0.0))


def json_average(events: DataFrame, key: str, condition: Column) -> Column:
    """The mean of a JSON number over events that have it, 0 without any."""
    value = F.get_json_object("metadata", f"$.{key}").try_cast("double")
    return F.coalesce(F.round(F.avg(F.when(condition, value)), 1), F.lit(0.0))


def has_key(metadata: Column, key: str) -> Column:
    """Whether a JSON object has a key, be its value null."""
    return F.coalesce(F.array_contains(F.json_object_keys(metadata), key), F.lit(False))


def is_true(metadata: Column, key: str) -> Column:
    """JSON true and nothing else: a text "true" does not count."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(metadata), f"$.{key}", "variant")) == "BOOLEAN", F.lit(False)) & F.coalesce(F.get_json_object(metadata, f"$.{key}") == "true", F.lit(False))


def safe_metadata(metadata: Column) -> Column:
    """The metadata as a map, without keys that could name a person."""
    return F.map_filter(F.from_json(metadata, "map<string,string>"), lambda k, _: k.isin(*SAFE_KEYS))


def recent(events: DataFrame, n: int = 30) -> DataFrame:
    """The latest events without student and personal metadata."""
    return events.orderBy(F.desc("created_at"), F.desc("event_id")).limit(n)


def attribution(events: DataFrame, token: str) -> DataFrame:
    """Events and sessions that name a token in referrer, user agent or any metadata value."""
    low = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(token.lower()))
    values = F.map_values(F.from_json("metadata", "map<string,string>"))
    hit = low(F.col("referrer")) | low(F.col("user_agent")) | F.coalesce(F.exists(values, low), F.lit(False))
    return events.where(hit).agg(F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions"))


def referrals(events: DataFrame, token: str) -> DataFrame:
    """(referrer, events, sessions): one row, of no referrer, for visits with a token in the referrer, in any text of the metadata or in the agent, and one for each other referrer that is not blank."""
    has = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(token.lower())), F.lit(False))
    values = F.map_values(F.from_json("metadata", "map<string,string>"))
    hit = has(F.col("referrer")) | has(F.col("user_agent")) | F.coalesce(F.exists(values, has), F.lit(False))
    rows = events.select("session_id", "referrer", hit.alias("hit")).where(F.col("hit") | (F.coalesce("referrer", F.lit("")) != ""))
    return rows.groupBy(F.when(~F.col("hit"), F.col("referrer")).alias("referrer")).agg(F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions"))
