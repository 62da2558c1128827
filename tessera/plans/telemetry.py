"""Funnel, traffic and experiment metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.plans.base import TELEMETRY_SQL, Tables, query

_W = f"WITH {TELEMETRY_SQL}"
_LEVEL = """lv AS (SELECT session_id, max(greatest(CASE event_name WHEN 'outreach_marked_sent' THEN 5 WHEN 'email_copied' THEN 4 WHEN 'email_review_started' THEN 3 WHEN 'onboarding_completed' THEN 2 ELSE 0 END, CASE WHEN page_name = 'onboarding' THEN 1 ELSE 0 END)) AS lvl FROM named GROUP BY 1),
c AS (SELECT k AS stage, count(*) FILTER (WHERE lvl >= k) AS sessions FROM lv, (SELECT unnest([1, 2, 3, 4, 5]) AS k) GROUP BY k)"""


@query(f"{_W}, {_LEVEL} SELECT CAST(stage AS INTEGER) AS stage, sessions FROM c")
def funnel_counts(t: Tables) -> DataFrame:
    return M.funnel(t.telemetry()).select("stage", "sessions")


@query(f"{_W}, {_LEVEL}, l AS (SELECT sessions AS landed FROM c WHERE stage = 1) SELECT CAST(stage AS INTEGER) AS stage, CASE WHEN stage = 1 THEN 100.0::DOUBLE WHEN landed > 0 THEN round(100.0::DOUBLE * sessions / landed, 1) ELSE 0.0::DOUBLE END AS percent FROM c, l")
def funnel_percent(t: Tables) -> DataFrame:
    return M.funnel(t.telemetry()).select("stage", "percent")


@query(f"{_W}, seen AS (SELECT page_name AS page, count(*) AS n FROM named WHERE event_name = 'page_view' GROUP BY 1), known AS (SELECT unnest(['onboarding', 'dashboard', 'email_review', 'analytics']) AS page) SELECT page, coalesce(n, 0) AS views FROM known FULL JOIN seen USING (page)")
def page_views_seeded(t: Tables) -> DataFrame:
    return M.page_views(t.telemetry())


@query(f"{_W} SELECT count(DISTINCT session_id) FILTER (WHERE is_test) AS test_sessions, count(DISTINCT session_id) FILTER (WHERE NOT is_test) AS real_sessions, count(DISTINCT session_id) AS sessions, count(*) FILTER (WHERE NOT is_test) AS real_events FROM named")
def traffic_split(t: Tables) -> DataFrame:
    """Sessions of test and of real traffic; one session may be both."""
    events = t.telemetry().select("session_id", M.is_test(F.col("metadata")).alias("test"))
    each = events.groupBy("session_id").agg(F.max("test").alias("test"), F.max(~F.col("test")).alias("real"), F.count_if(~F.col("test")).alias("n"))
    return each.agg(F.count_if("test").alias("test_sessions"), F.count_if("real").alias("real_sessions"), F.count("*").alias("sessions"), F.sum("n").alias("real_events"))


@query(f"{_W} SELECT coalesce(tester, 'Unspecified Tester') AS tester, count(DISTINCT session_id) AS sessions FROM named WHERE is_test GROUP BY 1")
def tester_distinct(t: Tables) -> DataFrame:
    return M.testers(t.telemetry())


@query(f"{_W} SELECT count(*) FILTER (WHERE event_name IN ('swipe_saved', 'swipe_skipped')) AS total, count(*) FILTER (WHERE event_name = 'swipe_saved') AS saved, count(*) FILTER (WHERE event_name = 'swipe_skipped') AS skipped, round(100.0::DOUBLE * count(*) FILTER (WHERE event_name = 'swipe_saved') / count(*) FILTER (WHERE event_name IN ('swipe_saved', 'swipe_skipped')), 1) AS save_ratio FROM named")
def swipe_ratio(t: Tables) -> DataFrame:
    return M.swipe_ratio(t.telemetry())


@query(f"""{_W}, v AS (SELECT variant, count(DISTINCT session_id) FILTER (WHERE event_name = 'paywall_view') AS views, count(DISTINCT session_id) FILTER (WHERE event_name = 'paywall_feedback' AND answer = 'yes') AS yes,
count(DISTINCT session_id) FILTER (WHERE event_name = 'paywall_feedback' AND answer = 'no') AS no, count(DISTINCT session_id) FILTER (WHERE event_name = 'paywall_close') AS closes FROM named WHERE variant IS NOT NULL GROUP BY 1)
SELECT *, CASE WHEN views > 0 THEN round(100.0::DOUBLE * yes / views, 1) ELSE 0.0::DOUBLE END AS conversion FROM v""")
def ab_variant_pivot(t: Tables) -> DataFrame:
    return M.variants(t.telemetry())


@query(f"{_W} SELECT coalesce(round(avg(ms) FILTER (WHERE event_name = 'onboarding_completed'), 1), 0.0) AS avg_ms FROM named")
def json_metric_avg(t: Tables) -> DataFrame:
    events = t.telemetry()
    return events.agg(M.json_average(events, "synthesis_duration_ms", F.col("event_name") == "onboarding_completed").alias("avg_ms"))


@query(f"{_W}, o AS (SELECT count(*) FILTER (WHERE flag) AS errors, count(*) FILTER (WHERE has_ms OR has_flag) AS measured FROM named WHERE event_name = 'onboarding_completed') SELECT errors, measured, CASE WHEN measured > 0 THEN round(100.0::DOUBLE * errors / measured, 1) ELSE 0.0::DOUBLE END AS rate FROM o")
def error_rate_own_denominator(t: Tables) -> DataFrame:
    """Errors that are JSON true, over events that have either key, be it null."""
    m = F.col("metadata")
    done = t.telemetry().where("event_name = 'onboarding_completed'")
    counts = done.agg(F.count_if(M.is_true(m, "has_parser_error")).alias("errors"), F.count_if(M.has_key(m, "synthesis_duration_ms") | M.has_key(m, "has_parser_error")).alias("measured"))
    return counts.withColumn("rate", F.when(F.col("measured") > 0, F.round(F.lit(100.0) * F.try_divide(F.col("errors"), F.col("measured")), 1)).otherwise(0.0))


@query(f"{_W} SELECT event_id, event_name, page_name, variant FROM named ORDER BY ts DESC, event_id DESC LIMIT 30")
def recent_events(t: Tables) -> DataFrame:
    latest = M.recent(t.telemetry())
    return latest.select("event_id", "event_name", "page_name", M.safe_metadata(F.col("metadata"))["variant"].alias("variant"))


@query(f"{_W} SELECT count(*) AS events, count(DISTINCT session_id) AS sessions FROM named WHERE lower(referrer) LIKE '%campus%'")
def referrer_attribution(t: Tables) -> DataFrame:
    return M.attribution(t.telemetry(), "Campus")


@query(f"{_W} SELECT event_name, page_name, count(*) AS n FROM named GROUP BY 1, 2")
def events_by_name_and_page(t: Tables) -> DataFrame:
    return t.telemetry().groupBy("event_name", "page_name").agg(F.count("*").alias("n"))


@query(f"{_W}, p AS (SELECT page_name, count(*) AS views FROM named GROUP BY 1) SELECT page_name, views, CAST(floor(100.0 * views / sum(views) OVER ()) AS BIGINT) AS share FROM p")
def page_share(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    pages = t.telemetry().groupBy("page_name").agg(F.count("*").alias("views"))
    return pages.withColumn("share", F.floor(F.lit(100) * F.col("views") / F.sum("views").over(Window.partitionBy())))


@query(f"{_W} SELECT event_id FROM named WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'")
def events_since(t: Tables) -> DataFrame:
    """Events from a moment on; a moment that cannot be read would leave all of them."""
    since = F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00"))
    return t.telemetry().where(F.col("created_at") >= since).select("event_id")
