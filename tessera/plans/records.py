"""Dates, amounts, agency records and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import dates, scores
from tessera.operators import quality as Q
from tessera.plans.base import AWARDS_SQL, SWIPES_SQL, TODAY, Tables, query

_T = f"DATE '{TODAY}'"
_A = f"WITH {AWARDS_SQL}"
_FUND = f"""f AS (SELECT award, CASE WHEN award % 29 = 0 THEN "end" + INTERVAL 15 YEAR ELSE "end" END::DATE AS e, ("end" - INTERVAL 3 YEAR)::DATE + CASE WHEN award % 3 = 0 THEN 1100 ELSE 0 END AS s, CASE WHEN award % 2 = 0 THEN "end" + 5 WHEN award % 7 = 0 THEN "end" - 5 END AS c FROM awards)"""


def _funded(t: Tables) -> DataFrame:
    a, end = F.col("award"), F.col("end")
    start = F.date_add(F.add_months(end, -36), F.when(a % 3 == 0, 1100).otherwise(0))
    far = F.when(a % 29 == 0, F.add_months(end, 180)).otherwise(end)
    return t.awards().select("award", far.alias("e"), start.alias("s"), F.when(a % 2 == 0, F.date_add(end, 5)).when(a % 7 == 0, F.date_add(end, -5)).alias("c"))


@query(f"""{_A}, {_FUND}, g AS (SELECT award, e, s, CASE WHEN e IS NULL THEN 'no_end_date' WHEN e > {_T} + INTERVAL 10 YEAR THEN 'implausible_end' WHEN e < {_T} AND coalesce(c > e, false) THEN 'ended' WHEN e < {_T} THEN 'end_on_file_passed' WHEN coalesce(s > {_T}, false) THEN 'starts_later' ELSE 'funded' END AS state FROM f)
SELECT award, state, CASE state WHEN 'no_end_date' THEN 'No end date on file' WHEN 'implausible_end' THEN 'End date on file: ' || strftime(e, '%b %Y') || ', likely a data error' WHEN 'ended' THEN 'Award ended ' || strftime(e, '%b %Y')
WHEN 'end_on_file_passed' THEN 'End date on file: ' || strftime(e, '%b %Y') || ' (passed)' WHEN 'starts_later' THEN 'Starts ' || strftime(s, '%b %Y') || ' · funded through ' || strftime(e, '%b %Y') ELSE 'Funded through ' || strftime(e, '%b %Y') END AS label FROM g""")
def funding_state(t: Tables) -> DataFrame:
    state = dates.funding_state(F.col("s"), F.col("e"), F.col("c"), F.lit(TODAY).cast("date"))
    rows = _funded(t).withColumn("state", state)
    return rows.select("award", "state", dates.funding_label(F.col("s"), F.col("e"), F.col("state")).alias("label"))


@query(f"""{_A}, m AS (SELECT award, greatest(0, (year("end") - 1998) * 12 + month("end") - 7 - CASE WHEN day("end") < 1 THEN 1 ELSE 0 END) AS m FROM awards WHERE "end" >= {_T})
SELECT award, CAST(m AS INTEGER) AS months, CASE WHEN m < 1 THEN 'under 1 mo left' WHEN m >= 12 AND m % 12 > 0 THEN (m // 12) || ' yr ' || (m % 12) || ' mo left' WHEN m >= 12 THEN (m // 12) || ' yr left' ELSE m || ' mo left' END AS left_ FROM m""")
def whole_months_left(t: Tables) -> DataFrame:
    today = F.lit(TODAY).cast("date")
    months = dates.whole_months(today, F.col("end"))
    return t.awards().where(F.col("end") >= today).select("award", months.alias("months"), dates.time_left(months).alias("left_"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def parse_us_date(t: Tables) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 5 == 0, "unknown").otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    return t.orders.select("o_orderkey", dates.us_date_text(raw).alias("day"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def iso_day(t: Tables) -> DataFrame:
    """The day a text begins with; a day that no calendar has is none."""
    raw = F.when(F.col("o_orderkey") % 4 == 0, "1997-02-30T00:00").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:00:00Z")))
    return t.orders.select("o_orderkey", dates.iso_day(raw).alias("day"))


@query("SELECT o_orderkey, CAST(o_orderkey % 90 + 10 AS INTEGER) AS year_of_support FROM orders")
def support_year(t: Tables) -> DataFrame:
    number = F.concat(F.lit("5R01GM"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0"), F.lit("-"), (F.col("o_orderkey") % 90 + 10).cast("string"), F.lit("A1"))
    return t.orders.select("o_orderkey", dates.support_year(number).alias("year_of_support"))


@query("""SELECT s_suppkey, abs(s_acctbal - CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal + 0.004 ELSE s_acctbal + s_suppkey % 2 END) < 0.005 AS same FROM supplier""")
def change_diff(t: Tables) -> DataFrame:
    """Amounts that differ by less than half a cent are the same."""
    other = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_acctbal") + 0.004).otherwise(F.col("s_acctbal") + F.col("s_suppkey") % 2)
    return t.supplier.select("s_suppkey", scores.same_amount(F.col("s_acctbal"), other).alias("same"))


@query("""WITH r AS (SELECT o_orderkey AS record, o_custkey AS core, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 3 END AS sub, year(o_orderdate) AS y, o_orderpriority = '1-URGENT' AS sup FROM orders),
s AS (SELECT record AS id, core, sub, y FROM r), m AS (SELECT s.id, r.record, r.y FROM s JOIN r ON s.core = r.core AND s.sub IS NOT DISTINCT FROM r.sub AND r.y > s.y AND NOT r.sup)
SELECT id, record FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY y DESC, record DESC) AS k FROM m) WHERE k = 1""")
def newest_record(t: Tables) -> DataFrame:
    o = F.col("o_orderkey")
    r = t.orders.select(o.alias("record"), F.col("o_custkey").alias("core"), F.when(o % 3 != 0, o % 3).alias("sub"), F.year("o_orderdate").alias("year"), (F.col("o_orderpriority") == "1-URGENT").alias("supplement"))
    return Q.newest_record(r.select(F.col("record").alias("id"), "core", "sub", "year"), r)


@query("""WITH g AS (SELECT CASE WHEN doc_id % 3 <> 0 THEN text END AS text, CASE WHEN doc_id % 7 <> 0 THEN lang END AS lang, source FROM documents), c AS (SELECT count(*) AS n, count(text) AS text, count(lang) AS lang, count(source) AS source FROM g)
SELECT 'text' AS "column", text AS filled, round(text / CAST(n AS DOUBLE), 4) AS share FROM c UNION ALL SELECT 'lang', lang, round(lang / CAST(n AS DOUBLE), 4) FROM c UNION ALL SELECT 'source', source, round(source / CAST(n AS DOUBLE), 4) FROM c""")
def population_rate(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    rows = t.documents.select(F.when(d % 3 != 0, F.col("text")).alias("text"), F.when(d % 7 != 0, F.col("lang")).alias("lang"), "source")
    return Q.population(rows, ["text", "lang", "source"])


@query(f"""{_A} SELECT count(*) AS rows, count(*) FILTER (WHERE "end" IS NULL OR "end" >= {_T}) AS active, count(*) FILTER (WHERE "end" IS NULL) AS without_end, count(*) FILTER (WHERE amount > 100000) AS large, count(*) FILTER (WHERE person % 10 = 0 AND "end" < {_T}) AS ended_unresolved FROM awards""")
def corpus_snapshot(t: Tables) -> DataFrame:
    today, end = F.lit(TODAY).cast("date"), F.col("end")
    return Q.snapshot(t.awards(), {"rows": F.lit(True), "active": dates.is_active(end, today), "without_end": end.isNull(), "large": F.col("amount") > 100000, "ended_unresolved": (F.col("person") % 10 == 0) & (end < today)})


@query(f"""{_A}, h AS (SELECT count(*) AS total, count(*) FILTER (WHERE "end" IS NULL OR "end" >= {_T}) AS active, count(*) FILTER (WHERE award % 3 = 0) AS generated, count(*) FILTER (WHERE person % 10 = 0) AS unresolved FROM awards)
SELECT *, total - active AS ended, round(generated / CAST(total AS DOUBLE), 3) AS generated_ratio FROM h""")
def health_report(t: Tables) -> DataFrame:
    return Q.health(t.awards(), dates.is_active(F.col("end"), F.lit(TODAY).cast("date")), F.col("award") % 3 == 0, F.col("person") % 10 == 0)


@query("SELECT n_name AS nation FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def starved_sources(t: Tables) -> DataFrame:
    fetched = t.supplier.where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"))
    return Q.starved(t.nation.select("n_nationkey", "n_name"), fetched, "n_nationkey").select(F.col("n_name").alias("nation"))


_DUE_SQL = f"""{SWIPES_SQL}, m AS (SELECT grant_id, status, CASE grant_id % 3 WHEN 0 THEN 'sent' WHEN 1 THEN 'replied' END AS outreach, TIMESTAMP '1998-07-01 00:00:00' - to_hours(CAST(grant_id % 300 AS INTEGER)) AS contacted, CASE WHEN grant_id % 4 = 0 THEN TIMESTAMP '1998-07-01 00:00:00' + to_hours(CAST(grant_id % 5 AS INTEGER) - 2) END AS reminder FROM swipes),
due AS (SELECT * FROM m WHERE status = 'emailed' AND coalesce(outreach, 'sent') <> 'replied' AND coalesce(reminder <= TIMESTAMP '1998-07-01 00:00:00', true) AND contacted <= TIMESTAMP '1998-07-01 00:00:00' - INTERVAL 6 DAY)"""


def _due(t: Tables) -> DataFrame:
    g, now = F.col("grant_id"), F.to_timestamp(F.lit("1998-07-01 00:00:00"))
    hours = lambda c: F.make_dt_interval(hours=c.cast("int"))
    m = t.swipes().select("grant_id", "status", F.when(g % 3 == 0, "sent").when(g % 3 == 1, "replied").alias("outreach"), (now - hours(g % 300)).alias("contacted"), F.when(g % 4 == 0, now + hours(g % 5 - 2)).alias("reminder"))
    return m.where(dates.follow_up_due(F.col("status"), F.col("outreach"), F.col("contacted"), F.lit(None).cast("timestamp"), F.col("reminder"), now))


@query(f"WITH {_DUE_SQL} SELECT grant_id FROM due")
def follow_up_due(t: Tables) -> DataFrame:
    return _due(t).select("grant_id")


@query(f"WITH {_DUE_SQL} SELECT arg_min(grant_id, (contacted, grant_id)) AS oldest, count(*) AS due FROM due")
def oldest_nudge(t: Tables) -> DataFrame:
    return _due(t).agg(F.min_by("grant_id", F.struct("contacted", "grant_id")).alias("oldest"), F.count("*").alias("due"))


@query("SELECT o_orderpriority AS reason, count(*) AS n FROM orders GROUP BY 1")
def verdict_histogram(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderpriority").alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def dimension_lookup(t: Tables) -> DataFrame:
    """Names of codes from a small table; Spark broadcasts it by its size."""
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name")


@query("SELECT count(*) AS batch_items, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(length(text)) // 4 AS BIGINT) AS tokens FROM documents")
def material_size(t: Tables) -> DataFrame:
    return t.documents.agg(F.count("*").alias("batch_items"), F.sum(F.length("text")).alias("chars"), F.expr("sum(length(text)) div 4").alias("tokens"))
