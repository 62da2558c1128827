"""Registration of queries and the roles that the test tables play in them.

embeddings are awards with vectors, documents awards with texts, orders awards with
dates and amounts, labels the swipes of one student, events the telemetry, pages
raw agency records.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TODAY = "1998-07-01"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder: Tables(spark, folder).orders"""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def swipes(self) -> DataFrame:
        """(grant_id, status) of the student."""
        return self.labels.select(F.col("doc_id").alias("grant_id"), status(F.col("quality"), F.col("toxic")).alias("status"))

    def awards(self) -> DataFrame:
        """(award, person, end, amount); every thirteenth award has published no end date."""
        end = F.when(F.col("o_orderkey") % 13 != 0, F.to_date("o_orderdate"))
        return self.orders.select(F.col("o_orderkey").alias("award"), F.col("o_custkey").alias("person"), end.alias("end"), F.col("o_totalprice").alias("amount"))

    def telemetry(self) -> DataFrame:
        """Events as an app would send them, with JSON metadata made of the event's own numbers."""
        kind, n = F.col("event_type"), F.get_json_object("props", "$.k").cast("int")
        name = F.when(kind == "signup", "onboarding_completed").when(kind == "click", F.when(n % 2 == 0, "email_review_started").otherwise("swipe_saved")).when(kind == "purchase", F.when(n % 3 == 0, "outreach_marked_sent").otherwise("email_copied"))
        name = name.when(kind == "view", F.when(n % 3 == 0, "paywall_view").when(n % 3 == 1, "paywall_feedback").otherwise("page_view")).otherwise("swipe_skipped")
        page = F.when(kind == "view", F.when(n % 2 == 0, "onboarding").otherwise("dashboard")).when(kind == "error", "help").otherwise("email_review")
        fields = [
            F.concat(F.lit('"is_test":'), F.when(n % 5 == 0, "true").when(n % 5 == 1, '"True"').otherwise("false")),
            F.when(n % 10 == 0, F.concat(F.lit('"tester_name":"t'), (n % 4).cast("string"), F.lit('"'))),
            F.when(n % 4 != 3, F.concat(F.lit('"variant":"'), F.when(n % 2 == 0, "subscription").otherwise("lifetime"), F.lit('"'))),
            F.concat(F.lit('"answer":"'), F.when(n % 4 == 1, "Yes").otherwise("no"), F.lit('"')),
            F.when(n % 3 != 2, F.concat(F.lit('"synthesis_duration_ms":'), F.when(n % 6 == 0, "null").otherwise(n.cast("string")))),
            F.when(n % 7 == 0, F.lit('"has_parser_error":true')).when(n % 7 == 1, '"has_parser_error":"true"'),
        ]
        metadata = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
        return self.events.select("event_id", F.col("user_id").alias("session_id"), F.when(name == "page_view", "page_view").otherwise("action").alias("event_type"), name.alias("event_name"), page.alias("page_name"), metadata.alias("metadata"), F.col("ts").alias("created_at"), F.when(kind == "view", "https://Campus.example/feed").alias("referrer"), F.lit("agent").alias("user_agent"))


def status(quality: Column, toxic: Column) -> Column:
    return F.when(quality == 0, "skipped").when(toxic == 1, "emailed").otherwise("saved")


def query(sql: str | None = None):
    """Registers a function of Tables as a query by its name, with equivalent SQL."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


AWARDS_SQL = "awards AS (SELECT o_orderkey AS award, o_custkey AS person, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderdate AS DATE) END AS \"end\", o_totalprice AS amount FROM orders)"
SWIPES_SQL = "swipes AS (SELECT doc_id AS grant_id, CASE WHEN quality = 0 THEN 'skipped' WHEN toxic = 1 THEN 'emailed' ELSE 'saved' END AS status FROM labels)"
TELEMETRY_SQL = """
n AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS n FROM events),
named AS (SELECT *, CASE event_type WHEN 'signup' THEN 'onboarding_completed'
    WHEN 'click' THEN CASE WHEN n % 2 = 0 THEN 'email_review_started' ELSE 'swipe_saved' END
    WHEN 'purchase' THEN CASE WHEN n % 3 = 0 THEN 'outreach_marked_sent' ELSE 'email_copied' END
    WHEN 'view' THEN CASE n % 3 WHEN 0 THEN 'paywall_view' WHEN 1 THEN 'paywall_feedback' ELSE 'page_view' END
    ELSE 'swipe_skipped' END AS event_name,
  CASE event_type WHEN 'view' THEN CASE WHEN n % 2 = 0 THEN 'onboarding' ELSE 'dashboard' END WHEN 'error' THEN 'help' ELSE 'email_review' END AS page_name,
  n % 5 IN (0, 1) AS is_test, CASE WHEN n % 10 = 0 THEN 't' || (n % 4) END AS tester,
  CASE WHEN n % 4 <> 3 THEN CASE WHEN n % 2 = 0 THEN 'subscription' ELSE 'lifetime' END END AS variant,
  CASE WHEN n % 4 = 1 THEN 'yes' ELSE 'no' END AS answer,
  n % 3 <> 2 AS has_ms, CASE WHEN n % 3 <> 2 AND n % 6 <> 0 THEN n END AS ms, n % 7 IN (0, 1) AS has_flag, n % 7 = 0 AS flag,
  CASE WHEN event_type = 'view' THEN 'https://Campus.example/feed' END AS referrer, user_id AS session_id FROM n)
"""
