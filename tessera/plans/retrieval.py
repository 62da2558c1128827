"""Ranking, scoring and look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import scores, text
from tessera.operators import retrieval as R
from tessera.plans.base import AWARDS_SQL, SWIPES_SQL, TODAY, Tables, query

_SIM_SQL = """sim AS (SELECT e.vec_id AS grant_id, e.label, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"""


def _ranked(t: Tables, threshold: float) -> DataFrame:
    return R.nearest(t.embeddings, R.student_vector(t.embeddings, 0), threshold).withColumnRenamed("vec_id", "grant_id")


@query(f"WITH {_SIM_SQL} SELECT grant_id, round(s, 6) AS similarity FROM sim WHERE s > 0.2 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = grant_id) ORDER BY s DESC, grant_id LIMIT 12")
def vector_topk(t: Tables) -> DataFrame:
    """The nearest awards that were not swiped."""
    return R.top(R.unswiped(_ranked(t, 0.2), t.swipes()), 12).select("grant_id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_SIM_SQL} SELECT grant_id, round(s, 6) AS similarity FROM sim WHERE s > 0.0 ORDER BY s DESC, grant_id LIMIT 20 OFFSET 40")
def vector_topk_offset_page(t: Tables) -> DataFrame:
    return R.top(_ranked(t, 0.0), 20, 40).select("grant_id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_SIM_SQL} SELECT label, count(*) AS near, round(max(s), 6) AS best FROM sim WHERE s > 0.1 GROUP BY label")
def vector_threshold_count(t: Tables) -> DataFrame:
    near = _ranked(t, 0.1).join(t.embeddings.select(F.col("vec_id").alias("grant_id"), "label"), "grant_id")
    return near.groupBy("label").agg(F.count("*").alias("near"), F.round(F.max("similarity"), 6).alias("best"))


@query("SELECT vec_id AS grant_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def swiped_anti_join(t: Tables) -> DataFrame:
    return R.unswiped(t.embeddings.select(F.col("vec_id").alias("grant_id")), t.swipes())


@query(f"WITH {AWARDS_SQL} SELECT award, \"end\" AS end_day FROM awards WHERE \"end\" IS NULL OR \"end\" >= DATE '{TODAY}'")
def active_only_filter(t: Tables) -> DataFrame:
    return t.awards().where(F.col("end").isNull() | (F.col("end") >= F.lit(TODAY).cast("date"))).select("award", F.col("end").alias("end_day"))


@query("WITH u AS (SELECT vec_id, CAST(embedding AS DOUBLE[])[1:32] AS v FROM embeddings) SELECT vec_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first, 32 AS width FROM u")
def vector_cut_to_width(t: Tables) -> DataFrame:
    """Vectors cut to half their width and scaled to length 1 again."""
    cut = scores.fit_width(F.col("embedding"), 32)
    return t.embeddings.select("vec_id", cut.alias("v")).select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.size("v").alias("width"))


_TAGS = "[lower(w) FOR w IN regexp_extract_all(text, '[A-Za-z]+')]"
_SKILLS = ("the", "of", "and", "la", "der", "que")


def _tagged(t: Tables, only: DataFrame | None = None) -> DataFrame:
    """only: the awards that are asked for, before their texts are read into tags."""
    tags = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    docs = t.documents if only is None else t.documents.join(only.select(F.col("grant_id").alias("doc_id")), "doc_id", "left_semi")
    return docs.select(F.col("doc_id").alias("grant_id"), "source", F.transform(tags, F.lower).alias("tags"))


_KW_SQL = f"""tagged AS (SELECT doc_id AS grant_id, source, {_TAGS} AS tags FROM documents),
kw AS (SELECT *, CASE WHEN len(tags) > 0 THEN CAST(round_even(len(list_filter(tags, lambda x: x IN {_SKILLS})) * 100.0::DOUBLE / len(tags), 0) AS INTEGER) END AS keyword FROM tagged)"""


def _keyword(t: Tables, only: DataFrame | None = None) -> DataFrame:
    return _tagged(t, only).withColumn("keyword", scores.tag_overlap(F.col("tags"), F.array(*[F.lit(s) for s in _SKILLS])))


@query(f"WITH {_KW_SQL} SELECT grant_id, keyword FROM kw")
def tag_overlap_score(t: Tables) -> DataFrame:
    return _keyword(t).select("grant_id", "keyword")


@query(f"WITH {_SIM_SQL}, {_KW_SQL}, b AS (SELECT grant_id, greatest(0, least(100, CAST(round_even(100 * round(s, 6), 0) AS INTEGER))) AS semantic FROM sim) SELECT grant_id, semantic, keyword, CASE WHEN keyword IS NULL THEN semantic ELSE CAST(round_even(0.65::DOUBLE * semantic + (1 - 0.65::DOUBLE) * keyword, 0) AS INTEGER) END AS score FROM b JOIN kw USING (grant_id)")
def hybrid_blend(t: Tables) -> DataFrame:
    """Semantic and keyword scores, and their blend; the semantic one is rounded before it is blended."""
    semantic = _ranked(t, -2.0).select("grant_id", scores.clamp_score(F.round("similarity", 6) * 100).alias("semantic"))
    both = semantic.join(_keyword(t, semantic).select("grant_id", "keyword"), "grant_id")
    return both.select("grant_id", "semantic", "keyword", scores.blend(F.col("semantic"), F.col("keyword")).alias("score"))


@query(f"WITH {_KW_SQL} SELECT grant_id, keyword FROM kw ORDER BY keyword DESC NULLS LAST, grant_id LIMIT 25 OFFSET 10")
def keyword_deck(t: Tables) -> DataFrame:
    return _keyword(t).select("grant_id", "keyword").orderBy(F.desc_nulls_last("keyword"), "grant_id").offset(10).limit(25)


@query("SELECT event_id, CASE WHEN value IS NOT NULL THEN greatest(0, least(100, CAST(round_even(value, 0) AS INTEGER))) END AS score FROM events")
def clamp_score(t: Tables) -> DataFrame:
    return t.events.select("event_id", scores.clamp_score(F.col("value")).alias("score"))


@query("""WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 0.0 ELSE c_acctbal END AS amount FROM customer)
SELECT CASE WHEN amount IS NULL THEN 'not_published' WHEN amount > 0 THEN 'value' WHEN amount = 0 THEN 'zero' ELSE 'negative' END AS state, count(*) AS awards, round(coalesce(sum(CASE WHEN amount > 0 THEN amount END), 0), 2) AS total FROM a GROUP BY 1""")
def amount_state(t: Tables) -> DataFrame:
    amount = F.when(F.col("c_custkey") % 11 == 0, None).when(F.col("c_custkey") % 7 == 0, 0.0).otherwise(F.col("c_acctbal"))
    stated = t.customer.select(amount.alias("amount")).withColumn("state", scores.amount_state(F.col("amount")))
    return stated.groupBy("state").agg(F.count("*").alias("awards"), F.round(F.coalesce(F.sum(F.when(F.col("amount") > 0, F.col("amount"))), F.lit(0.0)), 2).alias("total"))


_DECK_SQL = f"""WITH {_SIM_SQL}, placed AS (SELECT grant_id, label, row_number() OVER (ORDER BY s DESC, grant_id) AS position, count(*) OVER () AS n FROM sim WHERE s > -0.3),
kept AS (SELECT * FROM placed WHERE position > 30 AND position <= 130 AND label % 3 = 0 ORDER BY position LIMIT 12),
e AS (SELECT count(*) AS k, max(position) AS last FROM kept), m AS (SELECT count(*) AS n FROM sim WHERE s > -0.3)
"""


@query(_DECK_SQL + """SELECT CASE WHEN k = 12 THEN last WHEN n - 30 < 100 THEN greatest(n, 30) ELSE 130 END AS next_offset,
CASE WHEN k = 12 THEN last = n AND (n - 30) % 20 <> 0 ELSE n - 30 < 100 END AS exhausted FROM e, m""")
def deck_raw_offset_state(t: Tables) -> DataFrame:
    return _deck(t).state


@query(_DECK_SQL + "SELECT grant_id, CAST(position AS INTEGER) AS position FROM kept")
def deck_raw_offset_paging(t: Tables) -> DataFrame:
    return _deck(t).rows.select("grant_id", "position")


def _deck(t: Tables) -> R.Page:
    ranked = _ranked(t, -0.3).join(t.embeddings.select(F.col("vec_id").alias("grant_id"), "label"), "grant_id")
    return R.raw_offset_page(ranked, F.col("label") % 3 == 0, limit=12, offset=30, batch=20, calls=5, order=[F.desc("similarity"), F.col("grant_id")])


@query(f"WITH {_SIM_SQL} SELECT s.grant_id, coalesce(CASE WHEN s.grant_id % 2 = 0 THEN 'hit' END, d.lang) AS lang, d.source FROM sim s LEFT JOIN documents d ON d.doc_id = s.grant_id WHERE s.s > 0.1")
def detail_coalesce_join(t: Tables) -> DataFrame:
    hits = _ranked(t, 0.1).select("grant_id", F.when(F.col("grant_id") % 2 == 0, "hit").alias("lang"))
    details = t.documents.select(F.col("doc_id").alias("grant_id"), "lang", "source")
    return R.with_details(hits, details, "grant_id", ["lang"], ["source"])


@query(f"WITH {SWIPES_SQL}, r AS (SELECT s.grant_id, s.status, CASE WHEN d.n_chars % 5 <> 0 THEN CAST(d.n_chars % 101 AS INTEGER) END AS score FROM swipes s JOIN documents d ON d.doc_id = s.grant_id WHERE s.status <> 'skipped') SELECT grant_id, status, coalesce(score, -1) AS score, row_number() OVER (ORDER BY status <> 'emailed', coalesce(score, 0) DESC, grant_id) AS place FROM r ORDER BY place LIMIT 50")
def saved_list_order(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    score = F.when(F.col("n_chars") % 5 != 0, (F.col("n_chars") % 101).cast("int"))
    rows = t.swipes().where("status <> 'skipped'").join(t.documents.select(F.col("doc_id").alias("grant_id"), score.alias("score")), "grant_id")
    first = R.saved_order(rows).limit(50)
    placed = first.withColumn("place", F.row_number().over(Window.orderBy(F.col("status") != "emailed", F.desc(F.coalesce("score", F.lit(0))), "grant_id")).cast("long"))
    return placed.withColumn("score", F.coalesce("score", F.lit(-1)))


@query(f"""WITH {AWARDS_SQL}, act AS (SELECT award, person, "end" FROM awards WHERE "end" IS NULL OR "end" >= DATE '{TODAY}'),
o AS (SELECT a.award, b.award AS other, row_number() OVER (PARTITION BY a.award ORDER BY b."end" DESC NULLS FIRST, b.award) AS k FROM awards a JOIN act b ON a.person = b.person AND a.award <> b.award)
SELECT award, coalesce(string_agg(CAST(other AS VARCHAR), ',' ORDER BY k) FILTER (WHERE k <= 5), '') AS others FROM awards LEFT JOIN o USING (award) GROUP BY award""")
def other_awards_top5(t: Tables) -> DataFrame:
    found = R.other_awards(t.awards(), F.lit(TODAY).cast("date"))
    return found.select("award", F.array_join("others", ",").alias("others"))


@query(f"WITH {SWIPES_SQL} SELECT d.doc_id AS grant_id, s.status FROM documents d LEFT JOIN swipes s ON s.grant_id = d.doc_id")
def match_status_left_join(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("grant_id")).join(t.swipes(), "grant_id", "left")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def in_list_semi_join(t: Tables) -> DataFrame:
    wanted = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(wanted, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 40")
def keyset_page(t: Tables) -> DataFrame:
    return R.keyset_page(t.documents.select("doc_id", "lang", "n_chars"), 100, 40, "doc_id")


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 30 OFFSET 60")
def offset_page(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang").orderBy("doc_id").offset(60).limit(30)


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id = 7")
def point_lookup(t: Tables) -> DataFrame:
    return t.documents.where("doc_id = 7").select("doc_id", "lang", "n_chars")


@query("SELECT doc_id, source FROM documents WHERE lang IN ('en', 'fr') AND n_chars >= 500 AND source IS NOT NULL AND NOT (source = 'src1')")
def dynamic_predicates(t: Tables) -> DataFrame:
    """Conditions chosen by flags, chained; all of them reach the scan."""
    rows, flags = t.documents, {"languages": ["en", "fr"], "least": 500, "not_source": "src1"}
    rows = rows.where(F.col("lang").isin(*flags["languages"])) if flags.get("languages") else rows
    rows = rows.where(F.col("n_chars") >= flags["least"]) if flags.get("least") else rows
    rows = rows.where(F.col("source").isNotNull() & (F.col("source") != flags["not_source"])) if flags.get("not_source") else rows
    return rows.select("doc_id", "source")


_ROLE = "CASE CAST(substr(source, 4) AS INTEGER) % 4 WHEN 0 THEN 'NIH' WHEN 1 THEN 'NSF' WHEN 2 THEN CASE WHEN doc_id % 2 = 0 THEN 'NASA' ELSE 'DNR' END ELSE 'DOE' END"
_NAME = "CASE WHEN doc_id % 3 = 0 THEN 'Dr. Unknown Investigator' WHEN doc_id % 3 = 1 THEN ' ' ELSE 'Dr. Ann Lee' END"


def _sourced(t: Tables) -> DataFrame:
    n = F.substring("source", 4, 9).cast("int") % 4
    source = F.when(n == 0, "NIH").when(n == 1, "NSF").when(n == 2, F.when(F.col("doc_id") % 2 == 0, "NASA").otherwise("DNR")).otherwise("DOE")
    k = F.col("doc_id") % 3
    name = F.when(k == 0, text.UNRESOLVED_PI).when(k == 1, " ").otherwise("Dr. Ann Lee")
    return t.documents.select("doc_id", source.alias("funder"), name.alias("pi"))


@query(f"WITH d AS (SELECT doc_id, {_ROLE} AS funder, {_NAME} AS pi FROM documents) SELECT funder, count(*) FILTER (WHERE funder IN ('NASA', 'DOE', 'DNR')) AS off, count(*) FILTER (WHERE funder IN ('NASA', 'DOE', 'DNR') AND pi <> 'Dr. Ann Lee') AS resolved_only FROM d GROUP BY funder")
def source_exclusion(t: Tables) -> DataFrame:
    off, only = R.excluded(F.col("funder"), F.col("pi")), R.excluded(F.col("funder"), F.col("pi"), "resolved_only")
    return _sourced(t).groupBy("funder").agg(F.count_if(off).alias("off"), F.count_if(only).alias("resolved_only"))


@query(f"""WITH d AS (SELECT doc_id, {_ROLE} AS funder, {_NAME} AS pi FROM documents) SELECT doc_id,
CASE WHEN pi = 'Dr. Ann Lee' THEN 'https://www.google.com/search?q=%22Ann+Lee%22+Rice+University+lab+contact' END AS person_url,
CASE funder WHEN 'NIH' THEN 'https://reporter.nih.gov/project-details/' || doc_id WHEN 'NSF' THEN 'https://www.nsf.gov/awardsearch/showAward?AWD_ID=' || doc_id END AS record_url FROM d""")
def lookup_urls(t: Tables) -> DataFrame:
    return _sourced(t).select("doc_id", text.lookup_url(F.col("pi"), F.lit("Rice University")).alias("person_url"), text.record_url(F.col("funder"), F.col("doc_id").cast("string")).alias("record_url"))
