"""Duplicates, upserts, state changes and checks of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import tables as O
from tessera.plans.base import AWARDS_SQL, SWIPES_SQL, Tables, query

_GRANTS_SQL = """grants AS (SELECT doc_id AS id, CASE WHEN doc_id % 17 <> 0 THEN md5(text) END AS award_id, doc_id % 4 <> 1 AS has_vector, source, lang,
  CASE WHEN doc_id % 5 <> 0 THEN CAST(n_chars AS DOUBLE) END AS amount, substr(text, 1, 40) AS title FROM documents),
ranked AS (SELECT id, award_id, first_value(id) OVER (PARTITION BY award_id ORDER BY has_vector DESC, id) AS keeper FROM grants WHERE award_id IS NOT NULL),
losers AS (SELECT id AS loser, keeper FROM ranked WHERE id <> keeper)"""


def _grants(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    return t.documents.select(
        d.alias("id"), F.when(d % 17 != 0, F.md5("text")).alias("award_id"), (d % 4 != 1).alias("has_vector"), "source", "lang",
        F.when(d % 5 != 0, F.col("n_chars").cast("double")).alias("amount"), F.substring("text", 1, 40).alias("title"),
    )


def _losers(t: Tables) -> DataFrame:
    return O.keepers(_grants(t).where("award_id is not null"), [F.col("award_id")], [F.col("has_vector")])


@query(f"WITH {_GRANTS_SQL} SELECT loser, keeper FROM losers")
def keeper_first_value(t: Tables) -> DataFrame:
    """Losers and keepers of awards with one id; an award with a vector is kept first."""
    return _losers(t)


@query(f"""WITH {_GRANTS_SQL}, r AS (SELECT id, first_value(id) OVER (PARTITION BY title, source, lang, coalesce(amount, -1) ORDER BY has_vector DESC, id) AS keeper FROM grants)
SELECT id AS loser, keeper FROM r WHERE id <> keeper""")
def keeper_many_keys(t: Tables) -> DataFrame:
    """Duplicates by several columns, in which missing values are equal."""
    keys = [F.col("title"), F.col("source"), F.col("lang"), O.filled("amount", "double")]
    return O.keepers(_grants(t), keys, [F.col("has_vector")])


@query(f"WITH {_GRANTS_SQL} SELECT title, lang, count(*) AS copies, count(DISTINCT coalesce(amount, -1)) AS amounts FROM grants GROUP BY 1, 2 HAVING count(*) > 1")
def dup_group_report(t: Tables) -> DataFrame:
    return _grants(t).groupBy("title", "lang").agg(F.count("*").alias("copies"), F.count_distinct(O.filled("amount", "double")).alias("amounts")).where("copies > 1")


_MATCHES_SQL = "matches AS (SELECT doc_id AS match_id, doc_id AS grant_id, doc_id % 3 AS student_id FROM documents WHERE doc_id % 2 = 0)"
_REPOINT_SQL = f"""{_GRANTS_SQL}, {_MATCHES_SQL}, m AS (SELECT m.*, l.keeper FROM matches m LEFT JOIN losers l ON l.loser = m.grant_id),
moved AS (SELECT match_id, keeper AS grant_id, student_id, row_number() OVER (PARTITION BY student_id, keeper ORDER BY match_id) AS k FROM m
  WHERE keeper IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m h WHERE h.keeper IS NULL AND h.student_id = m.student_id AND h.grant_id = m.keeper)),
pointed AS (SELECT match_id, grant_id, student_id FROM m WHERE keeper IS NULL UNION ALL SELECT match_id, grant_id, student_id FROM moved WHERE k = 1)"""


def _pointed(t: Tables) -> DataFrame:
    matches = t.documents.where("doc_id % 2 = 0").select(F.col("doc_id").alias("match_id"), F.col("doc_id").alias("grant_id"), (F.col("doc_id") % 3).alias("student_id"))
    return O.repoint(matches, _losers(t))


@query(f"WITH {_REPOINT_SQL} SELECT * FROM pointed")
def repoint_matches(t: Tables) -> DataFrame:
    return _pointed(t)


@query(f"WITH {_GRANTS_SQL} SELECT id, lang FROM grants WHERE id NOT IN (SELECT loser FROM losers)")
def delete_losers(t: Tables) -> DataFrame:
    return _grants(t).select("id", "lang").join(_losers(t).select(F.col("loser").alias("id")), "id", "left_anti")


@query(f"WITH {_REPOINT_SQL}, left_ AS (SELECT id FROM grants WHERE id NOT IN (SELECT loser FROM losers) AND id % 6 <> 0) SELECT match_id FROM pointed WHERE grant_id IN (SELECT id FROM left_)")
def cascade_orphans(t: Tables) -> DataFrame:
    """Matches that are left when some awards are deleted."""
    left = _grants(t).join(_losers(t).select(F.col("loser").alias("id")), "id", "left_anti").where("id % 6 <> 0")
    return O.without_orphans(_pointed(t), left, "grant_id", "id").select("match_id")


_UP_SQL = """old AS (SELECT c_custkey AS k, c_name AS name, c_acctbal AS amount, c_mktsegment AS segment FROM customer WHERE c_custkey % 3 <> 0),
new AS (SELECT CASE WHEN c_custkey % 10 <> 0 THEN c_custkey END AS k, upper(c_name) AS name, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal + 1 END AS amount FROM customer WHERE c_custkey % 2 = 0)"""


@query(f"""WITH {_UP_SQL} SELECT coalesce(o.k, n.k, -1) AS k, CASE WHEN n.k IS NOT NULL THEN n.name ELSE o.name END AS name, CASE WHEN n.k IS NOT NULL THEN n.amount ELSE o.amount END AS amount, o.segment
FROM old o FULL JOIN (SELECT * FROM new WHERE k IS NOT NULL) n ON o.k = n.k UNION ALL SELECT -1, name, amount, NULL FROM new WHERE k IS NULL""")
def upsert_on_key(t: Tables) -> DataFrame:
    """New rows over old ones by key; a column that the new rows lack stays, rows without a key are added."""
    k = F.col("c_custkey")
    old = t.customer.where(k % 3 != 0).select(k.alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount"), F.col("c_mktsegment").alias("segment"))
    new = t.customer.where(k % 2 == 0).select(F.when(k % 10 != 0, k).alias("k"), F.upper("c_name").alias("name"), F.when(k % 4 != 0, F.col("c_acctbal") + 1).alias("amount"))
    return O.upsert(old, new, ["k"]).withColumn("k", F.coalesce("k", F.lit(-1)))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal + 1 WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS amount FROM customer")
def shed_unread_columns(t: Tables) -> DataFrame:
    """A missing new value erases the stored one only where the agency was asked."""
    k = F.col("c_custkey")
    new, asked = F.when(k % 4 != 0, F.col("c_acctbal") + 1), F.when(k % 3 == 0, F.lit("2026-01-01"))
    return t.customer.select(k.alias("k"), O.keep_unread(new, F.col("c_acctbal"), asked).alias("amount"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders")
def conditional_update(t: Tables) -> DataFrame:
    hit = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000)
    return O.update_where(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), hit, {"o_orderstatus": F.lit("X"), "o_totalprice": F.lit(0.0)})


@query(f"WITH {_GRANTS_SQL} SELECT id, lang FROM (SELECT *, row_number() OVER (PARTITION BY award_id ORDER BY id) AS k FROM grants) WHERE k = 1 OR award_id IS NULL")
def batch_first_wins(t: Tables) -> DataFrame:
    return O.first_of_batch(_grants(t), "award_id", ["id"]).select("id", "lang")


_KEY = r"lower(trim(regexp_replace(title, '\s+', ' ', 'g')))"


@query(f"WITH {_GRANTS_SQL}, k AS (SELECT id, {_KEY} AS key FROM grants), f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id) AS n FROM k WHERE id % 3 <> 0 AND key NOT IN (SELECT key FROM k WHERE id % 3 = 0)) SELECT id FROM f WHERE n = 1")
def title_key_anti_join(t: Tables) -> DataFrame:
    """Found awards whose title is neither stored nor found before."""
    key = text.normal_key(F.col("title"))
    rows = _grants(t).select("id", "title")
    held = rows.where("id % 3 = 0").select(key.alias("title_key"))
    return O.new_titles(rows.where("id % 3 <> 0"), held, key, ["id"]).select("id")


_OUT_SQL = f"{SWIPES_SQL}, m AS (SELECT grant_id AS match_id, status, CASE WHEN grant_id % 4 = 0 THEN 'sent' END AS outreach_status, CASE WHEN grant_id % 8 = 0 THEN 'before' END AS responded_at FROM swipes), c AS (SELECT match_id, CASE match_id % 4 WHEN 0 THEN 'replied' WHEN 1 THEN 'no_reply' WHEN 2 THEN 'nonsense' ELSE 'joined' END AS nxt FROM m WHERE match_id % 5 <> 0)"


@query(f"""WITH {_OUT_SQL} SELECT m.match_id, m.status, CASE WHEN status = 'emailed' AND nxt <> 'nonsense' THEN nxt ELSE outreach_status END AS outreach_status,
CASE WHEN status = 'emailed' AND nxt IN ('replied', 'joined') THEN coalesce(responded_at, 'now') ELSE responded_at END AS responded_at FROM m LEFT JOIN c USING (match_id)""")
def outreach_transition(t: Tables) -> DataFrame:
    m = t.swipes().select(F.col("grant_id").alias("match_id"), "status", F.when(F.col("grant_id") % 4 == 0, "sent").alias("outreach_status"), F.when(F.col("grant_id") % 8 == 0, "before").alias("responded_at"))
    k = F.col("match_id") % 4
    changes = m.where("match_id % 5 <> 0").select("match_id", F.when(k == 0, "replied").when(k == 1, "no_reply").when(k == 2, "nonsense").otherwise("joined").alias("outreach_status"))
    return O.outreach_change(m, changes, F.lit("now"))


@query(f"WITH {SWIPES_SQL} SELECT grant_id AS match_id, CASE WHEN grant_id % 3 = 0 THEN 'emailed' ELSE status END AS status, CASE WHEN grant_id % 3 = 0 THEN CASE WHEN grant_id % 6 = 0 THEN 'replied' ELSE 'sent' END WHEN grant_id % 6 = 0 THEN 'replied' END AS outreach_status, CASE WHEN grant_id % 3 = 0 THEN CASE WHEN grant_id % 9 = 0 THEN 'before' ELSE 'now' END WHEN grant_id % 9 = 0 THEN 'before' END AS contacted_at FROM swipes")
def first_contact(t: Tables) -> DataFrame:
    """A sent mail stamps the first contact once and does not take back an answer."""
    g = F.col("grant_id")
    m = t.swipes().select(g.alias("match_id"), "status", F.when(g % 6 == 0, "replied").alias("outreach_status"), F.when(g % 9 == 0, "before").alias("contacted_at"))
    return O.first_contact(m, m.where("match_id % 3 = 0").select("match_id"), F.lit("now"))


@query(f"WITH {SWIPES_SQL} SELECT grant_id, status FROM swipes WHERE status <> 'skipped'")
def reset_skipped(t: Tables) -> DataFrame:
    return t.swipes().where("status <> 'skipped'")


@query(f"WITH {SWIPES_SQL} SELECT status, count(*) AS matches FROM swipes GROUP BY 1")
def status_counts(t: Tables) -> DataFrame:
    return t.swipes().groupBy("status").agg(F.count("*").alias("matches"))


@query("""WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'Q' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 70 = 0 THEN NULL ELSE o_orderpriority END AS p, o_orderstatus, o_orderpriority FROM orders)
SELECT o_orderkey, 'o_orderstatus' AS "column", o_orderstatus AS old, s AS new FROM n WHERE s <> o_orderstatus UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority, p FROM n WHERE p IS DISTINCT FROM o_orderpriority""")
def change_log(t: Tables) -> DataFrame:
    """What a rewrite of the table would change, value by value."""
    old = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    k = F.col("o_orderkey")
    new = old.select("o_orderkey", F.when(k % 50 == 0, "Q").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(k % 70 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    return O.change_log(old, new, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("""SELECT 'unique' AS rule, coalesce(CAST(sum(n) AS BIGINT), 0) AS rows FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type HAVING count(*) > 1)
UNION ALL SELECT 'not null value', count(*) FILTER (WHERE value IS NULL) FROM events UNION ALL SELECT 'allowed event_type', count(*) FILTER (WHERE event_type NOT IN ('view', 'click', 'signup')) FROM events
UNION ALL SELECT 'foreign user_id', count(*) FROM events WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0)""")
def constraint_checks(t: Tables) -> DataFrame:
    return O.key_faults(t.events, ["user_id", "event_type"], ["value"], {"event_type": ("view", "click", "signup")}, {"user_id": (t.supplier.where("s_suppkey % 3 <> 0"), "s_suppkey")})


@query("SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 500) AS BIGINT) AS batch FROM orders")
def export_batches(t: Tables) -> DataFrame:
    return O.batches(t.orders.select("o_orderkey"), 500, "o_orderkey")


@query(f"WITH {AWARDS_SQL}, a AS (SELECT award, amount FROM awards WHERE award % 2 = 0), b AS (SELECT award, person FROM awards WHERE award % 2 = 1) SELECT award, amount, -1::BIGINT AS person FROM a UNION ALL SELECT award, NULL, person FROM b")
def union_of_sources(t: Tables) -> DataFrame:
    """Sources with different columns as one table."""
    awards = t.awards()
    return awards.where("award % 2 = 0").select("award", "amount").unionByName(awards.where("award % 2 = 1").select("award", "person"), allowMissingColumns=True).withColumn("person", F.coalesce("person", F.lit(-1)))
