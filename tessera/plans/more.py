"""Smaller rules on text, swipes and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import names, scores, sentences, text
from tessera.operators import model_stage
from tessera.operators import tables as O
from tessera.plans.base import SWIPES_SQL, Tables, query


@query("""SELECT n_nationkey, 'University of ' || w || ' at MIT' AS name FROM (SELECT n_nationkey, split_part(n_name, ' ', 1) AS w FROM nation)""")
def institution_name(t: Tables) -> DataFrame:
    named = F.concat(F.lit("UNIVERSITY OF "), F.split("n_name", " ")[0], F.lit(" AT MIT"))
    return t.nation.select("n_nationkey", names.institution(named).alias("name"))


_WORDS_SQL = "array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')"


@query(f"""SELECT c_custkey, {_WORDS_SQL.format('c_mktsegment')} || ' Inst of the ' || n_name || ', NCI-Univ, The' AS capitals, {_WORDS_SQL.format('c_mktsegment')} || ' College of VA, Women''s Hosp' AS stored, {_WORDS_SQL.format('c_mktsegment')} AS city
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def names_of_places(t: Tables) -> DataFrame:
    """Institutions and cities that an agency writes in capitals, or that were stored in title case."""
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    capitals = F.concat("c_mktsegment", F.lit(" INST OF THE "), "n_name", F.lit(", NCI-UNIV, THE"))
    stored = F.concat(F.initcap("c_mktsegment"), F.lit(" College Of Va, Women'S Hosp"))
    written = rows.select("c_custkey", capitals.alias("in_capitals"), stored.alias("in_title_case"), F.col("c_mktsegment").alias("of_city"))
    rule = lambda a, b, c: [names.institution(a).alias("capitals"), names.stored_institution(b).alias("stored"), names.institution(c, city=True).alias("city")]
    return O.once_per_value(written, ["in_capitals", "in_title_case", "of_city"], rule).select("c_custkey", "capitals", "stored", "city")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Ann ' || CASE WHEN c_mktsegment LIKE 'MACH%' THEN c_mktsegment ELSE upper(c_mktsegment[1:1]) || lower(c_mktsegment[2:]) END WHEN 1 THEN 'ANN ' || c_mktsegment WHEN 2 THEN 'Ann KY ' || c_mktsegment ELSE 'Mary O''NEILL ' || c_mktsegment END AS name FROM customer""")
def names_of_people(t: Tables) -> DataFrame:
    """Names of which the agency itself writes a part in small letters, and others, which stay."""
    k, part = F.col("c_custkey") % 4, F.col("c_mktsegment")
    raw = F.when(k == 0, F.concat(F.lit("Ann "), part)).when(k == 1, F.concat(F.lit("ANN "), part)).when(k == 2, F.concat(F.lit("Ann KY "), part)).otherwise(F.concat(F.lit("Mary O'NEILL "), part))
    return t.customer.select("c_custkey", names.person(raw).alias("name"))


@query(f"""WITH {SWIPES_SQL}, m AS (SELECT 's' AS student_id, grant_id, status, CASE WHEN grant_id % 4 = 0 THEN 50 END AS score FROM swipes WHERE grant_id % 2 = 0),
w AS (SELECT 's' AS student_id, grant_id, CASE WHEN grant_id % 5 = 0 THEN 'saved' WHEN grant_id % 5 = 1 THEN 'nonsense' ELSE 'skipped' END AS status, CASE WHEN grant_id % 3 = 0 THEN 77 END AS score, (grant_id % 7) / 4.0::DOUBLE AS dot FROM swipes WHERE grant_id % 3 <> 1),
v AS (SELECT * FROM w WHERE status <> 'nonsense')
SELECT student_id, grant_id, coalesce(v.status, m.status) AS status, coalesce(CASE WHEN v.status IS NULL THEN m.score ELSE coalesce(v.score, m.score, greatest(0, least(100, CAST(round_even(100 * dot, 0) AS INTEGER)))) END, -1) AS score FROM m FULL JOIN v USING (student_id, grant_id)""")
def match_state_merge(t: Tables) -> DataFrame:
    """Matches after a round of swipes."""
    g = F.col("grant_id")
    m = t.swipes().where(g % 2 == 0).select(F.lit("s").alias("student_id"), "grant_id", "status", F.when(g % 4 == 0, 50).alias("score"))
    w = t.swipes().where(g % 3 != 1).select(F.lit("s").alias("student_id"), "grant_id", F.lit(1).alias("at"), F.when(g % 5 == 0, "saved").when(g % 5 == 1, "nonsense").otherwise("skipped").alias("status"), F.when(g % 3 == 0, 77).alias("score"), ((g % 7) / 4.0).alias("dot"))
    older = w.withColumn("at", F.lit(0)).withColumn("status", F.lit("emailed"))
    return O.match_states(m, w.unionByName(older.where("status = 'saved'"))).withColumn("score", F.coalesce("score", F.lit(-1)))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'This project tests ' || p_name ELSE 'The lab tests ' || p_name END AS sentence FROM part")
def with_subject(t: Tables) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Tests "), "p_name")).otherwise(F.concat(F.lit("The lab tests "), "p_name"))
    return t.part.select("p_partkey", text.with_subject(raw).alias("sentence"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name END AS sentence FROM part")
def parse_model_answer(t: Tables) -> DataFrame:
    """Answers with and without a code fence; what is no JSON object is none."""
    k, body = F.col("p_partkey") % 3, F.to_json(F.struct(F.col("p_name").alias("sentence")))
    raw = F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 1, body).otherwise(F.concat(F.lit("Sure: "), body))
    return t.part.select("p_partkey", text.parse_answer(raw)["sentence"].alias("sentence"))


@query(r"SELECT doc_id, nullif(regexp_extract(text, '(?i)(^|[^\pL\pN_])(that)([^\pL\pN_]|$)', 2), '') AS found FROM documents")
def verbatim_term(t: Tables) -> DataFrame:
    """A term as the text writes it."""
    return t.documents.select("doc_id", text.verbatim_in(F.lit("THAT"), [F.lit(None).cast("string"), F.col("text")]).alias("found"))


@query("SELECT o_orderkey, o_orderpriority || '|' || o_orderstatus AS v FROM orders WHERE lower(o_orderpriority) <= lower(o_orderstatus)")
def sort_ignoring_case(t: Tables) -> DataFrame:
    both = F.array_join(text.sorted_ignoring_case(F.array("o_orderstatus", "o_orderpriority")), "|")
    return t.orders.select("o_orderkey", both.alias("v")).where(F.startswith("v", F.lit("1")) | F.startswith("v", F.lit("2")) | F.startswith("v", F.lit("3")) | F.startswith("v", F.lit("4")) | F.startswith("v", F.lit("5")))


@query("WITH a AS (SELECT DISTINCT s_suppkey AS id FROM supplier WHERE s_suppkey % 2 = 0) SELECT 'not_asked' AS fault, count(*) FILTER (WHERE s_suppkey % 2 = 1) AS rows FROM supplier UNION ALL SELECT 'too_many', count(*) - (SELECT count(*) FROM a) FROM supplier UNION ALL SELECT 'missing_key', count(*) FILTER (WHERE s_suppkey % 5 = 0) FROM supplier")
def record_batch_faults(t: Tables) -> DataFrame:
    """What is wrong with a batch of records that an agency sent."""
    k = F.col("s_suppkey")
    asked = t.supplier.where(k % 2 == 0).select(k.alias("id"))
    sent = t.supplier.select(k.alias("id"), F.when(k % 5 == 0, "{}").otherwise('{"title": null}').alias("record"))
    return O.answer_faults(asked, sent, ["title"])


@query("SELECT vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])), 6) AS dot FROM embeddings")
def dot_products(t: Tables) -> DataFrame:
    probe = t.embeddings.where("vec_id = 0").select("embedding").first()[0]
    return t.embeddings.select("vec_id", F.round(scores.dot(F.col("embedding"), scores.vector(probe)), 6).alias("dot"))


@query("SELECT doc_id, length(text) <= 300 AS whole FROM documents")
def cut_at_sentence_end(t: Tables) -> DataFrame:
    """Whether a text fits a model's input whole; longer ones end with a sentence."""
    cut = sentences.cut_at_sentence_end(F.col("text"), 300)
    return t.documents.select("doc_id", ((F.length(cut) <= 300) & (cut == F.col("text"))).alias("whole"))


@query("SELECT s_suppkey, upper(s_name) AS answer FROM supplier")
def model_answers(t: Tables) -> DataFrame:
    """A stage that asks a function given to it."""
    return model_stage.ask(t.supplier.select("s_suppkey", F.col("s_name").alias("prompt")), "prompt", str.upper).select("s_suppkey", "answer")


@query()
def evidence_quotes(t: Tables) -> DataFrame:
    """Quoted sentences with all terms found in them."""
    each = t.documents.select(F.col("doc_id").alias("award"), "text", F.explode(F.array(F.lit("the"), F.lit("that"))).alias("term"))
    found = each.select("award", "term", sentences.evidence(F.col("term"), F.col("text"))["sentence"].alias("sentence")).where("sentence is not null")
    return O.quotes(found).select("award", "sentence", F.array_join("terms", "|").alias("terms"))
