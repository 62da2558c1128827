"""Terms, people, places and kinds on cards; changes to matches and pages of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import awards, lists, people, profile, records, scores, text
from tessera.operators import cards as C
from tessera.operators import evidence
from tessera.operators import metrics as M
from tessera.operators import profiles
from tessera.operators import quality as Q
from tessera.operators import tables as O
from tessera.operators import terms
from tessera.plans.base import AWARDS_SQL, SWIPES_SQL, TODAY, Tables, query
from tessera.sources import tables

_KNOWN = ["the", "that", "de la", "und"]
_KNOWN_SQL = "['the', 'that', 'de la', 'und']"
_HAS = r"""regexp_matches({0}, CASE w WHEN 'the' THEN '(^|[^\pL\pN_])the([^\pL\pN_]|$)' WHEN 'that' THEN '(?i)(^|[^\pL\pN_])that([^\pL\pN_]|$)' WHEN 'de la' THEN '(?i)(^|[^\pL\pN_])de\s+la([^\pL\pN_]|$)' ELSE '(^|[^\pL\pN_])und([^\pL\pN_]|$)' END)"""


def _spelt(code: str, choices: list[str], other: str | None = None) -> Column:
    out = F.when(F.expr(f"{code} % {len(choices) + 1} = 0"), choices[0])
    for k, c in enumerate(choices[1:], 1):
        out = out.when(F.expr(f"{code} % {len(choices) + 1} = {k}"), c)
    return out.otherwise(other)


@query(rf"""WITH h AS (SELECT doc_id, list_filter({_KNOWN_SQL}, lambda w: {_HAS.format("substr(text, 1, 60)")}) AS t, list_filter({_KNOWN_SQL}, lambda w: {_HAS.format("text")}) AS a FROM documents)
SELECT doc_id, CAST(len(list_distinct(list_concat(t, a))) AS INTEGER) AS total, CAST(least(3, len(list_distinct(list_concat(t, a)))) AS INTEGER) AS shown, CASE WHEN len(t) > 0 THEN 'title' WHEN len(a) > 0 THEN 'abstract' ELSE 'none' END AS first_field FROM h""")
def front_profile_hits(t: Tables) -> DataFrame:
    """The chips of each card for one student's terms, title before abstract."""
    terms = F.array(*[F.struct(F.lit(w).alias("term"), F.lit("narrative").alias("origin")) for w in _KNOWN])
    hits = profile.front_hits(terms, F.substring("text", 1, 60), F.lit(None).cast("string"), F.col("text"))
    return t.documents.select("doc_id", hits.alias("h")).select("doc_id", F.col("h.total").alias("total"), F.size("h.rows").alias("shown"), F.coalesce(F.get("h.rows", F.lit(0))["field"], F.lit("none")).alias("first_field"))


_LETTERS = ["analysed in {} and more", "software ({}/Python) packages", "{}&D spending", "I/{} injury", "{}-loop", "{}++ code", "{}. elegans", "Todd {}. Manini", "ends in {}. We go on"]


@query("SELECT p_partkey, CASE WHEN p_partkey % 10 IN (0, 1, 8) THEN 1 ELSE 0 END AS n FROM part")
def single_letter_guard(t: Tables) -> DataFrame:
    """A single letter counts only where it stands as a word."""
    letter = F.expr("chr(65 + p_partkey % 7)")
    value = F.regexp_replace(_spelt("p_partkey", _LETTERS, "nothing at all"), r"\{\}", "@")
    return t.part.select("p_partkey", profile.places(letter, F.replace(value, F.lit("@"), letter))["n"].alias("n"))


@query("SELECT p_partkey, p_partkey % 5 IN (0, 1, 2) AS in_name FROM part")
def capitalised_name_run(t: Tables) -> DataFrame:
    """Whether a term stands inside of a name."""
    value = _spelt("p_partkey", ["Ecology and Evolutionary Biology", "at the Department of Biology", "Biology, Chemistry", "we like Biology here"], "the field of Biology is old")
    at = F.instr(value, "Biology") - 1
    return t.part.select("p_partkey", profile.in_name_run(value, at, F.lit("Biology")).alias("in_name"))


@query(rf"SELECT doc_id, array_to_string(list_filter({_KNOWN_SQL}, lambda w: {_HAS.format('text')}), '|') AS found FROM documents")
def own_text_scan(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(profile.own_text_scan(_KNOWN, F.col("text")), "|").alias("found"))


@query()
def term_window(t: Tables) -> DataFrame:
    """A bounded window around the first mention of a term."""
    found = profile.places(F.lit("that"), F.col("text"))
    rows = t.documents.select("doc_id", "text", found.alias("f")).where("f.n > 0")
    cut = profile.window(F.col("text"), F.col("f.at"), F.col("f.at") + F.length("f.shown"))
    return rows.select("doc_id", cut.alias("w")).select("doc_id", "w.*")


_CODES_SQL = " UNION ALL ".join(f"SELECT '{c}' AS code, '{kind}' AS kind" for kind, codes in awards.CODES.items() for c in codes.split())
_CODE_LIST = [c for codes in awards.CODES.values() for c in codes.split()]


@query(f"""WITH k AS ({_CODES_SQL}), c AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % {len(_CODE_LIST) + 1} = {len(_CODE_LIST)} THEN 'X99' ELSE ({[*_CODE_LIST]})[p_partkey % {len(_CODE_LIST) + 1} + 1] END AS code FROM part)
SELECT p_partkey, CASE WHEN p_size % 11 = 0 THEN 'subproject' ELSE kind END AS kind FROM c LEFT JOIN k USING (code)""")
def kind_by_code(t: Tables) -> DataFrame:
    """What an award is by its activity code; a part of a larger one is that before all."""
    code = F.lower(_spelt("p_partkey", _CODE_LIST, "X99"))
    return t.part.select("p_partkey", awards.kind_by_code(code, F.when(F.col("p_size") % 11 == 0, F.col("p_size").cast("string"))).alias("kind"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Institute of ' || p_name WHEN 1 THEN 'Biological Sciences' WHEN 2 THEN 'Technology, Innovation, and Partnerships' END AS label FROM part""")
def card_field_line(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 5
    funder = F.when(k == 0, F.concat(F.lit("Institute of  "), "p_name")).when(k == 1, "directorate for Biological Sciences, Division of X").when(k == 2, "Directorate for Technology, Innovation, and Partnerships").when(k == 3, "Office Of The Director, X").otherwise(" ")
    return t.part.select("p_partkey", awards.field_line(F.when(k == 0, "NIH").otherwise("NSF"), funder)["label"].alias("label"))


@query("""SELECT s_suppkey, 'A' || s_suppkey AS award_id, CASE WHEN s_suppkey % 7 <> 0 THEN s_name END AS grant_title, 'Smith-Jones A/B-C' AS university, CASE WHEN s_suppkey % 3 = 0 THEN 'Sub Agency' END AS department,
CASE s_suppkey % 3 WHEN 0 THEN 'DOD' WHEN 1 THEN 'NASA' ELSE 'Federal' END AS funding_source, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END AS award_amount, 'Dr. Unknown Investigator' AS pi_name FROM supplier""")
def map_spending_record(t: Tables) -> DataFrame:
    """Records of the spending register as awards; those without a description have no title."""
    k = F.col("s_suppkey")
    title = F.when(k % 7 == 0, "").when(k % 2 == 0, F.concat(F.lit('"'), "s_name", F.lit('"'))).otherwise(F.concat(F.lit("'"), "s_name", F.lit("'")))
    record = F.to_json(F.struct(F.concat(F.lit("A"), k.cast("string")).alias("Award ID"), F.lit(" SMITH-JONES A/b-c ").alias("Recipient Name"), title.alias("Description"), F.when(k % 3 == 0, "SUB AGENCY").otherwise(" ").alias("Awarding Sub Agency"), F.when(k % 4 != 0, F.col("s_acctbal")).alias("Award Amount")))
    agency = F.when(k % 3 == 0, "Department of Defense").when(k % 3 == 1, "National Aeronautics and Space Administration").otherwise("Library of Congress")
    mapped = awards.spending_records(t.supplier.select("s_suppkey", record.alias("r"), agency.alias("agency")), "r", "agency")
    return mapped.select("s_suppkey", "award_id", "grant_title", "university", "department", "funding_source", "award_amount", "pi_name")


@query("""SELECT s_suppkey, s_name AS org_name_published, CASE WHEN s_suppkey % 3 <> 0 THEN 'nsf:' || s_suppkey END AS pi_source_id, CASE s_suppkey % 4 WHEN 0 THEN -1 WHEN 1 THEN 0 ELSE 2 END AS others,
'Dir, Div' AS funder_name, CASE s_suppkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS active FROM supplier""")
def map_foundation_record(t: Tables) -> DataFrame:
    """Records of the science foundation; a missing list of co-investigators is none, a missing record is not."""
    k = F.col("s_suppkey")
    names = F.when(k % 4 >= 2, F.array(F.lit("Ann Lee a@b.edu"), F.lit("Bo Li"), F.lit(" ")))
    key = F.when(k % 4 != 0, F.to_json(F.struct(k.cast("string").alias("id"), "s_name")))
    body = F.struct(F.when(key.isNotNull(), k.cast("string")).alias("id"), F.col("s_name").alias("awardeeName"), F.when(k % 3 != 0, k.cast("string")).otherwise("").alias("piId"), names.alias("coPDPI"), F.lit("Dir").alias("orgLongName"), F.lit(" Div ").alias("orgLongName2"), F.when(k % 5 == 0, "TRUE").when(k % 5 == 1, "false").otherwise("?").alias("activeAwd"))
    mapped = t.supplier.select("s_suppkey", F.to_json(body).alias("r")).select("s_suppkey", *records.nsf_columns(F.col("r"), F.lit("2026-01-01")))
    return mapped.select("s_suppkey", "org_name_published", "pi_source_id", F.coalesce(F.size("co_pis"), F.lit(-1)).alias("others"), "funder_name", F.col("source_is_active").alias("active"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'ai_identified' WHEN 1 THEN 'published' WHEN 2 THEN 'stored' ELSE 'none' END AS basis,
CASE c_custkey % 4 WHEN 1 THEN 'Ann Lewis' WHEN 3 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 4 IN (1, 3) THEN 1 ELSE -1 END AS others, CASE WHEN c_custkey % 4 = 1 THEN 'Associate professor' END AS title FROM customer""")
def published_researcher(t: Tables) -> DataFrame:
    """Whose name a card shows and why."""
    k = F.col("c_custkey") % 4
    name = F.when(k == 3, text.UNRESOLVED_PI).otherwise(F.concat(F.lit("Dr. "), "c_name"))
    others = F.lit('[{"name":"LI, BO","title":null},{"name":" "}]')
    who = people.published_person(name, k == 0, F.when(k % 2 == 1, "2026-01-01"), F.when(k == 1, "Ann LEWIS"), F.when(k == 1, "Associate  Professor"), F.lit("nih:1"), others)
    return t.customer.select("c_custkey", who.alias("p")).select("c_custkey", F.col("p.name_basis").alias("basis"), F.col("p.name").alias("name"), F.coalesce(F.size("p.other_investigators"), F.lit(-1)).alias("others"), F.col("p.title").alias("title"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'University of ' || n_name WHEN s_suppkey % 3 = 1 THEN s_name ELSE 'N/A' END AS institution, n_name AS city FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def published_place(t: Tables) -> DataFrame:
    k = F.col("s_suppkey") % 3
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    where = people.place(F.when(k == 1, F.col("s_name")), F.when(k == 0, F.concat(F.lit("UNIVERSITY OF "), F.upper("n_name"))), F.col("n_name"), F.lit("TX"))
    return rows.select("s_suppkey", where["institution"].alias("institution"), where["city"].alias("city"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS generated FROM customer")
def name_provenance(t: Tables) -> DataFrame:
    """Whether a shown name was found by a model; without a flag the source decides."""
    k = F.col("c_custkey") % 4
    flag = F.when(k == 1, F.lit(True)).when(k == 3, F.lit(False))
    return t.customer.select("c_custkey", people.name_is_generated(F.when(k == 0, text.UNRESOLVED_PI).otherwise(F.col("c_name")), flag, F.when(k == 1, "NIH").otherwise("DOE")).alias("generated"))


@query(f"WITH {SWIPES_SQL} SELECT grant_id, status, grant_id % 3 = 0 AND status = 'emailed' AS refused FROM swipes WHERE grant_id % 3 <> 0 OR status = 'emailed'")
def undo_swipes(t: Tables) -> DataFrame:
    """Swipes taken back; who was written to stays and is told so."""
    left, refused = O.undo(t.swipes(), t.swipes().where("grant_id % 3 = 0").select("grant_id"), ["grant_id"])
    marks = refused.select("grant_id", F.lit(True).alias("refused"))
    return left.join(marks, "grant_id", "left").select("grant_id", "status", F.coalesce("refused", F.lit(False)).alias("refused"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 4 <> 0 THEN o_custkey END AS o_custkey FROM orders")
def orphans_set_null(t: Tables) -> DataFrame:
    """Children of deleted parents keep their row without the reference."""
    return O.set_null(t.orders.select("o_orderkey", "o_custkey"), t.customer.where("c_custkey % 4 <> 0"), "o_custkey", "c_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'x' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 6 = 0 OR c_custkey % 5 = 0 THEN 'now' ELSE 'before' END AS updated_at FROM customer")
def touch_updated(t: Tables) -> DataFrame:
    """The time of the last change moves only with a change; new rows have one too."""
    k = F.col("c_custkey")
    old = t.customer.where(k % 5 != 0).select("c_custkey", F.col("c_mktsegment").alias("segment"), F.lit("before").alias("updated_at"))
    new = t.customer.select("c_custkey", F.when(k % 6 == 0, "x").otherwise(F.col("c_mktsegment")).alias("segment"), F.lit(None).cast("string").alias("updated_at"))
    return O.touched(old, new, "c_custkey", ["segment"], "updated_at", F.lit("now"))


@query(f"WITH {SWIPES_SQL} SELECT grant_id, CASE WHEN grant_id % 2 = 0 THEN 'shown' ELSE 'page' END AS came FROM swipes WHERE grant_id % 2 = 0 OR grant_id % 3 = 0")
def append_page(t: Tables) -> DataFrame:
    """A page of hits added to what is shown already."""
    shown = t.swipes().where("grant_id % 2 = 0").select("grant_id", F.lit("shown").alias("came"))
    return O.next_page(shown, t.swipes().where("grant_id % 3 = 0").select("grant_id", F.lit("page").alias("came")), "grant_id")


@query("SELECT p_partkey, upper(p_brand) || p_partkey AS term, 1 AS search FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, ' ' || p_brand || p_partkey, 2 FROM part WHERE p_partkey % 2 <> 0 AND p_partkey % 3 = 0")
def merge_hit_lists(t: Tables) -> DataFrame:
    """Hits of a second search only for terms that the first lacks."""
    k = F.col("p_partkey")
    first = t.part.where(k % 2 == 0).select("p_partkey", F.concat(F.upper("p_brand"), k.cast("string")).alias("term"), F.lit(1).alias("search"))
    second = t.part.where(k % 3 == 0).select("p_partkey", F.concat(F.lit(" "), "p_brand", k.cast("string")).alias("term"), F.lit(2).alias("search"))
    return O.merged_hits(first, second, "term")


@query("SELECT p_partkey, p_partkey % 7 = 0 AS gone FROM part WHERE p_partkey % 2 = 0")
def answers_gone(t: Tables) -> DataFrame:
    """Answers to a batch of rows, and which of these rows are gone by now."""
    rows = t.part.select("p_partkey")
    return O.answers_to_batch(rows, rows.where("p_partkey % 2 = 0"), rows.where("p_partkey % 7 <> 0"), "p_partkey")


@query("SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders WHERE o_custkey % 9 <> 0 GROUP BY 1 UNION ALL SELECT NULL, o_orderkey FROM orders WHERE o_custkey % 9 = 0")
def batch_last_wins(t: Tables) -> DataFrame:
    """The last row of each key; rows without a key all stay."""
    rows = t.orders.select(F.when(F.col("o_custkey") % 9 != 0, F.col("o_custkey")).alias("o_custkey"), "o_orderdate", "o_orderkey")
    return O.last_of_batch(rows, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query(f"""WITH {AWARDS_SQL}, b AS (SELECT *, award % 3 <> 2 AS federal FROM awards WHERE "end" IS NOT NULL), o AS (SELECT a.award, b.award AS other, row_number() OVER (PARTITION BY a.award ORDER BY b."end" DESC, b.award) AS n FROM awards a JOIN b ON a.person = b.person AND a.award <> b.award AND b.federal)
SELECT award, other, CAST(n AS INTEGER) AS n FROM o WHERE n <= 5 ORDER BY award, n LIMIT 500""")
def other_awards_capped(t: Tables) -> DataFrame:
    """Other awards of a person from two agencies, five a card and 500 in all."""
    rows = t.awards()
    other = rows.where(F.col("end").isNotNull() & (F.col("award") % 3 != 2)).select("person", F.struct((-F.datediff("end", F.lit("1970-01-01").cast("date"))).alias("late"), F.col("award").alias("award")).alias("o"))
    # a person's six first are enough for five others of each card
    place = F.row_number().over(Window.partitionBy("person").orderBy("o"))
    listed = other.withColumn("place", place).where("place <= 6").groupBy("person").agg(F.array_sort(F.collect_list("o")).alias("others"))
    each = rows.select("award", "person").join(listed, "person").select("award", F.posexplode(F.slice(F.filter("others", lambda o: o["award"] != F.col("award")), 1, 5)))
    return each.select("award", F.col("col.award").alias("other"), (F.col("pos") + 1).alias("n")).orderBy("award", "n").limit(500)


@query("SELECT vec_id, vec_id % 10 <> 0 AND list_max([abs(x) FOR x IN embedding]) > 0 AS usable FROM embeddings")
def usable_vectors(t: Tables) -> DataFrame:
    """Vectors that are neither empty nor all zero."""
    value = F.when(F.col("vec_id") % 20 == 0, F.array().cast("array<float>")).when(F.col("vec_id") % 10 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    return t.embeddings.select("vec_id", scores.is_usable(value).alias("usable"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 10 = 0 ELSE o_orderkey % 3 = 0 END AS same FROM orders")
def same_amounts(t: Tables) -> DataFrame:
    """Amounts that are equal up to half a cent; two missing ones are."""
    k, a = F.col("o_orderkey"), F.col("o_totalprice")
    other = F.when(k % 10 == 0, F.lit(None).cast("double")).when(k % 3 == 0, a + 0.004).otherwise(a + 0.02)
    return t.orders.select("o_orderkey", scores.same_amount(F.when(k % 5 != 0, a), other).alias("same"))


@query(r"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 17 WHEN 1 THEN 9 ELSE 0 END AS prose_at FROM part")
def label_offset(t: Tables) -> DataFrame:
    """Where prose begins behind a heading; other words in front of a colon are part of the text."""
    label = _spelt("p_partkey", ["PROJECT SUMMARY: ", "Summary: ", ""], "DESCRIPTION: ")
    return t.part.select("p_partkey", evidence.prose_begin(F.concat(label, F.lit("the "), "p_name")).alias("prose_at"))


@query("""SELECT p_partkey, p_brand || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '|' || p_type END AS terms FROM part""")
def terms_with_skips(t: Tables) -> DataFrame:
    """A list without repeats and without what a student skips."""
    skip = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lower("p_type")))
    listed = lists.distinct_ignoring_case(F.array(F.col("p_brand"), F.lower("p_brand"), F.col("p_type"), F.lit(" ")), skip)
    return t.part.select("p_partkey", F.array_join(listed, "|").alias("terms"))


_SENTENCE = "This project will measure how cells repair damaged membranes after injury."


@query(f"""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'nih_phr' WHEN 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 'nsf_abstract' ELSE 'nsf_abstract' END WHEN 2 THEN 'nih_abstract' END AS source,
CASE p_partkey % 6 WHEN 0 THEN 'NIH summary' WHEN 1 THEN 'Abstract on file' WHEN 2 THEN 'NIH abstract' END AS tag, CASE p_partkey % 6 WHEN 3 THEN 'no_agency_text' WHEN 4 THEN 'no_agency_text' WHEN 5 THEN 'none_qualifies' END AS absent,
CASE WHEN p_partkey % 6 < 3 THEN '{_SENTENCE}' END AS text FROM part""")
def front_sentence(t: Tables) -> DataFrame:
    """The sentence on a card's front, where it is from, or why there is none."""
    k = F.col("p_partkey") % 6
    source = F.when(k.isin(0, 2, 3), "NIH").when(k.isin(1, 5), "NSF").otherwise("DOE")
    statement = F.when(k == 0, _SENTENCE)
    abstract = F.when(k == 5, F.lit("Too short. See below.")).otherwise(F.concat(F.lit("A title only. "), F.lit(_SENTENCE)))
    front = C.front_sentence(source, F.col("p_name"), statement, abstract, k == 3, F.when(k == 2, F.lit("2026-01-01")), F.lit(None).cast("string"))
    return t.part.select("p_partkey", front.alias("f")).select("p_partkey", "f.source", "f.tag", "f.absent", "f.text")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'nih_index_terms' WHEN 1 THEN 'ai_picked' END AS source, CASE p_partkey % 3 WHEN 0 THEN 'Cell Biology|Membranes' WHEN 1 THEN 'Rivers|old banks' END AS terms FROM part""")
def card_topics(t: Tables) -> DataFrame:
    """Topics of a card: index terms if there are two, else picked ones that still stand in its text."""
    k = F.col("p_partkey") % 3
    index = F.when(k == 0, F.array(F.lit("Cell Biology"), F.lit("yeast two-hybrid"), F.lit("Cell"), F.lit("Membranes"))).when(k == 1, F.array(F.lit("Yeast"), F.lit("Rivers")))
    picked = F.array(F.lit("rivers"), F.lit("absent thing"), F.lit("old banks"), F.lit("postdoc positions"))
    topics = C.card_topics(index, F.when(k == 1, picked), F.array(F.lit("YEAST")), [F.lit("Rivers and their old  banks").cast("string"), F.lit("the old banks of rivers")])
    return t.part.select("p_partkey", topics.alias("c")).select("p_partkey", "c.source", F.array_join("c.terms", "|").alias("terms"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'nih_fiscal_year' WHEN 1 THEN 'nsf_obligated' WHEN 2 THEN 'usaspending_obligation' END AS basis FROM supplier")
def amount_bases(t: Tables) -> DataFrame:
    """What a stored amount measures, which differs by agency."""
    k = F.col("s_suppkey") % 4
    return t.supplier.select("s_suppkey", awards.amount_basis(F.when(k == 0, "NIH").when(k == 1, "NSF").when(k == 2, "EPA").otherwise("Federal")).alias("basis"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'undecided' WHEN 1 THEN 'generated' WHEN 2 THEN 'verbatim' ELSE 'generated' END AS verdict FROM part")
def fetch_verdict(t: Tables) -> DataFrame:
    """What a fetch says about a stored text: nothing if the award was not found, generated if the agency has none."""
    k = F.col("p_partkey") % 4
    outcome = F.when(k == 0, "NOT_FOUND").when(k == 1, "FOUND_EMPTY").otherwise("FOUND_WITH_TEXT")
    federal = F.when(k == 2, F.concat(F.lit("  "), F.upper("p_name"))).otherwise("entirely other words than these")
    return t.part.select("p_partkey", C.fetch_verdict(outcome, F.col("p_name"), federal).alias("verdict"))


@query(f"""WITH {AWARDS_SQL}, d AS (SELECT a.*, award % 7 = 0 AS unknown, award % 3 = 0 AS ai, award % 11 = 0 AS bare, award % 17 = 0 AS keyless, CASE WHEN award % 5 <> 0 THEN "end" - INTERVAL 400 DAY END AS start FROM awards a)
SELECT count(*) AS total, count(*) FILTER (WHERE "end" < DATE '{TODAY}') AS ended, count(*) FILTER (WHERE "end" IS NULL OR "end" >= DATE '{TODAY}') AS active_or_undated, count(*) FILTER (WHERE "end" IS NULL) AS null_end_date,
count(*) FILTER (WHERE start IS NULL) AS null_start_date, count(*) FILTER (WHERE start > DATE '{TODAY}') AS future_start, count(*) FILTER (WHERE unknown) AS unknown_pi, count(*) FILTER (WHERE ai) AS ai_abstract, count(*) FILTER (WHERE bare) AS no_embedding, count(*) FILTER (WHERE keyless) AS no_award_id FROM d""")
def corpus_measures(t: Tables) -> DataFrame:
    """The ten counts that describe a corpus, in one pass."""
    k, end, today = F.col("award"), F.col("end"), F.lit(TODAY).cast("date")
    start = F.when(k % 5 != 0, F.date_sub("end", 400))
    return Q.snapshot(t.awards(), {
        "total": F.lit(True), "ended": end < today, "active_or_undated": end.isNull() | (end >= today), "null_end_date": end.isNull(), "null_start_date": start.isNull(),
        "future_start": start > today, "unknown_pi": k % 7 == 0, "ai_abstract": k % 3 == 0, "no_embedding": k % 11 == 0, "no_award_id": k % 17 == 0,
    })


@query(r"""WITH w AS (SELECT doc_id, unnest(list_distinct([w FOR w IN regexp_split_to_array(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), ' ') IF w <> ''])) AS term FROM documents)
SELECT term, count(*) AS awards FROM w GROUP BY 1 HAVING count(*) >= 3 ORDER BY awards DESC, term LIMIT 10""")
def commonest_terms(t: Tables) -> DataFrame:
    """The ten terms on most awards."""
    found = terms.document_frequency(t.documents.select(text.words(F.lower("text")).alias("terms")))
    return found.orderBy(F.desc("awards"), "term").limit(10)


@query("""WITH r AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'https://Campus.example/feed' WHEN 'click' THEN 'https://other.example/' || user_id % 3 END AS referrer, event_type = 'purchase' AND user_id % 2 = 0 AS tagged FROM events)
SELECT CASE WHEN NOT hit THEN referrer END AS referrer, count(*) AS events, count(DISTINCT user_id) AS sessions FROM (SELECT *, coalesce(contains(lower(referrer), 'campus'), false) OR tagged AS hit FROM r) WHERE hit OR coalesce(referrer, '') <> '' GROUP BY 1""")
def referrers_other(t: Tables) -> DataFrame:
    """Visits that one site sent, by referrer, any word of the metadata or agent, and who sent the others."""
    kind, user = F.col("event_type"), F.col("user_id")
    rows = t.events.select(
        user.alias("session_id"), F.when(kind == "view", "https://Campus.example/feed").when(kind == "click", F.concat(F.lit("https://other.example/"), (user % 3).cast("string"))).alias("referrer"),
        F.when((kind == "purchase") & (user % 2 == 0), '{"utm":"from CAMPUS","n":1}').otherwise('{"utm":"x"}').alias("metadata"), F.lit("agent").alias("user_agent"),
    )
    return M.referrals(rows, "campus")


@query("SELECT * EXCLUDE (embedding) FROM embeddings")
def scan_without_vectors(t: Tables) -> DataFrame:
    """All awards without their vectors, which the scan then does not read."""
    return t.embeddings.drop("embedding")


@query("SELECT r_regionkey, r_name, NULL::INTEGER AS year, NULL::VARCHAR AS funder FROM region")
def missing_columns_filled(t: Tables) -> DataFrame:
    """A table that lacks some wanted columns still; they are null."""
    return tables.with_columns(t.region.select("r_regionkey", "r_name"), {"r_name": "string", "year": "int", "funder": "string"})


@query("SELECT s_suppkey, s_name AS sentence FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0")
def answers_of_batch(t: Tables) -> DataFrame:
    """Answers, one JSON object a line, of the rows that were asked for; unreadable ones are left out."""
    k = F.col("s_suppkey")
    line = F.when(k % 3 == 0, "no json").otherwise(F.to_json(F.struct(k.cast("string").alias("id"), F.col("s_name").alias("sentence"))))
    asked = t.supplier.where(k % 2 == 0).select(k.cast("string").alias("id"))
    read = tables.readable_answers(t.supplier.select(line.alias("value")))
    return read.join(asked, "id", "left_semi").select(F.col("id").cast("long").alias("s_suppkey"), "sentence")


def _profile_events(t: Tables) -> DataFrame:
    """Conversations as histories of profiles: a student's turns are read or scanned, the answers are edits."""
    words, own = text.words(F.col("text")), F.col("role") == "user"
    kind = F.when(own, F.when(F.col("turn") % 4 == 0, profiles.EXTRACTION).otherwise(profiles.SCAN)).otherwise(profiles.EDIT)
    none = F.lit(None).cast("string")
    part = lambda when, first, n: F.when(when, F.slice(words, first, n))
    return t.conversations.select(
        F.col("conv_id").alias("student"), F.lpad(F.col("turn").cast("string"), 6, "0").alias("at"), kind.alias("kind"), part(own, 1, 6).alias("skills"), part(own, 7, 3).alias("domains"),
        part(~own, 1, 2).alias("add"), part(~own, 3, 2).alias("remove"), F.when(own & (F.col("turn") % 8 == 0), "BSc Biology").alias("education"), F.when(~own, F.lit(True)).alias("confirmed"), F.when(own, F.col("text")).alias("narrative"), none.alias("cv"),
    )


@query()
def profile_history(t: Tables) -> DataFrame:
    """The terms of students after all extractions and edits, with what their own text says about each."""
    views = profiles.profile_views(_profile_events(t))
    return views.withColumn("removed", F.array_join("removed", "|"))


@query()
def letter_terms(t: Tables) -> DataFrame:
    """The terms that a letter may name."""
    return profiles.letter_terms(profiles.profile_views(_profile_events(t))).select("student", "position", "term", "origin")
