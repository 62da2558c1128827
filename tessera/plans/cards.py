"""Sentences, evidence, checks of written text, agency records and whole cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import awards as A
from tessera.functions import records, sentences, text
from tessera.operators import cards as C
from tessera.operators import evidence as E
from tessera.plans.base import TODAY, Tables, query


@query()
def sentence_split(t: Tables) -> DataFrame:
    """Every sentence of every text, with its place."""
    return t.documents.select("doc_id", F.posexplode(E.sentences(F.col("text"))).alias("place", "sentence"))


@query()
def sentence_places(t: Tables) -> DataFrame:
    """Where the sentences of every text begin and end."""
    return t.documents.select("doc_id", F.posexplode(E.sentence_spans("text")).alias("place", "s")).select("doc_id", "place", "s.begin", "s.end")


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_matches(s, '\S'))) > 0 AS any_sentence FROM documents")
def has_sentence(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", (F.size(sentences.split_sentences(F.regexp_replace("text", r"^[.!?\s]+$", ""))) > 0).alias("any_sentence"))


@query()
def first_qualifying_sentence(t: Tables) -> DataFrame:
    """The sentence that a card would show."""
    return t.documents.select("doc_id", sentences.select_sentence(F.col("text"), F.substring("text", 1, 40)).alias("sentence"))


@query()
def rejection_histogram(t: Tables) -> DataFrame:
    """Why sentences cannot be shown."""
    each = t.documents.select(F.explode(sentences.split_sentences(F.col("text"))).alias("s"))
    return each.groupBy(F.coalesce(sentences.rejection(F.col("s")), F.lit("qualifies")).alias("reason")).agg(F.count("*").alias("sentences"))


def _looked_up(t: Tables) -> DataFrame:
    """Texts as awards of which some are written by a model or say their title again; terms are words of the text and others."""
    k, words = F.col("doc_id") % 11, F.slice(text.words(F.substring("text", 200, 120)), 2, 4)
    terms = F.concat(F.array(F.lit("the"), F.lit("nicht"), F.lit("de la"), F.lit("The  ")), words)
    origin = lambda w, i: F.struct(w.alias("term"), F.when(i < 4, "narrative").otherwise("cv").alias("origin"))
    title = F.when(k == 4, F.col("text")).otherwise(F.substring("text", 1, 60))
    return t.documents.select(F.col("doc_id").alias("award"), F.when(k != 6, F.transform(terms, origin)).alias("terms"), title.alias("title"), F.col("text").alias("abstract"), F.when(k != 5, k.isin(3, 4)).alias("generated"))


@query()
def evidence_rows(t: Tables) -> DataFrame:
    """The quotations of each award for a student's terms, with all places in UTF-16 units."""
    rows = E.fit_evidence(_looked_up(t)).select("award", F.explode("rows").alias("e")).select("award", "e.*")
    return rows.withColumn("offsets", F.array_join(F.transform("offsets", lambda o: F.concat_ws("-", o["begin"], o["end"])), ","))


@query(r"""WITH k AS (SELECT doc_id AS award, CAST(doc_id % 11 AS INTEGER) AS k, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS x, lower(trim(regexp_replace(CASE WHEN doc_id % 11 = 4 THEN text ELSE substr(text, 1, 60) END, '\s+', ' ', 'g'))) AS y FROM documents),
b AS (SELECT award, k, CASE WHEN k = 5 THEN NULL WHEN k NOT IN (3, 4) THEN 'held_as_published' WHEN x <> '' AND x = y THEN 'federal_description_only' ELSE 'llm_generated' END AS basis FROM k)
SELECT award, basis, coalesce(basis <> 'llm_generated', false) AND k <> 6 AS counted FROM b""")
def evidence_basis(t: Tables) -> DataFrame:
    """What the quotations of an award rest on, and whether any were counted: a model's text is not searched."""
    return E.fit_evidence(_looked_up(t)).select("award", "basis", F.col("matched").isNotNull().alias("counted"))


@query()
def validate_sentence(t: Tables) -> DataFrame:
    """What speaks against each sentence of a text as its summary."""
    rows = t.documents.select("doc_id", "text", F.substring("text", 1, 40).alias("title")).withColumn("summaries", E.sentences(F.col("text")))
    found = E.summary_faults(rows, "doc_id", "summaries", "title", "text")
    return found.select("doc_id", F.posexplode("faults").alias("at", "f")).select("doc_id", "at", F.array_join("f", "|").alias("faults"))


@query()
def draft_violations(t: Tables) -> DataFrame:
    """What speaks against an assistant's turn as a letter."""
    faults = sentences.draft_faults(F.lit("Hello"), F.col("text"), F.lit("A study of rivers and banks"), F.lit("Dr. Ann Grant"), F.lit("Rice University"), F.col("turn") % 4 == 1)
    rows = t.conversations.where("role = 'assistant'").select("conv_id", "turn", faults.alias("f"))
    return rows.select("conv_id", "turn", F.array_join("f.hard", "|").alias("hard"), F.array_join("f.soft", "|").alias("soft"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'nih:' || c_custkey WHEN c_custkey % 3 = 1 THEN 'nih:' || (c_custkey + 1) END AS pi_source_id, CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE -1 END AS others,
c_mktsegment || '|x' AS terms, 1990 + c_nationkey AS fiscal_year FROM customer""")
def map_agency_record(t: Tables) -> DataFrame:
    """Records as an agency sends them, read into the shared columns; a missing list is not an empty one."""
    k = F.col("c_custkey")
    person = lambda i, contact: F.struct(F.lit(contact).alias("is_contact_pi"), F.concat(F.lit("P "), i.cast("string")).alias("full_name"), i.cast("string").alias("profile_id"))
    people = F.when(k % 3 == 0, F.array(person(k + 1, False), person(k, True))).when(k % 3 == 1, F.array(person(k + 1, False)))
    record = F.to_json(F.struct((F.lit(1990) + F.col("c_nationkey")).cast("string").alias("fiscal_year"), F.concat(F.col("c_mktsegment"), F.lit(" ;; x;")).alias("pref_terms"), people.alias("principal_investigators")))
    mapped = t.customer.select("c_custkey", record.alias("r")).select("c_custkey", *records.nih_columns(F.col("r"), F.lit("2026-01-01")))
    return mapped.select("c_custkey", "pi_source_id", F.coalesce(F.size("co_pis"), F.lit(-1)).alias("others"), F.array_join("agency_terms", "|").alias("terms"), "fiscal_year")


_PREFIXED = {
    "Workshop: ": None, "REU Site: Collaborative Research: ": "undergraduate_site", "Collaborative Research: CAREER: ": "early_career_faculty", "SBIR Phase I: ": "small_business",
    "RUI: Collaborative Research: ": None, "eager:": "research_project", " Collaborative  Research : MRI: ": "equipment", "": None, "CRII: RAPID: STTR: ": "small_business",
}
_CODED = sorted((c, kind) for kind, codes in A.CODES.items() for c in codes.split())
_PREFIX_SQL = " ".join(f"WHEN {i} THEN {f"'{kind}'" if kind else 'NULL'}" for i, kind in enumerate(_PREFIXED.values()))
_CODE_SQL = " ".join(f"WHEN {i} THEN '{kind}'" for i, (_, kind) in enumerate(_CODED))


@query(f"""WITH p AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 3 = 0 THEN CASE p_size % {len(_PREFIXED)} {_PREFIX_SQL} END
  WHEN p_partkey % 3 = 1 AND p_size % 5 <> 0 AND p_partkey % {len(_CODED)} <> 7 THEN CASE WHEN p_size % 5 = 1 THEN 'subproject' ELSE CASE p_partkey % {len(_CODED)} {_CODE_SQL} END END END AS kind FROM part)
SELECT p_partkey, kind, CASE WHEN p_partkey % 3 = 1 AND p_size % 5 = 0 THEN 'not_loaded' WHEN kind IS NULL THEN 'unknown' ELSE 'value' END AS state,
  coalesce(kind = 'named_by_agency', false) AS official FROM p""")
def award_kinds(t: Tables) -> DataFrame:
    """What awards are: by prefixes of titles, by activity codes with the agency's own names for them, or not known."""
    k, n = F.col("p_partkey"), F.col("p_size")
    source = F.when(k % 3 == 0, "NSF").when(k % 3 == 1, "NIH").otherwise("DOE")
    title = F.concat(F.get(F.array(*[F.lit(p) for p in _PREFIXED]), n % len(_PREFIXED)), F.lit("A study: "), "p_name")
    code = F.lower(F.get(F.array(*[F.lit(c) for c, _ in _CODED]), (k % len(_CODED)).cast("int")))
    rows = t.part.select("p_partkey", source.alias("source"), title.alias("title"), code.alias("code"), F.when(n % 5 == 1, "12").otherwise(" ").alias("sub"), (n % 5 != 0).alias("fetched"))
    names = t.part.select(F.upper(F.get(F.array(*[F.lit(c) for c, _ in _CODED]), (k % len(_CODED)).cast("int"))).alias("code"), F.lit("Name of the code").alias("name")).where(k % len(_CODED) != 7)
    named = A.with_official_names(rows, names)
    kind = A.award_kind(F.col("source"), F.col("title"), F.col("code"), F.col("sub"), F.col("fetched"), F.col("official_name"))
    return named.select("p_partkey", kind.alias("k")).select("p_partkey", "k.kind", "k.state", F.col("k.tag_is_official").alias("official"))


@query()
def card_struct(t: Tables) -> DataFrame:
    """Cards of awards, one nested row each."""
    d = F.col("doc_id")
    dated = t.awards().select(F.col("award").alias("doc_id"), "end", "amount")
    rows = t.documents.join(dated, "doc_id").select(
        d.alias("award"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("abstract"), F.when(d % 4 == 0, F.col("text")).alias("statement"), (d % 3 == 0).alias("generated"),
        F.lit("Dr. Ann Lee").alias("person"), F.lit("LEE, ANN").alias("published"), F.when(d % 2 == 0, "NIH").otherwise("NSF").alias("source"), "amount", F.add_months("end", -24).alias("start"), "end", F.when(d % 2 == 0, F.date_add("end", 3)).alias("checked"),
        F.when(d % 6 == 0, "T32").when(d % 6 == 2, "R13").otherwise("R01").alias("code"), F.lit(None).cast("string").alias("subproject"), F.lit("Name of the code").alias("official_name"),
        (d % 101).cast("int").alias("semantic"), F.when(d % 5 != 0, (d % 97).cast("int")).alias("keyword"),
    )
    return C.cards(rows, ["the", "de la"], F.lit(TODAY).cast("date"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'student_added' WHEN c_custkey % 5 = 1 THEN 'keyword_scan' WHEN c_custkey % 5 = 2 THEN 'narrative' WHEN c_custkey % 5 = 3 THEN 'cv' ELSE 'ai_suggested' END AS origin FROM customer""")
def term_origin(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 5
    origin = C.term_origin(F.lit("cell culture"), F.when(k == 2, "I did Cell  Culture work."), F.when(k == 3, "cell\nculture, 2020"), F.when(k == 0, "student_added"), k == 1)
    return t.customer.select("c_custkey", origin.alias("origin"))


@query("""SELECT c_custkey, 'Alpha|' || CASE WHEN c_custkey % 2 = 0 THEN 'beta gamma' ELSE 'beta gamma|Delta' END AS terms FROM customer""")
def merge_profile_terms(t: Tables) -> DataFrame:
    """Stored and newly found terms of a student without those taken out."""
    removed = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("DELTA")))
    merged = C.merge_terms(F.array(F.lit("Alpha"), F.lit("beta  gamma")), F.array(F.lit("ALPHA"), F.lit("Delta"), F.lit(" ")), removed)
    return t.customer.select("c_custkey", F.array_join(merged, "|").alias("terms"))


@query("SELECT s_suppkey, s_suppkey % 2 = 0 AS conflict FROM supplier")
def name_conflict(t: Tables) -> DataFrame:
    other = F.when(F.col("s_suppkey") % 2 == 0, "ZHANG, WEI").otherwise("LEE, ANN B")
    return t.supplier.select("s_suppkey", C.names_conflict(F.lit("Dr. Ann Lee"), other).alias("conflict"))


@query("SELECT s_suppkey, 'Name: ' || s_name || chr(10) || 'Skills: a, b' AS profile FROM supplier")
def profile_text(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", C.profile_text(F.col("s_name"), F.lit(""), F.array(F.lit("a"), F.lit("b")), F.array().cast("array<string>")).alias("profile"))


@query(r"SELECT doc_id, trim(substr(trim(regexp_replace(regexp_replace(text, '[^\pL\pN_\s-]', ' ', 'g'), '\s+', ' ', 'g')), 1, 60)) AS q FROM documents")
def query_title(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.query_title(F.col("text")).alias("q"))
