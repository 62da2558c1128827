"""The card of an award as one nested row, and a student's terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import awards as A
from tessera.functions import dates, lists, scores, sentences, text

#: Kinds of awards without a lab to write to, and when writing makes no sense (fixed values).
NO_OUTREACH_KINDS = ("conference", "equipment", "small_business")


def provenance(generated: Column, source_described: Column) -> Column:
    """Where a text comes from; a missing flag warns rather than vouches."""
    return F.when(F.coalesce(generated, F.lit(True)), "llm_generated").when(source_described, "federal_description_only").otherwise("held_as_published")


def readable_text(statement: Column, abstract: Column, generated: Column) -> Column:
    """struct(field, text): the agency's statement, else its abstract if it is known not to be generated."""
    own = F.when(text.or_none(statement).isNotNull(), F.struct(F.lit("public_statement").alias("field"), statement.alias("text")))
    return own.when((generated == F.lit(False)) & text.or_none(abstract).isNotNull(), F.struct(F.lit("abstract").alias("field"), abstract.alias("text")))


def names_conflict(a: Column, b: Column) -> Column:
    """Two names that share fewer of their longer words than two, or than the shorter one has."""
    parts = lambda n: F.filter(F.split(F.lower(F.regexp_replace(n, r"[^\p{L} ]", " ")), " +"), lambda w: (F.length(w) > 1) & (w != "dr"))
    shared = F.size(F.array_intersect(parts(a), parts(b)))
    return F.coalesce(shared < F.least(F.lit(2), F.size(parts(a)), F.size(parts(b))), F.lit(False))


def cards(awards: DataFrame, terms: list[str], today: Column) -> DataFrame:
    """One nested row an award.

    awards: award, title, abstract, statement, generated, person, published, source,
    amount, start, end, checked, semantic, keyword, code, subproject, official_name.
    """
    c = F.col
    kind = A.award_kind(c("source"), c("title"), c("code"), c("subproject"), c("checked").isNotNull(), c("official_name"))
    state = dates.funding_state(c("start"), c("end"), c("checked"), today)
    shown = readable_text(c("statement"), c("abstract"), c("generated"))
    rows = awards.withColumn("state", state).withColumn("shown", shown).withColumn("kind", kind)
    months = dates.whole_months(today, c("end"))
    hits = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.regexp_like(F.concat_ws("\n", c("title"), c("shown.text")), text.whole_word(t)))
    funding = F.struct(c("state"), dates.funding_label(c("start"), c("end"), c("state")).alias("label"), F.when(c("checked").isNotNull() & c("state").isin("funded", "starts_later"), dates.time_left(months)).alias("time_left"))
    reachable = text.is_resolved(c("person")) & ~F.coalesce(c("kind.kind").isin(*NO_OUTREACH_KINDS), F.lit(False)) & ~c("state").isin("ended", "no_end_date") & ~names_conflict(c("person"), c("published"))
    return rows.select(
        "award",
        F.struct(text.display_title(c("title")).alias("title"), sentences.select_sentence(c("shown.text"), c("title")).alias("sentence"), c("shown.field").alias("sentence_source"), c("kind")).alias("front"),
        F.struct(scores.amount_state(c("amount")).alias("state"), F.when(scores.amount_or_none(c("amount")) > 0, scores.amount_or_none(c("amount"))).alias("value")).alias("amount"),
        funding.alias("funding"),
        F.struct(scores.blend(c("semantic"), c("keyword")).alias("score"), scores.components(c("semantic"), c("keyword")).alias("components")).alias("match"),
        F.struct(F.when(provenance(c("generated"), F.lit(False)) != "llm_generated", hits).alias("matched"), F.lit(len(terms)).alias("total"), provenance(c("generated"), F.lit(False)).alias("basis")).alias("evidence"),
        reachable.alias("outreach_ok"),
    )


#: Where a student's term can come from (fixed values).
ORIGINS = ("student_added", "keyword_scan", "narrative", "cv", "ai_suggested")


def term_origin(term: Column, narrative: Column, cv: Column, before: Column, scanned: Column) -> Column:
    """Who says that a student knows something: the student, a scan, their own text, their CV, or only the model."""
    says = lambda t: F.coalesce(F.regexp_like(t, text.whole_word(F.lower(term))), F.lit(False))
    own, in_cv = says(F.lower(narrative)), says(F.lower(cv))
    kept = F.coalesce((before == "cv") & (F.coalesce(cv, F.lit("")) == ""), F.lit(False))
    return (
        F.when(before == "student_added", "student_added").when(F.coalesce(scanned, F.lit(False)) | F.coalesce(before == "keyword_scan", F.lit(False)), "keyword_scan")
        .when(own, "narrative").when(in_cv | kept, "cv").otherwise("ai_suggested")
    )


def merge_terms(stored: Column, found: Column, removed: Column, limit: int = 40, longest: int = 80) -> Column:
    """Stored terms first, then newly found ones; none that the student took out, none twice, none too long."""
    gone = F.transform(F.coalesce(removed, F.array().cast("array<string>")), lambda r: text.normal_key(r))
    merged = lists.distinct_ignoring_case(F.concat(F.coalesce(stored, F.array().cast("array<string>")), F.coalesce(found, F.array().cast("array<string>"))))
    return F.slice(F.filter(merged, lambda t: ~F.array_contains(gone, text.normal_key(t)) & (F.length(t) <= longest)), 1, limit)


def profile_text(name: Column, interests: Column, skills: Column, tags: Column) -> Column:
    """The text that stands for a student when vectors are made."""
    line = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))
    return F.concat_ws("\n", line("Name", name), line("Interests", interests), line("Skills", F.array_join(skills, ", ")), line("Fields", F.array_join(tags, ", ")))


#: Tags under a front sentence by where it comes from, and what the label of a written one explains (fixed values).
SENTENCE_TAGS = {"nih_phr": "NIH summary", "nih_abstract": "NIH abstract", "nsf_abstract": "NSF abstract"}
TAG_ON_FILE, TAG_WRITTEN = "Abstract on file", "AI summary"
WRITTEN_INFO = ("Written by an AI model from the text ", " published for this award. It may be wrong. The agency's own text is in Details.")
TOPICS_MIN, TOPICS_SHOWN = 2, 5


def agency_text(source: Column, statement: Column, abstract: Column, generated: Column) -> Column:
    """struct(text, source): the one text a front sentence may come from; null where none is known to be the agency's."""
    asked = source.isin("NIH", "NSF")
    own = F.struct(statement.alias("text"), F.lit("nih_phr").alias("source"))
    published = F.struct(abstract.alias("text"), F.when(source == "NIH", "nih_abstract").otherwise("nsf_abstract").alias("source"))
    return F.when(asked & text.or_none(statement).isNotNull(), own).when(asked & (generated == F.lit(False)) & text.or_none(abstract).isNotNull(), published)


def front_sentence(source: Column, title: Column, statement: Column, abstract: Column, generated: Column, checked: Column, written: Column) -> Column:
    """struct(text, source, tag, tone, checked, info, absent) of a card's front.

    An agency's own sentence comes first; else a written summary that still has no
    fault against the texts at hand. absent: why there is neither.
    """
    info = F.concat(F.lit(WRITTEN_INFO[0]), F.coalesce(source, F.lit("the agency")), F.lit(WRITTEN_INFO[1]))
    tags = F.create_map(*[F.lit(x) for kv in SENTENCE_TAGS.items() for x in kv])

    def choose(own: Column) -> Column:
        return text.bound(sentences.select_sentence(own["text"], title), lambda found: shown(own, found))

    def shown(own: Column, found: Column) -> Column:
        seen = (own["source"] == "nih_phr") | checked.isNotNull()
        tag = F.when(seen, tags[own["source"]]).otherwise(TAG_ON_FILE)
        held = F.when(F.size(sentences.summary_faults(written, title, F.coalesce(own["text"], abstract, F.lit("")))) == 0, text.or_none(written))
        none = F.lit(None).cast("string")
        row = lambda t, where, mark, tone, ok, why: F.struct(t.alias("text"), where.alias("source"), mark.alias("tag"), F.lit(tone).alias("tone"), ok.alias("checked"), why.alias("info"), none.alias("absent"))
        empty = F.struct(none.alias("text"), none.alias("source"), none.alias("tag"), none.alias("tone"), F.lit(None).cast("boolean").alias("checked"), none.alias("info"), F.when(own.isNull(), "no_agency_text").otherwise("none_qualifies").alias("absent"))
        return F.when(found.isNotNull(), row(found, own["source"], tag, "stone", seen, none)).when(held.isNotNull(), row(held, F.lit("ai_summary"), F.lit(TAG_WRITTEN), "amber", F.lit(False), info)).otherwise(empty)

    return text.bound(agency_text(source, statement, abstract, generated), choose)


def card_topics(index_terms: Column, picked: Column, profile_hits: Column, fields: list[Column]) -> Column:
    """struct(terms, source): the index terms if there are two, else the picked ones that still stand in a text.

    Ranked terms come in; those go that have all words of a student's own hit, as the
    student or the text spells it. Fewer than two of either show nothing.
    """
    tokens = lambda t: F.filter(F.split(F.regexp_replace(F.lower(t), r"[^0-9a-z]+", " "), " "), lambda w: w != "")
    seen = F.filter(F.transform(F.coalesce(profile_hits, F.array().cast("array<string>")), tokens), lambda h: F.size(h) > 0)
    fresh = lambda terms: F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: ~F.exists(seen, lambda h: F.size(F.array_except(h, tokens(t))) == 0))
    standing = F.array_compact(F.transform(F.filter(F.coalesce(picked, F.array().cast("array<string>")), text.chip_allowed), lambda t: text.verbatim_in(t, fields)))
    index, own = (lists.without_overlap(fresh(x), TOPICS_SHOWN) for x in (index_terms, standing))
    row = lambda terms, source: F.struct(terms.alias("terms"), F.lit(source).alias("source"))
    return F.when(F.size(index) >= TOPICS_MIN, row(index, "nih_index_terms")).when(F.size(own) >= TOPICS_MIN, row(own, "ai_picked"))


def fetch_verdict(outcome: Column, stored: Column, federal: Column, least: float = 0.75) -> Column:
    """What a fetch says about a stored text. An award that was found without a text cannot have given the stored one."""
    sets = [F.array_distinct(text.words(F.lower(c))) for c in (stored, federal)]
    same = F.coalesce(lists.jaccard(*sets) >= least, F.lit(False))
    return F.when(outcome == "NOT_FOUND", "undecided").when(outcome == "FOUND_EMPTY", "generated").otherwise(F.when(same, "verbatim").otherwise("generated"))
