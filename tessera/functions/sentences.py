"""Sentences of award texts: where they end, why one cannot be shown, what a written one may say.

Everything is a column expression. Regular expressions look back over bounded
spans only, so a long unbroken token costs no more than its length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as T

# Lengths, and words that decide about a sentence.
LEAST_WORDS, MOST_WORDS, MOST_CHARS, SCANNED, LEAST_TOPICS = 8, 28, 160, 8, 3
ABBREVIATIONS = ("dr", "prof", "mr", "mrs", "ms", "st", "fig", "figs", "eq", "ref", "refs", "no", "vs", "al", "etc", "inc", "ltd", "co", "approx", "ca", "cf", "e.g", "i.e", "u.s", "ph.d", "m.d", "jr", "sr")
SUBORDINATORS = ("although", "because", "however", "if", "since", "though", "unless", "when", "whereas", "whether", "while", "but", "and", "or", "thus", "therefore", "moreover", "furthermore")
DANGLING = r"(?i)^(?:this|these|those|that|it|they|such|he|she|its|their|both)\b(?!\s+(?:project|proposal|award|study|research|program|work|grant|application))"
VERBS = r"(?i)\b(?:is|are|was|were|be|been|has|have|had|will|can|may|must|should|do|does|did|\p{L}+(?:s|ed|es))\b"
WORK = r"(?i)\b(?:stud(?:y|ies)|investigat\w+|develop\w*|test\w*|examin\w+|measur\w+|build\w*|design\w*|creat\w+|identif\w+|determin\w+|characteri[sz]\w+|map\w*|model\w*|explor\w+|analy[sz]\w+|evaluat\w+|aims? to|seeks? to)\b"
OUTCOME = r"(?i)\b(?:improve|lead to|benefit|enable|advance|impact|understanding)\w*\b"
HYPE = r"(?i)\b(?:novel|groundbreaking|cutting-edge|innovative|transformative|paradigm|state-of-the-art|unprecedented|revolutionary|synergistic|leverage\w*)\b"
HOUSEKEEPING = r"(?i)\b(?:see attached|references cited|page limit|budget justification|as described above|specific aims?:)\b"
SELF = r"(?i)\b(?:our (?:laboratory|group|team) (?:is|has)|we are (?:uniquely|well))\b"
ADMINISTRATIVE = r"(?i)\b(?:intellectual merit|broader impacts?|statutory mission|worthy of support|administrative core|training program|mentor\w*|recruit\w*)\b"
LIST = r"(?i)(?:the following|as follows|include):?\s*$"
FIRST_PERSON = r"(?i)\b(?:we|our|ours|us|i|my|mine)\b"
SUPERLATIVE = r"(?i)\b(?:best|first ever|leading|most|unique|only|world-class|breakthrough|cure[sd]?|guarantee\w*)\b"
FORBIDDEN = r"(?i)\b(?:hir(?:e|es|ing)|open(?:ing)?s? (?:position|for students)|apply|internships?|volunteers?|join the lab|stipends?)\b"
COMMON = ("about", "after", "also", "among", "before", "being", "between", "could", "during", "every", "from", "have", "into", "more", "other", "over", "project", "research", "should", "some", "study", "such", "than", "that", "their", "them", "then", "there", "these", "they", "this", "those", "through", "under", "using", "well", "were", "what", "when", "where", "which", "while", "will", "with", "work", "would", "your")


def split_sentences(value: Column) -> Column:
    """Sentences without the white space between them; an abbreviation, an initial or a small letter after it is no end."""
    short = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    # white space first, so that nothing is looked back from other signs
    end = rf"(?U)(?=\s)(?:(?<=[.!?][\"'”’)\]]{{0,3}})(?<!(?i)(?<![\p{{L}}.])(?:{short})\.)(?<!(?<!\p{{L}})\p{{L}}\.)\s+(?!\p{{Ll}})|(?<=[!?][\"'”’)\]]{{0,3}})\s+|\n[ \t]*\n\s*)"
    return F.filter(F.transform(F.split(value, end), lambda s: F.trim(s)), lambda s: s != "")


def content_words(value: Column) -> Column:
    """Distinct words of five letters or more that are about something, by their first six letters."""
    found = F.regexp_extract_all(F.lower(value), F.lit(r"\p{L}{5,}"), F.lit(0))
    return F.array_distinct(F.transform(F.array_except(found, F.array(*[F.lit(w) for w in COMMON])), lambda w: F.substring(w, 1, 6)))


def acronyms(value: Column) -> Column:
    """Capital words of two to six letters that the text does not spell out in brackets beside them."""
    found = F.array_distinct(F.regexp_extract_all(value, F.lit(r"\b[A-Z][A-Z0-9]{1,5}\b"), F.lit(0)))
    return F.filter(found, lambda a: ~F.contains(value, F.concat(F.lit("("), a, F.lit(")"))) & ~F.regexp_like(value, F.concat(a, F.lit(r"\s*\("))))


def rejection(sentence: Column) -> Column:
    """The first reason why a sentence cannot be shown; null if it can."""
    return T.bound(T.collapse(sentence), lambda s: T.bound(F.struct(s.alias("s"), T.words(s).alias("words")), lambda x: _rejection(x["s"], x["words"])))


def _rejection(s: Column, words: Column) -> Column:
    first = F.lower(F.regexp_replace(F.get(words, F.lit(0)), r"^\W+|\W+$", ""))
    return (
        F.when(s.isNull() | s.rlike(r"^[^a-z]{0,60}$") | s.rlike(r"^[\p{L} /]{0,40}:$"), "label_residue")
        .when(s.rlike(LIST), "list_announcement")
        .when(s.rlike(r"\?[\"'”’)\]]*$"), "question")
        .when(F.size(words) < LEAST_WORDS, "too_short")
        .when(F.size(words) > MOST_WORDS, "too_long_words")
        .when(F.length(s) > MOST_CHARS, "too_long_chars")
        .when(first.isin(*SUBORDINATORS), "subordinator")
        .when(s.rlike(DANGLING), "dangling_reference")
        .when(~s.rlike(VERBS), "no_finite_verb")
        .when(F.size(acronyms(s)) > 0, "unexpanded_acronym")
        .when(s.rlike(HOUSEKEEPING), "housekeeping")
        .when(s.rlike(SELF), "self_description")
        .when(s.rlike(ADMINISTRATIVE), "administrative")
        .when(s.rlike(r"(?i)\b\p{L}+-\p{L}+ \p{L}+-\p{L}+ \p{L}+-\p{L}+\b"), "hype_or_jargon")
        .when(F.size(content_words(s)) < LEAST_TOPICS, "no_topic")
    )


def strength(sentence: Column) -> Column:
    """2 if a sentence states the work, 1 if only what is hoped for, else 0."""
    return F.when(sentence.rlike(WORK), 2).when(sentence.rlike(OUTCOME), 1).otherwise(0)


def repeats_title(sentence: Column, title: Column) -> Column:
    """Fewer than four new words, and most of its words are the title's."""

    def told(x: Column) -> Column:
        return (x["new"] < 4) & (x["own"] > 0) & ((x["own"] - x["new"]) >= 0.6 * x["own"])

    sizes = lambda own: F.struct(F.size(own).alias("own"), F.size(F.array_except(own, content_words(title))).alias("new"))
    return T.bound(T.bound(content_words(sentence), sizes), told)


def select_sentence(value: Column, title: Column) -> Column:
    """Among the first sentences the first that can be shown and states the work, one without hype before one with."""
    ranked = F.transform(F.slice(split_sentences(value), 1, SCANNED), lambda s, i: F.struct(s.rlike(HYPE).alias("hype"), i.alias("at"), s.alias("sentence")))
    good = F.filter(ranked, lambda r: rejection(r["sentence"]).isNull() & (strength(r["sentence"]) == 2) & ~F.coalesce(repeats_title(r["sentence"], title), F.lit(False)))
    return F.get(F.array_sort(good), F.lit(0))["sentence"]


def evidence(term: Column, value: Column) -> Column:
    """struct(sentence, offsets): the first sentence with a term as a whole word, and where, in UTF-16 units; null without one.

    A term whose own full stop ends a sentence is looked for in the whole text.
    """
    pattern = T.whole_word(term)
    first = F.get(F.filter(split_sentences(value), lambda s: F.regexp_like(s, pattern)), F.lit(0))
    sentence = F.when(F.regexp_like(value, pattern), F.coalesce(first, value))  # a text without the term is not split
    return T.bound(sentence, lambda s: F.when(s.isNotNull(), F.struct(s.alias("sentence"), _offsets(s, pattern).alias("offsets"))))


def _offsets(sentence: Column, pattern: Column) -> Column:
    units = lambda c: T.utf16_length(c)
    gaps, hits = F.split(sentence, pattern), F.regexp_extract_all(sentence, pattern, F.lit(0))
    pairs = F.slice(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), F.lit(1), F.size(hits))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + units(x["gap"])
        return F.struct((begin + units(x["hit"])).alias("at"), F.concat(state["out"], F.array(F.struct(begin.alias("begin"), (begin + units(x["hit"])).alias("end")))).alias("out"))

    return F.aggregate(pairs, start, step, lambda state: state["out"])


def _reasons(tests: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(c, name) for name, c in tests]))


def summary_faults(summary: Column, title: Column, source: Column) -> Column:
    """Every reason against a one-sentence summary; empty if it may be shown.

    Numbers, names and content words must occur in title or source text.
    """
    s, ground = T.collapse(summary), F.concat_ws("\n", title, source)
    numbers = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"\d[\d,]*(?:\.\d+)?"), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit("")))
    names = F.regexp_extract_all(F.regexp_replace(s, r"^\S+", ""), F.lit(r"\b\p{Lu}\p{Ll}{2,}\b"), F.lit(0))
    n = F.size(T.words(s))
    return F.when(F.coalesce(s, F.lit("")) == "", F.array(F.lit("empty"))).otherwise(
        _reasons([
            ("not_one_sentence", (F.size(split_sentences(F.trim(summary))) != 1) | F.contains(F.trim(summary), F.lit("\n")) | F.contains(s, F.lit(";")) | ~s.rlike(r"[.!]$") | s.rlike(r"^[\"'“‘*\-–—•#]") | s.rlike(r"[()\[\]]")),
            ("too_short", n < LEAST_WORDS), ("too_long", n > MOST_WORDS),
            ("first_person", s.rlike(FIRST_PERSON)), ("forbidden_topic", s.rlike(FORBIDDEN)), ("superlative", s.rlike(SUPERLATIVE)),
            ("number_not_in_input", F.size(F.array_except(numbers(s), numbers(ground))) > 0),
            ("name_not_in_input", F.exists(names, lambda w: ~F.contains(ground, w))),
            ("word_not_in_input", F.size(F.array_except(content_words(s), content_words(ground))) > 0),
            ("acronym", F.size(acronyms(s)) > 0),
            ("verbatim_copy", F.contains(F.lower(T.collapse(ground)), F.lower(F.regexp_replace(s, r"[.!]$", "")))),
        ])
    )


#: Words of awards and agencies that a first letter to a stranger must not use (fixed values).
AWARD_WORDS = ("grant", "award", "funding", "funded", "obligation", "federal")
AGENCIES = ("NIH", "NSF", "DOD", "DOE", "NASA", "USDA", "EPA")
_REQUIRES = r"(?i)\b(?:your (?:lab|group|project)|the (?:lab|project)) (?:needs?|requires?|is looking for|is seeking|requested)\b"


def draft_faults(subject: Column, body: Column, title: Column, person: Column, institution: Column, has_cv: Column) -> Column:
    """struct(hard, soft): what makes a drafted letter untrue, and what only makes it poor."""
    whole = F.concat_ws("\n", subject, body)
    low, named = F.lower(whole), F.lower(F.concat_ws(" ", person, institution))
    word = lambda w: rf"\b{w}\b"
    attached = whole.rlike(r"(?i)\battach(?:ed|ment|ments|ing)?\b")
    n, blocks = F.size(T.words(body)), F.size(F.filter(F.split(body, "\n\n"), lambda b: F.trim(b) != ""))
    # "I am ... at <institution>" in one sentence, unless what stands between speaks of the reader's group
    clauses = F.transform(F.regexp_extract_all(low, F.lit(r"\bi(?:'m| am)\b[^.!?]*"), F.lit(0)), lambda c: F.regexp_replace(c, r"\bat the\b", "at"))
    spot = F.concat(F.lit(" at "), F.lower(F.trim(institution)))
    readers = r"\byour (?:group|lab|laboratory|research|team|work)\b"
    attends = (F.trim(institution) != "") & F.exists(clauses, lambda c: F.contains(c, spot) & ~F.split_part(c, spot, F.lit(1)).rlike(readers))
    hard = [("dollar_amount", whole.rlike(r"\$\s*\d")), ("title_quoted", (F.size(T.words(title)) >= 4) & F.contains(low, F.lower(title)))]
    hard += [(f"word_{w}", low.rlike(word(w)) & ~named.rlike(word(w))) for w in AWARD_WORDS]
    hard += [(f"agency_{a}", whole.rlike(word(a))) for a in AGENCIES]
    hard += [("attachment", ~has_cv & attached), ("affiliation", attends), ("lab_requirement", whole.rlike(_REQUIRES) & ~low.rlike(r"\bif (?:your|the)\b"))]
    soft = [("cv_not_named", has_cv & ~attached), ("length", ~n.between(90, 210)), ("blocks", blocks < 4)]
    return F.struct(_reasons(hard).alias("hard"), _reasons(soft).alias("soft"))


def cut_at_sentence_end(value: Column, limit: int) -> Column:
    """The whole sentences that fit a limit, one space apart; the bare limit if not even one fits."""
    whole = F.aggregate(split_sentences(value), F.lit(""), lambda kept, s: F.when(F.endswith(kept, F.lit("\u0000")), kept).when(F.length(kept) + 1 + F.length(s) <= limit, F.trim(F.concat(kept, F.lit(" "), s))).otherwise(F.concat(kept, F.lit("\u0000"))))
    kept = F.replace(whole, F.lit("\u0000"), F.lit(""))
    return F.when(F.length(value) <= limit, value).when(kept != "", kept).otherwise(F.substring(value, 1, limit))
