"""Where a student's terms stand in an award's text, and which of them its card shows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as T

FIELDS = ("title", "public_statement", "abstract")
OWN_ORIGINS = ("narrative", "student_added", "cv", "sample")
SHOWN = 3

#: A single letter that is part of something else: of C++ and C#, joined by a mark to
#: a letter or digit (a slash beside an ordinary word of four letters is a list), a
#: genus before a lower-case name, an initial between two capitalised words.
_AFTER = r"(?![+#]|[&.\-'’]\w|/(?!(?=\p{L}*\p{Ll})\p{L}{4,}(?!\w))\w|\.\s{0,38}\p{Ll})"
_BEFORE = r"(?<!\w[&.\-'’])(?:(?<!\w/)|(?<=(?<!\w)\p{L}{4,40}/)(?<=\p{Ll}\p{L}{0,40}/))"
_INITIAL = r"(?:(?<!(?<!\S)\p{Lu}(?:\S{0,38}[^\s.:;])?\s{1,5})|(?!.\.\s{0,38}\p{Lu}))"

#: What may stand between two words of one name.
_GAP = r"[\s,/&()\-]*(?:(?:of|and|for|in|the)\s+)?"


def term_pattern(term: Column) -> Column:
    """whole_word, less single letters that are part of something else."""
    clean = T.collapse(term)
    letter = F.concat(F.lit(rf"(?U)(?<!\w){_BEFORE}{_INITIAL}"), F.regexp_replace(clean, r"(\W)", r"\\$1"), F.lit(rf"(?!\w){_AFTER}"))
    return F.when(F.length(clean) == 1, letter).otherwise(T.whole_word(term))


def places(term: Column, value: Column) -> Column:
    """struct(n, at, shown): how often a term stands in a text, where first (from 0), and as what; n is 0 without it."""
    pattern = term_pattern(term)
    found = F.regexp_extract_all(F.coalesce(value, F.lit("")), pattern, F.lit(0))
    return F.struct(F.size(found).alias("n"), (F.regexp_instr(F.coalesce(value, F.lit("")), pattern) - 1).alias("at"), F.get(found, F.lit(0)).alias("shown"))


def in_name_run(value: Column, at: Column, shown: Column) -> Column:
    """Whether a word with a capital stands beside another one, as part of a name; acronyms tell nothing."""
    capital = shown.rlike(r"^\p{Lu}") & (shown != F.upper(shown))
    before = F.substring(value, F.greatest(at - 59, F.lit(1)), F.least(at, F.lit(60)))
    after = F.substring(value, at + F.length(shown) + 1, F.lit(60))
    word = r"\p{Lu}[\w'’]{2,}"
    return capital & (before.rlike(rf"(?U)(?<![\w'’]){word}{_GAP}$") | after.rlike(rf"(?U)^{_GAP}{word}"))


def front_hit(term: Column, origin: Column, title: Column, statement: Column, abstract: Column) -> Column:
    """struct(field, shown, rank) of the first field with the term; null without one.

    rank: the field's place and, in an abstract, how much the mention tells: often or
    early, else once and late by the student's own word, else by another's. A single
    late mention inside a name has rank null: it counts, but is not shown.
    """
    spans = [places(term, v) for v in (title, statement, abstract)]
    central = (spans[2]["n"] > 1) | (spans[2]["at"] * 3 < F.length(abstract))
    late = F.when(~in_name_run(abstract, spans[2]["at"], spans[2]["shown"]), F.when(origin.isin(*OWN_ORIGINS), 21).otherwise(22))
    ranks = (F.lit(0), F.lit(10), F.when(central, 20).otherwise(late))
    each = [F.struct(F.lit(f).alias("field"), s["shown"].alias("shown"), r.alias("rank")) for f, s, r in zip(FIELDS, spans, ranks)]
    return F.when(spans[0]["n"] > 0, each[0]).when(spans[1]["n"] > 0, each[1]).when(spans[2]["n"] > 0, each[2])


def front_hits(terms: Column, title: Column, statement: Column, abstract: Column, shown: int = SHOWN) -> Column:
    """struct(rows, total): the chips of a card and how many terms were found; null terms were not loaded.

    terms: array<struct<term,origin>> in the student's order, which decides within a rank.
    """
    hits = F.transform(terms, lambda t, i: F.struct(front_hit(t["term"], t["origin"], title, statement, abstract).alias("hit"), i.alias("at"), t["term"].alias("term"), t["origin"].alias("origin")))
    found = F.filter(hits, lambda h: h["hit"].isNotNull())
    ranked = F.array_sort(F.transform(F.filter(found, lambda h: h["hit"]["rank"].isNotNull()), lambda h: F.struct(h["hit"]["rank"].alias("rank"), h["at"].alias("at"), h["term"].alias("term"), h["hit"]["shown"].alias("shown"), h["hit"]["field"].alias("field"), h["origin"].alias("origin"))))
    rows = F.transform(F.slice(ranked, 1, shown), lambda r: F.struct(r["term"].alias("term"), r["shown"].alias("shown"), r["field"].alias("field"), r["origin"].alias("origin")))
    return F.when(terms.isNotNull(), F.struct(rows.alias("rows"), F.size(found).alias("total")))


def own_text_scan(known: list[str], value: Column) -> Column:
    """Those of some known terms that a student's own text has as whole words, in the list's order."""
    return F.filter(F.array(*[F.lit(k) for k in known]), lambda k: F.regexp_like(F.coalesce(value, F.lit("")), T.whole_word(k)))


def window(value: Column, begin: Column, end: Column, longest: int = 300) -> Column:
    """struct(text, begin, cut_before, cut_after): at most `longest` signs around a term, cut at the ends of words; places from 0."""
    spare = F.greatest(F.lit(0), F.floor((F.lit(longest) - (end - begin)) / 2)).cast("int")
    first = F.greatest(F.lit(0), F.least(begin - spare, F.length(value) - longest))
    # to the next word's start if the cut is inside of one, and back to the last word's end
    head = F.when(first == 0, 0).otherwise(F.coalesce(F.nullif(F.regexp_instr(F.substring(value, first + 1, begin - first + 1), F.lit(r"\s")), F.lit(0)), F.lit(0)))
    start = F.least(first + head, begin)
    room = F.substring(value, start + 1, F.lit(longest))
    whole = start + F.length(room) >= F.length(value)
    kept = F.when(whole, room).otherwise(F.when(F.length(F.regexp_replace(room, r"\s+\S*$", "")) >= end - start, F.regexp_replace(room, r"\s+\S*$", "")).otherwise(room))
    return F.when(begin.isNotNull(), F.struct(kept.alias("text"), start.alias("begin"), (start > 0).alias("cut_before"), (~whole).alias("cut_after")))
