"""Index terms of awards: how many awards carry them, which ones tell most, where they stand in the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import lists, text
from tessera.operators import matching

MIN_AWARDS = 3
MAX_SHARE = 0.04


def document_frequency(awards: DataFrame, terms: str = "terms", least: int = MIN_AWARDS) -> DataFrame:
    """(term, awards) of terms on at least `least` awards; a term counts once an award."""
    clean = F.array_distinct(F.filter(F.transform(F.array_distinct(terms), text.collapse), lambda t: t != ""))
    return awards.select(F.explode(clean).alias("term")).groupBy("term").agg(F.count("*").alias("awards")).where(F.col("awards") >= least)


def term_scores(awards: DataFrame, frequency: DataFrame, total: int, key: str = "award") -> DataFrame:
    """(key, term, score) of terms that tell something about an award.

    awards: key, terms, title, statement, abstract. A term must be on at least
    MIN_AWARDS and at most MAX_SHARE of all awards, and stand in the title, in the
    statement, or twice in the abstract, in singular or plural. Of several spellings
    of a term that differ in case an award's first one counts.
    """
    usable = frequency.where((F.col("awards") >= MIN_AWARDS) & (F.col("awards") <= total * MAX_SHARE))
    counts = matching.own_term_counts(awards, "terms", key, ["title", "statement", "abstract"], plural=True, least=[1, 1, 2])
    found = counts.join(usable, "term").where(text.chip_allowed(F.col("term")))
    weight = F.when(F.col("title") > 0, 3.0).otherwise(0.0) + F.when(F.col("statement") > 0, 2.0).otherwise(0.0) + F.least("abstract", F.lit(5)) * 0.4
    return found.select(key, "term", (F.ln(F.lit(float(total)) / F.col("awards")) * weight).alias("score"))


def top_terms(scored: DataFrame, shown: int = 5, key: str = "award") -> DataFrame:
    """(key, chips): the best terms of an award, none of which says what a better one says."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.lower("term").alias("k"), "term")))  # the terms of one award
    return scored.groupBy(key).agg(order.alias("sorted")).select(key, lists.without_overlap(F.transform("sorted", lambda x: x["term"]), shown).alias("chips"))


def whole_word_hits(rows: DataFrame, terms: list[str], column: str) -> Column:
    """Which of a few terms stand in a text as whole words."""
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.regexp_like(F.col(column), text.whole_word(t)))


def inside_index_terms(term: Column, index_terms: Column) -> Column:
    """The index term that has all words of a term: the same first, then the shortest, then by alphabet."""
    tokens = lambda c: F.filter(F.split(F.regexp_replace(F.lower(c), r"[^0-9a-z]+", " "), " "), lambda w: w != "")
    fits = F.filter(index_terms, lambda i: (F.size(tokens(term)) > 0) & (F.size(F.array_except(tokens(term), tokens(i))) == 0))
    ranked = F.array_sort(F.transform(fits, lambda i: F.struct((F.lower(i) != F.lower(term)).alias("other"), F.length(i).alias("n"), i.alias("i"))))
    return F.get(ranked, F.lit(0))["i"]


def resolve_by_title_and_org(stored: DataFrame, found: DataFrame) -> DataFrame:
    """(id, found_id): stored rows whose title and a word of whose organisation meet exactly one found id."""
    s = stored.select("id", text.letters_key(F.col("title")).alias("t"), text.org_tokens(F.col("org")).alias("o"))
    f = found.select("found_id", text.letters_key(F.col("title")).alias("t"), text.org_tokens(F.col("org")).alias("p"))
    met = s.join(f, "t").where(F.arrays_overlap("o", "p"))
    return met.groupBy("id").agg(F.min("found_id").alias("found_id"), F.max("found_id").alias("last")).where(F.col("found_id") == F.col("last")).select("id", "found_id")
