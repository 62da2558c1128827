"""The researchers and the place that a card names, by what the agency published."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.functions import text as T

#: Sources that publish no researcher, so that a name beside them was found otherwise (fixed values).
WITHOUT_PEOPLE = ("DOD", "DNR", "DOE", "EPA", "NASA", "USDA", "Federal")
CO_PIS = "array<struct<name:string,title:string,source_id:string>>"


def without_dr(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r"^(?i:dr)\.?\s+", "")


def name_is_generated(name: Column, flag: Column, source: Column) -> Column:
    """Whether a shown name was not published; without a flag the source decides, and rather warns than vouches."""
    return F.when(~T.is_resolved(name), F.lit(False)).otherwise(F.coalesce(flag, F.coalesce(source, F.lit("")).isin(*WITHOUT_PEOPLE)))


def co_investigators(stored: Column) -> Column:
    """array<struct<name,title>> of a stored list or its JSON; null if there is none or it cannot be read."""
    return F.transform(F.filter(F.from_json(stored, CO_PIS), lambda p: T.or_none(p["name"]).isNotNull()), lambda p: F.struct(names.person(T.collapse(p["name"])).alias("name"), names.sentence_case(p["title"]).alias("title")))


def published_person(name: Column, generated: Column, fetched: Column, published: Column, title: Column, source_id: Column, others: Column) -> Column:
    """struct(name, name_published, name_basis, title, source_id, other_investigators).

    A name that was not published is never shown as the agency's; without a fetch
    nothing of the agency's is known.
    """
    stored = F.when(T.is_resolved(name), without_dr(name))
    ai, asked = F.coalesce(generated, F.lit(False)), fetched.isNotNull()
    known = ~ai & asked & T.or_none(published).isNotNull()
    read = ~ai & asked
    basis = F.when(ai & stored.isNotNull(), "ai_identified").when(known, "published").when(stored.isNotNull(), "stored").otherwise("none")
    return F.struct(
        F.when(known, names.person(published)).otherwise(stored).alias("name"), F.when(known, T.or_none(published)).alias("name_published"), basis.alias("name_basis"),
        F.when(known, names.sentence_case(title)).alias("title"), F.when(read, T.or_none(source_id)).alias("source_id"), F.when(read, co_investigators(others)).alias("other_investigators"),
    )


def place(university: Column, published: Column, city: Column, state: Column) -> Column:
    """struct(institution, institution_published, city, state): the published institution, else the stored one."""
    own = T.or_none(published)
    return F.struct(F.coalesce(names.institution(own), names.stored_institution(university), F.lit("N/A")).alias("institution"), own.alias("institution_published"), names.institution(city, city=True).alias("city"), T.or_none(state).alias("state"))
