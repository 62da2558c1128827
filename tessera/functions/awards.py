"""Kinds and fields of awards, and records of the spending register."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scores
from tessera.functions import text as T

#: What activity codes of one agency mean (fixed values).
CODES = {
    "research_project": "R00 R01 R03 R21 R33 R35 R37 R61 RF1 U01 UG3 UH3 DP1 DP2 DP5",
    "named_by_agency": "R15 R25 T34",
    "multi_project": "P01 P20 P30 P50 U54 UM1",
    "training": "T32 T35",
    "career": "K01 K08 K23 K99",
    "fellowship": "F30 F31 F32 F99",
    "resource": "U24 R24 P41",
    "small_business": "R41 R42 R43 R44",
    "conference": "R13 U13",
}
#: What prefixes of titles of another agency mean (fixed values).
PREFIXES = {
    "career": "early_career_faculty", "collaborative research": "research_project", "crii": "research_project", "eager": "research_project", "rapid": "research_project",
    "reu site": "undergraduate_site", "conference": "conference", "mri": "equipment", "sbir phase i": "small_business", "sbir phase ii": "small_business",
    "sttr": "small_business", "sttr phase i": "small_business", "sttr phase ii": "small_business",
}
DEFAULT_KIND = "research_project"
PREFIXES_READ, LONGEST_PREFIX = 4, 40
#: Tags of kinds that have one (fixed values).
TAGS = {
    "subproject": "Part of a larger grant", "multi_project": "Multi-project grant", "training": "Training program", "career": "Career award", "early_career_faculty": "Early-career faculty award",
    "fellowship": "Individual fellowship", "resource": "Shared research resource", "small_business": "Small-business award", "conference": "Conference grant", "equipment": "Equipment grant", "undergraduate_site": "Undergraduate research site",
}
#: Directorates whose names make a field line (fixed values).
DIRECTORATES = (
    "Computer and Information Science and Engineering", "Mathematical and Physical Sciences", "Biological Sciences", "Engineering", "STEM Education", "Geosciences",
    "Technology, Innovation, and Partnerships", "Social, Behavioral and Economic Sciences",
)
#: Short names of agencies in the spending register (fixed values).
AGENCIES = {
    "Department of Defense": "DOD", "Department of the Interior": "DNR", "Department of Energy": "DOE", "Environmental Protection Agency": "EPA",
    "National Aeronautics and Space Administration": "NASA", "Department of Agriculture": "USDA",
}


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def kind_by_code(code: Column, subproject: Column) -> Column:
    """What an activity code says; a part of a larger award is that before all; unknown codes say nothing."""
    known = {c: kind for kind, codes in CODES.items() for c in codes.split()}
    return F.when(T.or_none(subproject).isNotNull(), "subproject").otherwise(_lookup(known, F.upper(F.trim(code))))


def kind_tag(kind: Column) -> Column:
    return _lookup(TAGS, kind)


def title_prefixes(title: Column) -> Column:
    """array<struct<prefix,kind>>: the known prefixes before colons at the beginning of a title, up to the first unknown one."""

    def known(heads: Column) -> Column:
        unknown = F.array_position(F.transform(heads, lambda h: h["kind"].isNull()), True)
        return F.when(unknown == 0, heads).otherwise(F.slice(heads, F.lit(1), F.greatest(unknown.cast("int") - 1, F.lit(0))))

    parts = F.split(F.coalesce(title, F.lit("")), ":")
    heads = F.slice(parts, F.lit(1), F.least(F.lit(PREFIXES_READ), F.size(parts) - 1))
    each = F.transform(heads, lambda h: F.struct(F.trim(h).alias("prefix"), F.when(F.length(h) <= LONGEST_PREFIX, _lookup(PREFIXES, T.normal_key(h))).alias("kind")))
    return T.bound(each, known)


def award_kind(source: Column, title: Column, code: Column, subproject: Column, fetched: Column, official: Column) -> Column:
    """struct(kind, tag, tag_is_official, code, official_name, state).

    One agency's kinds follow from its activity codes, whose names come as `official`;
    without a fetch they are not loaded. Another's follow from prefixes of titles: of
    several the first that says more than research. What neither says is unknown.
    """
    none = F.lit(None).cast("string")

    def row(state: str, kind: Column = none, tag: Column = none, named: bool = False, basis: Column = none, name: Column = none) -> Column:
        return F.struct(kind.alias("kind"), tag.alias("tag"), F.lit(named).alias("tag_is_official"), basis.alias("code"), name.alias("official_name"), F.lit(state).alias("state"))

    key = F.upper(T.or_none(code))
    own = T.or_none(official)
    kind = F.when(own.isNotNull() & key.isNotNull(), kind_by_code(key, subproject))
    by_code = (
        F.when(~F.coalesce(fetched, F.lit(False)), row("not_loaded")).when(kind.isNull(), row("unknown", basis=key, name=own))
        .when(kind == "named_by_agency", row("value", kind, own, True, key, own)).otherwise(row("value", kind, kind_tag(kind), False, key, own))
    )

    def by_prefix(found: Column) -> Column:
        telling = F.coalesce(F.get(F.filter(found, lambda p: p["kind"] != DEFAULT_KIND), F.lit(0)), F.get(found, F.lit(0)))
        return F.when(F.size(found) > 0, row("value", telling["kind"], kind_tag(telling["kind"]), False, telling["prefix"])).otherwise(row("unknown"))

    return F.when(source == "NIH", by_code).when(source == "NSF", T.bound(title_prefixes(title), by_prefix)).otherwise(row("unknown"))


def with_official_names(rows: DataFrame, names: DataFrame, code: str = "code") -> DataFrame:
    """The rows with `official_name` from a table (code, name) of activity codes."""
    listed = names.select(F.upper(F.trim("code")).alias("_code"), F.col("name").alias("official_name")).dropDuplicates(["_code"])
    return rows.join(listed, F.upper(F.trim(code)) == F.col("_code"), "left").drop("_code")


def field_line(source: Column, funder: Column) -> Column:
    """struct(label, source): the institute in full, or the directorate without that word; null where neither is named."""
    name = T.collapse(T.or_none(funder))
    labels = [F.when(F.startswith(F.lower(name), F.lit(f"directorate for {d}".lower())), F.lit(d)) for d in DIRECTORATES]
    directorate = F.coalesce(*labels)
    line = lambda label, kind: F.struct(label.alias("label"), F.lit(kind).alias("source"))
    return F.when((source == "NIH") & name.isNotNull(), line(name, "nih_institute")).when((source == "NSF") & directorate.isNotNull(), line(directorate, "nsf_directorate"))


SPENDING_COLUMNS = ("award_id", "grant_title", "grant_abstract", "pi_name", "university", "department", "funding_source", "award_amount", "start_date", "end_date", "methodologies")


def spending_records(rows: DataFrame, record: str, agency: str) -> DataFrame:
    """The rows with SPENDING_COLUMNS read from a record of the spending register and its agency.

    Such a record names no researcher, and its description is its title. One without a
    description, or that is no JSON, has a null title and is no award.
    """
    r = F.from_json(record, "`Award ID` string, `Recipient Name` string, `Start Date` string, `End Date` string, `Award Amount` string, `Awarding Sub Agency` string, Description string")
    title = r["Description"]
    for mark in ("'", '"'):
        title = F.when(F.startswith(title, F.lit(mark)) & F.endswith(title, F.lit(mark)) & (F.length(title) > 1), F.substring(title, F.lit(2), F.length(title) - 2)).otherwise(title)
    read = [
        r["Award ID"].alias("award_id"), F.lit(T.UNRESOLVED_PI).alias("pi_name"), T.title_case(F.trim(F.coalesce(r["Recipient Name"], F.lit("Unknown Institution")))).alias("university"),
        T.title_case(T.or_none(r["Awarding Sub Agency"])).alias("department"), F.coalesce(_lookup(AGENCIES, F.col(agency)), F.lit("Federal")).alias("funding_source"), scores.amount_or_none(r["Award Amount"]).alias("award_amount"),
        r["Start Date"].alias("start_date"), r["End Date"].alias("end_date"),
    ]
    titled = rows.select("*", T.or_none(T.strip_html(title)).alias("grant_title"), *read)  # before the methods are looked for
    return titled.select(*rows.columns, *[F.col("grant_title").alias(c) if c == "grant_abstract" else T.scan_methods(F.col("grant_title"), F.col("grant_title")).alias(c) if c == "methodologies" else c for c in SPENDING_COLUMNS])


def amount_basis(source: Column) -> Column:
    """What a stored amount measures; null for a source of which that is not known."""
    return F.when(source == "NIH", "nih_fiscal_year").when(source == "NSF", "nsf_obligated").when(source.isin(*AGENCIES.values()), "usaspending_obligation")
