"""Agency records (JSON text) as the columns that all sources share.

Missing and wrongly typed values become null; blank text is null. A column tells
null (not said) from empty (said to be none) where the agency does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import or_none

_PERSON = "struct<is_contact_pi:boolean,full_name:string,title:string,profile_id:string>"
NIH = f"struct<activity_code:string,subproject_id:string,project_num:string,core_project_num:string,fiscal_year:string,phr_text:string,pref_terms:string,is_active:boolean,organization:struct<org_name:string,org_city:string,org_state:string,dept_type:string>,principal_investigators:array<{_PERSON}>,agency_ic_admin:struct<name:string>>"
NSF = "struct<id:string,awardeeName:string,awardeeCity:string,awardeeStateCode:string,pdPIName:string,piId:string,coPDPI:array<string>,orgLongName:string,orgLongName2:string,fundProgramName:string,activeAwd:string>"
SHARED = {
    "activity_code": "string", "subproject_id": "string", "project_num": "string", "core_project_num": "string", "fiscal_year": "int", "public_statement": "string",
    "agency_terms": "array<string>", "org_name_published": "string", "org_city": "string", "org_state": "string", "org_dept_category": "string",
    "pi_name_published": "string", "pi_title": "string", "pi_source_id": "string", "co_pis": "array<struct<name:string,title:string,source_id:string>>",
    "funder_name": "string", "funder_program": "string", "source_is_active": "boolean", "fields_fetched_at": "string",
}


def has_keys(record: Column, keys: list[str]) -> Column:
    """Whether a JSON object has all keys, whatever their values."""
    return F.coalesce(F.size(F.array_except(F.array(*[F.lit(k) for k in keys]), F.json_object_keys(record))) == 0, F.lit(False))


def _source_id(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), or_none(value))


def _named(prefix: str, p: Column) -> Column:
    return F.struct(or_none(p["full_name"]).alias("name"), or_none(p["title"]).alias("title"), _source_id(prefix, p["profile_id"]).alias("source_id"))


def _shared(values: dict[str, Column]) -> list[Column]:
    return [values.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in SHARED.items()]


def nih_columns(record: Column, fetched: Column) -> list[Column]:
    """The contact investigator, else the first, is the award's; the others with a name or id are beside them."""
    r = F.from_json(record, NIH)
    people = F.filter(r["principal_investigators"], lambda p: p.isNotNull())
    at = F.coalesce(F.nullif(F.array_position(F.transform(people, lambda p: F.coalesce(p["is_contact_pi"], F.lit(False))), True), F.lit(0)), F.lit(1)).cast("int")
    contact = F.get(people, at - 1)
    others = F.filter(F.transform(F.filter(people, lambda p, i: i != at - 1), lambda p: _named("nih", p)), lambda c: c["name"].isNotNull() | c["source_id"].isNotNull())
    terms = F.filter(F.transform(F.split(r["pref_terms"], ";"), lambda t: F.trim(t)), lambda t: t != "")
    org = r["organization"]
    return _shared({
        "activity_code": or_none(r["activity_code"]), "subproject_id": or_none(r["subproject_id"]), "project_num": or_none(r["project_num"]), "core_project_num": or_none(r["core_project_num"]),
        "fiscal_year": F.when(F.trim(r["fiscal_year"]).rlike(r"^\d+$"), F.trim(r["fiscal_year"])).try_cast("int"), "public_statement": F.when(F.trim(r["phr_text"]) != "", r["phr_text"]),
        "agency_terms": F.when(F.size(terms) > 0, terms), "org_name_published": or_none(org["org_name"]), "org_city": or_none(org["org_city"]), "org_state": or_none(org["org_state"]),
        "org_dept_category": or_none(org["dept_type"]), "pi_name_published": or_none(contact["full_name"]), "pi_title": or_none(contact["title"]), "pi_source_id": _source_id("nih", contact["profile_id"]),
        "co_pis": others, "funder_name": or_none(r["agency_ic_admin"]["name"]), "source_is_active": r["is_active"], "fields_fetched_at": fetched,
    })


def nsf_columns(record: Column, fetched: Column) -> list[Column]:
    """Mail addresses among co-investigators go; without that key a record says there are none."""
    r = F.from_json(record, NSF)
    names = F.transform(F.filter(r["coPDPI"], lambda c: c.isNotNull()), lambda c: F.array_join(F.filter(F.split(F.trim(c), r"\s+"), lambda w: ~F.contains(w, F.lit("@"))), " "))
    listed = F.transform(F.filter(names, lambda n: n != ""), lambda n: F.struct(n.alias("name"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("source_id")))
    none = F.array().cast(SHARED["co_pis"])
    others = F.when(has_keys(record, ["coPDPI"]), listed).when(or_none(r["id"]).isNotNull(), none)
    active = F.lower(F.trim(r["activeAwd"]))
    return _shared({
        "org_name_published": or_none(r["awardeeName"]), "org_city": or_none(r["awardeeCity"]), "org_state": or_none(r["awardeeStateCode"]), "pi_name_published": or_none(r["pdPIName"]),
        "pi_source_id": _source_id("nsf", r["piId"]), "co_pis": others, "funder_name": F.nullif(F.concat_ws(", ", or_none(r["orgLongName"]), or_none(r["orgLongName2"])), F.lit("")),
        "funder_program": or_none(r["fundProgramName"]), "source_is_active": F.when(active.isin("true", "false"), active == "true"), "fields_fetched_at": fetched,
    })


def unasked_columns() -> list[Column]:
    """The shared columns of a source that publishes none of them: all null, the stamp too."""
    return _shared({})
