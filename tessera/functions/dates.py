"""Calendar rules of award records; the day of comparison is always given, never read from a clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IMPLAUSIBLE_YEARS = 10


def iso_day(value: Column) -> Column:
    """The day that a text begins with; null if there is none such."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.to_date(F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd"))))


def us_date_text(value: Column) -> Column:
    """MM/DD/YYYY as YYYY-MM-DD; other texts as they are."""
    parts = F.split(value, "/")
    pad = lambda c: F.lpad(c, 2, "0")
    return F.when(F.size(parts) == 3, F.concat_ws("-", F.get(parts, F.lit(2)), pad(F.get(parts, F.lit(0))), pad(F.get(parts, F.lit(1))))).otherwise(value)


def month_label(day: Column) -> Column:
    return F.date_format(day, "MMM yyyy")


def whole_months(today: Column, end: Column) -> Column:
    """Months until a day, the last one only if its day of month is reached; 0 at least."""
    months = (F.year(end) - F.year(today)) * 12 + F.month(end) - F.month(today)
    return F.greatest(F.lit(0), months - F.when(F.day(end) < F.day(today), 1).otherwise(0))


def time_left(months: Column) -> Column:
    years, rest = F.floor(months / 12).cast("string"), (months % 12).cast("string")
    return (
        F.when(months < 1, "under 1 mo left")
        .when((months >= 12) & (months % 12 > 0), F.concat(years, F.lit(" yr "), rest, F.lit(" mo left")))
        .when(months >= 12, F.concat(years, F.lit(" yr left")))
        .otherwise(F.concat(rest, F.lit(" mo left")))
    )


def funding_state(start: Column, end: Column, checked: Column, today: Column) -> Column:
    """One of no_end_date, implausible_end, ended, end_on_file_passed, starts_later and funded."""
    horizon = F.add_months(today, 12 * IMPLAUSIBLE_YEARS)
    return (
        F.when(end.isNull(), "no_end_date")
        .when(end > horizon, "implausible_end")
        .when((end < today) & F.coalesce(checked > end, F.lit(False)), "ended")
        .when(end < today, "end_on_file_passed")
        .when(F.coalesce(start > today, F.lit(False)), "starts_later")
        .otherwise("funded")
    )


def funding_label(start: Column, end: Column, state: Column) -> Column:
    label = month_label(end)
    return (
        F.when(state == "no_end_date", "No end date on file")
        .when(state == "implausible_end", F.concat(F.lit("End date on file: "), label, F.lit(", likely a data error")))
        .when(state == "ended", F.concat(F.lit("Award ended "), label))
        .when(state == "end_on_file_passed", F.concat(F.lit("End date on file: "), label, F.lit(" (passed)")))
        .when(state == "starts_later", F.concat(F.lit("Starts "), month_label(start), F.lit(" · funded through "), label))
        .otherwise(F.concat(F.lit("Funded through "), label))
    )


def support_year(project: Column) -> Column:
    """The two digits at a project number's end, as a number."""
    return F.nullif(F.regexp_extract(project, r"-(\d{2})[A-Z0-9]*$", 1), F.lit("")).cast("int")


def is_active(end: Column, today: Column) -> Column:
    """No end date, or one that has not passed; the last day counts."""
    return end.isNull() | (end >= today)


def follow_up_due(status: Column, outreach: Column, contacted: Column, responded: Column, reminder: Column, now: Column, days: float = 6) -> Column:
    """Written to, no answer, no reminder still to come, and six days or more ago."""
    waited = (F.unix_timestamp(now) - F.unix_timestamp(contacted)) / 86400.0
    silent = outreach.isNull() | outreach.isin("sent", "no_reply")
    return F.coalesce((status == "emailed") & responded.isNull() & silent & F.coalesce(reminder <= now, F.lit(True)) & (waited >= days), F.lit(False))
