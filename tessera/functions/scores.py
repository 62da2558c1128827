"""Vectors and scores as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; null if a vector is null."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a null or an all-zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def fit_width(a: Column, width: int) -> Column:
    """Cuts to `width` and scales to length 1, or pads with zeros."""
    cut = F.slice(a, 1, width)
    length = norm(cut)
    scaled = F.transform(cut, lambda x: x.cast("double") / F.when(length > 0, length).otherwise(1.0))
    padded = F.concat(F.transform(a, lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(width) - F.size(a))))
    return F.when(F.size(a) > width, scaled).otherwise(padded)


def is_usable(a: Column) -> Column:
    """Whether a vector is there and not all zero."""
    return F.coalesce(F.exists(a, lambda x: x != 0), F.lit(False))


def clamp_score(value: Column) -> Column:
    """A number or numeric text, rounded half to even, within 0 and 100; null where it is neither."""
    number = value.cast("string").try_cast("double")
    usable = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    return F.when(usable, F.greatest(F.lit(0), F.least(F.lit(100), F.bround(F.when(usable, F.greatest(F.lit(-1.0), F.least(F.lit(101.0), number)))).cast("int"))))


def tag_overlap(tags: Column, skills: Column) -> Column:
    """Share of tags, each as often as it stands there, that are among the lower-case skills, in percent; null without tags."""
    hits = F.size(F.filter(tags, lambda t: F.array_contains(skills, F.lower(t))))
    return F.when(F.size(tags) > 0, F.bround(F.try_divide(hits * F.lit(100.0), F.size(tags))).cast("int"))


def blend(semantic: Column, keyword: Column, weight: float = 0.65) -> Column:
    """The weighted mean of two scores, rounded; the semantic one alone where there is no keyword score."""
    mixed = F.bround(F.lit(weight) * semantic + F.lit(1 - weight) * keyword).cast("int")
    return F.when(keyword.isNull(), semantic).otherwise(mixed)


def components(semantic: Column, keyword: Column) -> Column:
    return F.struct(semantic.alias("semantic"), keyword.alias("keyword"), F.lit(0).alias("campus_boost"))


def amount_state(value: Column) -> Column:
    """What a stored amount says: value, not_published, zero or negative."""
    number = value.cast("string").try_cast("double")
    missing = number.isNull() | F.isnan(number)
    return F.when(missing, "not_published").when(number > 0, "value").when(number == 0, "zero").otherwise("negative")


def amount_or_none(value: Column) -> Column:
    number = value.cast("string").try_cast("double")
    return F.when(~F.isnan(number), number)


def same_amount(a: Column, b: Column) -> Column:
    """Equal up to half a cent; two missing amounts are equal."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) < 0.005)
