"""Order-dependent rules over arrays, as folds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Shared over united distinct members; 0 if either side is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def distinct_ignoring_case(values: Column, skip: Column | None = None) -> Column:
    """The first spelling of each value, in order; blanks go, and so does what `skip` has in any case."""
    clean = F.filter(F.transform(values, lambda v: F.trim(F.regexp_replace(v, r"\s+", " "))), lambda v: v != "")
    if skip is not None:
        low = F.transform(F.coalesce(skip, F.array().cast("array<string>")), lambda v: F.lower(F.trim(F.regexp_replace(v, r"\s+", " "))))
        clean = F.filter(clean, lambda v: ~F.array_contains(low, F.lower(v)))
    empty = F.array().cast("array<string>")
    return F.aggregate(clean, empty, lambda kept, v: F.when(F.exists(kept, lambda k: F.lower(k) == F.lower(v)), kept).otherwise(F.concat(kept, F.array(v))))


def without_overlap(sorted_terms: Column, shown: int = 5) -> Column:
    """Keeps a term if its words are neither all among nor a superset of those of a kept one, up to `shown`.

    Words are of a-z and 0-9; a term without any repeats nothing.
    """
    tokens = lambda t: F.filter(F.split(F.regexp_replace(F.lower(t), r"[^0-9a-z]+", " "), " "), lambda w: w != "")
    known = F.transform(sorted_terms, lambda t: F.struct(t.alias("term"), tokens(t).alias("words")))
    inside = lambda a, b: F.size(F.array_except(a, b)) == 0
    clash = lambda kept, t: F.exists(kept, lambda k: (F.size(k["words"]) > 0) & (F.size(t["words"]) > 0) & (inside(k["words"], t["words"]) | inside(t["words"], k["words"])))
    empty = F.array().cast("array<struct<term:string,words:array<string>>>")
    best = F.aggregate(known, empty, lambda kept, t: F.when((F.size(kept) >= shown) | clash(kept, t), kept).otherwise(F.concat(kept, F.array(t))))
    return F.transform(best, lambda k: k["term"])


def disjoint_ranges(ranges: Column) -> Column:
    """Ranges struct<begin,end> by begin; one that starts before the last kept one ends is left out."""
    ordered = F.array_sort(ranges)
    empty = F.slice(ordered, 1, 0)
    return F.aggregate(ordered, empty, lambda kept, r: F.when((F.size(kept) == 0) | (r["begin"] >= F.element_at(kept, -1)["end"]), F.concat(kept, F.array(r))).otherwise(kept))
