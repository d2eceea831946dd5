"""Costs of a pair of leaves, each a Column in [0, 1]. A missing number is NULL, a missing text is empty."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def numeric_cost(a: Column, b: Column) -> Column:
    """Log ratio over ln 100, at most 1; linear where a logarithm is undefined; 0.5 if either side is missing."""
    a, b = a.cast("double"), b.cast("double")
    largest = F.greatest(F.abs(a), F.abs(b))
    linear = F.when(largest == 0, F.lit(0.0)).otherwise(F.least(F.abs(a - b) / largest, F.lit(1.0)))
    ratio = F.least(F.abs(F.ln(a) - F.ln(b)) / F.lit(math.log(100.0)), F.lit(1.0))
    return F.when(a.isNull() | b.isNull(), F.lit(0.5)).when(a == b, F.lit(0.0)).when((a <= 0) | (b <= 0), linear).otherwise(ratio)


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def string_cost(a: Column, b: Column) -> Column:
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return F.when(a == b, F.lit(0.0)).when((a == "") | (b == ""), F.lit(1.0)).otherwise(1.0 - jaccard(tokens(a), tokens(b)))


def list_cost(a: Column, b: Column) -> Column:
    """One minus the Jaccard likeness of lower-cased, trimmed items; null items are skipped."""

    def items(x: Column) -> Column:
        return F.array_distinct(F.transform(F.filter(x, lambda i: i.isNotNull()), lambda i: F.trim(F.lower(i.cast("string")))))

    return 1.0 - jaccard(items(a), items(b))


def distribution_cost(a: Column, b: Column) -> Column:
    """Total variation of two percentage maps; an empty one is wholly different from another."""
    gaps = F.map_zip_with(a, b, lambda k, x, y: F.abs(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0))))
    ordered = F.transform(F.array_sort(F.map_entries(gaps)), lambda e: e["value"])  # a stable order of summation
    total = F.aggregate(ordered, F.lit(0.0), lambda s, x: s + x)
    na, nb = F.coalesce(F.size(a), F.lit(0)), F.coalesce(F.size(b), F.lit(0))
    return F.when((na <= 0) & (nb <= 0), F.lit(0.0)).when((na <= 0) | (nb <= 0), F.lit(1.0)).otherwise(F.least(total / 200.0, F.lit(1.0)))


def sharpen(x: Column, degree: int = 3) -> Column:
    """Smoothstep polynomials with fixed points 0, 0.5 and 1; degree 1 is linear."""
    x = clamp(x)
    if degree == 1:
        return x
    if degree == 3:
        return x * x * (F.lit(3.0) - x * 2.0)
    if degree == 5:
        return x * x * x * (x * (x * 6.0 - 15.0) + 10.0)
    raise ValueError(f"degree {degree} is none of 1, 3, 5")


def depth_factor(depth: Column) -> Column:
    return 1.0 / (depth + F.lit(1.0))


def relabel_cost(a: Column, b: Column) -> Column:
    """Equal labels cost nothing, numbers their relative gap, other labels 1."""
    x, y = a.try_cast("double"), b.try_cast("double")
    gap = F.least(F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(2.220446049250313e-16)), F.lit(1.0))
    return F.when(a == b, F.lit(0.0)).when(x.isNotNull() & y.isNotNull(), gap).otherwise(F.lit(1.0))


def value_cost(a: Column, b: Column, slack: float = 0.02, weight: float = 3.0) -> Column:
    """Gap of two normalised numbers beyond a slack, weighted; a missing side costs the whole weight."""
    return F.when(a.isNull() | b.isNull(), F.lit(weight)).otherwise(F.greatest(F.abs(a - b) - slack, F.lit(0.0)) * weight)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def label_threshold(a: Column, b: Column) -> Column:
    """Likeness that two labels need to count as one: a third of the longer may differ, at least one letter."""
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return 1.0 - F.greatest(F.lit(1), F.floor(longest / 3)) / longest


LEAF_COST = {"num": numeric_cost, "str": string_cost, "list": list_cost, "dist": distribution_cost}
