"""Pieces of DuckDB SQL that the queries' counterparts are made of."""

from __future__ import annotations


def num_cost(a: str, b: str) -> str:
    a, b = f"({a})::DOUBLE", f"({b})::DOUBLE"
    top = f"greatest(abs({a}), abs({b}))"
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0.5::DOUBLE WHEN {a} = {b} THEN 0::DOUBLE WHEN {a} <= 0 OR {b} <= 0 THEN CASE WHEN {top} = 0 THEN 0::DOUBLE ELSE least(abs({a} - {b}) / {top}, 1::DOUBLE) END ELSE least(abs(ln({a}) - ln({b})) / ln(100::DOUBLE), 1::DOUBLE) END"


def toks(s: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({s}), '[a-z0-9]+'))"


def jaccard(x: str, y: str) -> str:
    union = f"len(list_distinct(list_concat({x}, {y})))"
    return f"CASE WHEN {union} = 0 THEN 1::DOUBLE ELSE len(list_intersect({x}, {y}))::DOUBLE / {union} END"


def str_cost(a: str, b: str) -> str:
    a, b = f"coalesce({a}, '')", f"coalesce({b}, '')"
    return f"CASE WHEN {a} = {b} THEN 0::DOUBLE WHEN {a} = '' OR {b} = '' THEN 1::DOUBLE ELSE 1 - ({jaccard(toks(a), toks(b))}) END"


def list_cost(a: str, b: str) -> str:
    items = lambda x: f"list_distinct(list_transform({x}, lambda i: trim(lower(i))))"
    return f"(1 - ({jaccard(items(a), items(b))}))"


def sharpen(x: str, degree: int = 3) -> str:
    x = f"least(greatest({x}, 0::DOUBLE), 1::DOUBLE)"
    return {1: x, 3: f"({x} * {x} * (3 - 2 * {x}))", 5: f"({x} * {x} * {x} * ({x} * (6 * {x} - 15) + 10))"}[degree]
