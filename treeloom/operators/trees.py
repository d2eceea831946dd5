"""Trees out of JSON and markup, and the general tree edit distance."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pairs import adjacent, batched, column, spread
from .shaped import Subtrees, worker_subtrees


def json_leaves(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, path, value) of the top-level entries of JSON objects."""
    entries = F.explode(F.from_json(json_col, "map<string,string>")).alias("k", "value")
    return rows.select(id_col, entries).select(id_col, F.concat(F.lit("$."), "k").alias("path"), "value")


def tag_stats(rows: DataFrame, id_col: str, html_col: str) -> DataFrame:
    opened = F.regexp_extract_all(html_col, F.lit("<[a-z0-9]+"), F.lit(0))
    closed = F.regexp_extract_all(html_col, F.lit("</[a-z0-9]+"), F.lit(0))
    return rows.select(id_col, F.size(opened).cast("bigint").alias("opens"), F.size(closed).cast("bigint").alias("closes"), F.size(F.array_distinct(opened)).cast("bigint").alias("labels"))


VOID = {"br", "hr", "img", "input", "link", "meta"}
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*?(/?)>")


def postorder(html: str | None) -> tuple[list[str], list[int]]:
    """Labels in postorder, and of each node the place of its leftmost leaf. Unclosed tags close with their parent."""
    labels, left, stack = [], [], []  # stack: (label, first node below)

    def close() -> None:
        label, first = stack.pop()
        left.append(left[first] if first < len(labels) else len(labels))
        labels.append(label)

    for end, name, empty in TAG.findall(html or ""):
        name = name.lower()
        if end:
            if any(label == name for label, _ in stack):
                while stack[-1][0] != name:
                    close()
                close()
        else:
            stack.append((name, len(labels)))
            if empty or name in VOID:
                close()
    while stack:
        close()
    return labels, left


def tree_distance(a: tuple[list[str], list[int]], b: tuple[list[str], list[int]], relabel: np.ndarray | None = None) -> float:
    """Ordered tree edit distance at unit costs, by forests between key roots; a row of the table at a time.

    relabel: cost of turning a's node into b's; by default 0 for equal labels and 1 for others.
    """
    (la, ka), (lb, kb) = a, b
    if not la or not lb:
        return float(len(la) + len(lb))
    roots = [sorted({left: i for i, left in enumerate(k)}.values()) for k in (ka, kb)]
    if relabel is None:
        code = {x: i for i, x in enumerate(sorted({*la, *lb}))}
        relabel = np.array([code[x] for x in la])[:, None] != np.array([code[x] for x in lb])
    left_b = np.array(kb)
    tree = np.zeros((len(la), len(lb)))
    for i in roots[0]:
        for j in roots[1]:
            li, lj = ka[i], kb[j]
            cols = np.arange(lj, j + 1)
            steps = np.arange(len(cols) + 1, dtype=float)
            whole_b = left_b[cols] == lj
            f = np.zeros((i - li + 2, len(cols) + 1))
            f[0] = steps
            for x in range(li, i + 1):
                r = x - li + 1
                whole = whole_b & (ka[x] == li)
                swap = np.where(whole, f[r - 1, :-1] + relabel[x, cols], f[ka[x] - li, left_b[cols] - lj] + tree[x, cols])
                best = np.concatenate([[f[r - 1, 0] + 1], np.minimum(f[r - 1, 1:] + 1, swap)])
                f[r] = np.minimum.accumulate(best - steps) + steps  # insertions run along the row
                tree[x, cols[whole]] = f[r, 1:][whole]
    return float(tree[-1, -1])


def subtree_distance(a: tuple[list[str], list[int]], b: tuple[list[str], list[int]], known: Subtrees) -> float:
    """tree_distance; what it finds out of subtrees stays known."""
    (la, ka), (lb, kb) = a, b
    if not la or not lb or not known.fits(len(la) + len(lb)):
        return tree_distance(a, b)
    return known.distance(known.numbered(la, ka), ka, known.numbered(lb, kb), kb, lambda: np.array(la, dtype=object)[:, None] != np.array(lb, dtype=object))


def adjacent_page_distance(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(a_id, b_id, distance, similarity) of the tag trees of each page and the next. Pages meet as trees, each read once."""

    @F.arrow_udf("struct<labels:array<string>,left:array<int>>")
    def grown(html: pa.Array) -> pa.Array:
        both = [postorder(x) for x in html.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in both], pa.list_(pa.string())), pa.array([x for _, x in both], pa.list_(pa.int32()))], ["labels", "left"])

    def measured(t: pa.Table) -> dict:
        known, far, sizes = worker_subtrees("tags"), [], []
        read = lambda side: zip(*(column(t, side).field(k).to_pylist() for k in ("labels", "left")), strict=True)
        for x, y in zip(read("a"), read("b"), strict=True):
            far.append(subtree_distance(x, y, known))
            sizes.append(len(x[0]) + len(y[0]))
        return {"a_id": column(t, "a_id"), "b_id": column(t, "b_id"), "distance": far, "size": sizes}

    pairs = adjacent(pages.select(id_col, grown(html_col).alias("tree")), id_col, "tree")
    kind = pairs.schema["a_id"].dataType.simpleString()
    rows = batched(spread(pairs), measured, f"a_id {kind}, b_id {kind}, distance double, size long")
    return rows.select("a_id", "b_id", "distance", F.round(F.when(F.col("size") == 0, F.lit(1.0)).otherwise(1 - F.col("distance") / F.col("size")), 6).alias("similarity"))
