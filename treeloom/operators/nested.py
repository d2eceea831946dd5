"""Trees out of JSON or markup of any depth, in one pass a document, and the canonical tree of fixed shape.

A tree is an array of nodes in postorder (operators.weighted.NODE). A task parses a row's text and writes its nodes;
everything after that, pairing included, is Spark's. Null or unreadable text gives a null tree. JSON objects nest as
containers, arrays are one list leaf or, in the `items` form, containers of children named item; numbers and truth
values are numbers, null is the text None. Trees may be as deep as Python's JSON reader goes, some hundred levels.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import weighted as W
from .trees import TAG, VOID

SPACES = re.compile(r"\s+")
DASHES = str.maketrans({" ": " ", "​": "", "–": "-", "—": "-", "−": "-", "•": ", "})


def plain_text(text: str | None) -> str:
    """Special blanks and dashes made plain, one blank between words, letters without case."""
    return SPACES.sub(" ", (text or "").translate(DASHES)).strip().casefold()


@dataclass
class Tree:
    """A tree as parallel lists in postorder. left: place of the leftmost leaf below a node; parent: -1 at the root."""

    labels: list[str] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)
    numbers: list[float | None] = field(default_factory=list)
    texts: list[str | None] = field(default_factory=list)
    items: list[list | None] = field(default_factory=list)
    depths: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    weights: list[float] | None = field(default=None, compare=False)
    dists: list[dict | None] | None = field(default=None, compare=False)

    def add(self, label: str, kind: str, depth: int, first: int, number: float | None = None, text: str | None = None, items: list | None = None) -> None:
        """A node whose descendants are those from place first on."""
        self.left.append(self.left[first] if first < len(self.labels) else len(self.labels))
        self.labels.append(label), self.kinds.append(kind), self.depths.append(depth)
        self.numbers.append(number), self.texts.append(text), self.items.append(items)

    def __len__(self) -> int:
        return len(self.labels)

    def children(self) -> list[list[int]]:
        """Places of each node's children, in order."""
        out: list[list[int]] = []
        for i in range(len(self)):
            own, at = [], i - 1
            while at >= self.left[i]:
                own.append(at)
                at = self.left[at] - 1
            out.append(own[::-1])
        return out

    def sections(self, known: frozenset[str] | None = None) -> list[str | None]:
        """The nearest label at or above a node that is a known section; without known ones that of its ancestor at depth 1."""
        kids, out = self.children(), [None] * len(self)
        for i in range(len(self) - 1, -1, -1):  # parents come after their children
            here = (self.depths[i] == 1) if known is None else self.labels[i] in known
            out[i] = self.labels[i] if here else out[i]
            for k in kids[i]:
                out[k] = out[i]
        return out

    def preorder(self) -> list[int]:
        kids, out, stack = self.children(), [], [len(self) - 1] if len(self) else []
        while stack:
            out.append(i := stack.pop())
            stack += kids[i][::-1]
        return out

    def rows(self, weights: dict[str, float] | None = None) -> list[dict]:
        """As values of NODE."""
        weigh = (lambda label: 1.0) if weights is None else (lambda label: weights.get(label, 1.0))
        return [{"label": x, "kind": k, "num": n, "text": t, "items": it, "dist": None, "weight": weigh(x), "depth": d, "left": left} for x, k, n, t, it, d, left in zip(self.labels, self.kinds, self.numbers, self.texts, self.items, self.depths, self.left, strict=True)]

    @classmethod
    def of(cls, nodes) -> Tree:
        """From a column's value; a null one is an empty tree."""
        rows = W._nodes(nodes)
        pick = lambda k: [n[k] for n in rows]
        numbers = [None if x is None or x != x else float(x) for x in pick("num")]
        return cls(pick("label"), pick("kind"), numbers, pick("text"), [None if x is None else list(x) for x in pick("items")], pick("depth"), pick("left"))


_ENCODER = json.JSONEncoder(ensure_ascii=False)


def json_text(value: Any) -> str:
    return _ENCODER.encode(value)


def plain_value(value: Any) -> Any:
    """A JSON value as trees hold it: every number a double, null the text None."""
    if isinstance(value, dict):
        return {k: plain_value(v) for k, v in value.items()}
    if isinstance(value, list | str):
        return value
    return float(value) if isinstance(value, int | float) else str(value)


def read_json(text: str | None) -> Any:
    """The value, or None for null or unreadable text; then there is no tree."""
    if text is None:
        return None
    try:
        return json.loads(text.lstrip("﻿"))
    except (ValueError, RecursionError):
        return None


def _folded(entry: tuple[str, Any]) -> str:
    return entry[0].casefold()


_plain_short = lru_cache(1 << 14)(plain_text)


def read_plain(text: str | None) -> Any:
    """plain_value of read_json, None where that is None."""
    if text is not None and not PLAIN_NEEDED.search(text):
        try:
            return _FLOATS.decode(text)
        except (ValueError, RecursionError):
            pass
    value = read_json(text)
    return None if value is None else plain_value(value)


#: What plain_value turns to something else than a number read as a double: arrays keep theirs.
PLAIN_NEEDED = re.compile(r"\[|true|false|null")
_FLOATS = json.JSONDecoder(parse_int=float)


def grow(tree: Tree, value: Any, label: str, depth: int, items: bool = False) -> None:
    """Adds a value's nodes. items: arrays as containers, keys in order of their letters, texts and labels made comparable."""
    labels, kinds, numbers, texts, lists, depths, left = tree.labels, tree.kinds, tree.numbers, tree.texts, tree.items, tree.depths, tree.left

    def walk(value: Any, label: str, depth: int) -> None:
        first, number, text, listed = len(labels), None, None, None
        if isinstance(value, dict):
            kind = "dict"
            for k, v in sorted(value.items(), key=_folded) if items and len(value) > 1 else value.items():
                walk(v, k, depth + 1)
        elif isinstance(value, float) or (isinstance(value, int) and not (items and isinstance(value, bool))):
            kind, number = "num", float(value)
        elif isinstance(value, list):
            kind = "dict" if items else "list"
            for v in value if items else ():
                walk(v, "item", depth + 1)
            listed = None if items else [v if isinstance(v, str) else json_text(v) for v in value]
        elif items:
            kind, text = "str", value if isinstance(value, str) else "null" if value is None else str(value).lower()
            text = _plain_short(text) if len(text) < 100 else plain_text(text)
        else:
            kind, text = "str", str(value)
        left.append(left[first] if first < len(labels) else first)
        labels.append(label), kinds.append(kind), depths.append(depth)
        numbers.append(number), texts.append(text), lists.append(listed)

    walk(value, label, depth)


def json_tree(text: str | None, root: str = "root", items: bool = False) -> Tree | None:
    value = read_json(text)
    if value is None:
        return None
    tree = Tree()
    grow(tree, value, root, 0, items)
    return tree


def markup_tree(html: str | None) -> Tree | None:
    """The tags of markup under one root, with the text right inside a tag as its value. Unclosed tags close with their parent."""
    if html is None:
        return None
    tree, stack, at = Tree(), [("root", 0, [])], 0

    def close() -> None:
        label, first, said = stack.pop()
        text = SPACES.sub(" ", " ".join(said)).strip()
        tree.add(label, "dict" if first < len(tree) else "str", len(stack), first, text=text or None)

    for m in TAG.finditer(html):
        stack[-1][2].append(html[at : m.start()])
        at = m.end()
        end, name, empty = m.groups()
        name = name.lower()
        if not end:
            stack.append((name, len(tree), []))
            if empty or name in VOID:
                close()
        elif any(label == name for label, _, _ in stack[1:]):
            while stack[-1][0] != name:
                close()
            close()
    stack[-1][2].append(html[at:])
    while stack:
        close()
    return tree


READERS: dict[str, Callable[[str | None], Tree | None]] = {"json": json_tree, "items": lambda t: json_tree(t, items=True), "markup": markup_tree}


def trees(rows: DataFrame, id_col: str, text_col: str, form: str = "json", weights: dict[str, float] | None = None) -> DataFrame:
    """(id, tree) of JSON or markup texts. form: json, items or markup."""
    read = READERS[form]

    @F.arrow_udf(f"array<{W.NODE}>")
    def grown(texts: pa.Array) -> pa.Array:
        return node_column([read(t) for t in texts.to_pylist()], weights)

    return rows.select(F.col(id_col).alias("id"), grown(F.col(text_col)).alias("tree"))


#: array<NODE> as Arrow's.
_STRING, _DOUBLE, _INT = pa.string(), pa.float64(), pa.int32()
NODES = pa.list_(pa.field("element", pa.struct([("label", _STRING), ("kind", _STRING), ("num", _DOUBLE), ("text", _STRING), ("items", pa.list_(_STRING)), ("dist", pa.map_(_STRING, _DOUBLE)), ("weight", _DOUBLE), ("depth", _INT), ("left", _INT)])))


def node_column(made: list[Tree | None], weights: dict[str, float] | None = None) -> pa.Array:
    """Trees as a column of nodes (the inverse of read_nodes), field by field; None gives null."""
    weigh = {} if weights is None else weights
    held = [t for t in made if t is not None]
    flat = lambda name: [x for t in held for x in getattr(t, name)]
    labels = flat("labels")
    values = {"label": labels, "kind": flat("kinds"), "num": flat("numbers"), "text": flat("texts"), "items": flat("items"), "dist": [None] * len(labels), "weight": [weigh.get(x, 1.0) for x in labels], "depth": flat("depths"), "left": flat("left")}
    node = NODES.value_type
    nodes = pa.StructArray.from_arrays([pa.array(values[f.name], f.type) for f in node], fields=list(node))
    ends = pa.array(np.cumsum([0, *(0 if t is None else len(t) for t in made)]), pa.int32())
    return pa.ListArray.from_arrays(ends, nodes, type=NODES, mask=pa.array([t is None for t in made], pa.bool_()))


def read_nodes(column: pa.Array) -> list[Tree]:
    """Trees of a column of nodes, field by field; a null one is an empty tree."""
    nodes = column.flatten()
    get = lambda k: nodes.field(k).to_pylist()
    labels, kinds, texts, items, weights, depths, left = (get(k) for k in ("label", "kind", "text", "items", "weight", "depth", "left"))
    numbers = [None if x is None or x != x else x for x in get("num")]
    dists = get("dist") if nodes.field("dist").null_count < len(nodes) else [None] * len(nodes)
    out, at = [], 0
    for n in column.value_lengths().to_pylist():
        end = at + (n or 0)
        out.append(Tree(*(x[at:end] for x in (labels, kinds, numbers, texts, items, depths, left, weights, dists))))
        at = end
    return out


def read_texts(form: str = "json", weights: dict[str, float] | None = None) -> Callable[[pa.Array], list[Tree]]:
    """Reads trees out of a column of texts (see trees); a null or unreadable one is an empty tree."""
    read = READERS[form]
    weigh = {} if weights is None else weights

    def column_read(column: pa.Array) -> list[Tree]:
        out = []
        for text in column.to_pylist():
            t = read(text) or Tree()
            if text and "NaN" in text:
                t.numbers = [None if x is None or x != x else x for x in t.numbers]
            t.weights = [weigh.get(x, 1.0) for x in t.labels]
            out.append(t)
        return out

    return column_read


#: The canonical document's sections and leaves (label, kind, column of sources.documents.leaves), and the weights of labels.
CANONICAL = (
    ("area", (("total_km2", "num", "total_km2"), ("water_pct", "num", "water_pct"), ("rank", "num", "rank"))),
    ("codes", (("calling_code", "str", "calling_code"), ("internet_tld", "str", "internet_tld"), ("iso_3166_code", "str", "iso_3166_code"))),
    ("economy", (("currency_code", "str", "currency_code"), ("gdp_ppp", (("total_billion_usd", "num", "ppp_total"), ("per_capita_usd", "num", "ppp_per_capita"))), ("gdp_nominal", (("total_billion_usd", "num", "nominal_total"), ("per_capita_usd", "num", "nominal_per_capita"))), ("gini", "num", "gini"), ("hdi", "num", "hdi"))),
    ("general", (("capital", "str", "capital"), ("demonym", "str", "demonym"), ("official_language", "str", "official_language"), ("religion", "dist", "religion"), ("ethnic_groups", "dist", "ethnic_groups"))),
    ("government", (("type", "str", "type"), ("legislature", "str", "legislature"), ("lower_house", "str", "lower_house"), ("upper_house", "str", "upper_house"))),
    ("history", "str", "history"),
    ("population", (("total", "num", "population"), ("density_per_km2", "num", "density"))),
    ("time", (("timezone_utc", "str", "timezone_utc"), ("timezone_dst", "str", "timezone_dst"))),
)
WEIGHTS = {
    "gdp_ppp": 0.4, "gdp_nominal": 0.4, "total_billion_usd": 3.0, "per_capita_usd": 2.5, "gini": 2.0, "hdi": 2.0, "currency_code": 1.0,
    "total": 2.5, "density_per_km2": 1.5, "total_km2": 1.5, "water_pct": 0.5, "rank": 0.3,
    "religion": 1.5, "ethnic_groups": 1.5, "official_language": 1.5, "capital": 0.8, "demonym": 0.3,
    "type": 1.5, "legislature": 1.0, "lower_house": 0.8, "upper_house": 0.8, "history": 0.5,
    "calling_code": 0.2, "internet_tld": 0.2, "iso_3166_code": 0.1, "timezone_utc": 0.4, "timezone_dst": 0.2,
    "infobox": 0.1, "area": 0.3, "codes": 0.1, "economy": 0.3, "general": 0.3, "government": 0.3, "population": 0.3, "time": 0.1,
}


def canonical_trees(docs: DataFrame, name: str = "country", doc: str = "doc", weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(id, tree) of documents as leaf structs (sources.documents.leaves): 37 nodes each, made of Columns alone."""
    nodes: list[Column] = []

    def walk(label: str, below, depth: int) -> int:
        """Adds a node and what is below it; the place of its leftmost leaf."""
        weight = weights.get(label, 1.0)
        if isinstance(below, str):
            raise TypeError(f"{label} is a leaf")
        firsts = []
        for entry in below:
            if len(entry) == 3:
                leaf_label, kind, column = entry
                firsts.append(len(nodes))
                value = F.col(doc)[column]
                nodes.append(W.leaf(leaf_label, kind, F.nullif(value.cast("double"), F.lit(-1.0)) if kind == "num" else value, weights.get(leaf_label, 1.0), depth + 1, F.lit(len(nodes))))
            else:
                firsts.append(walk(entry[0], entry[1], depth + 1))
        nodes.append(W.container(F.lit(label), weight, depth, F.lit(firsts[0])))
        return firsts[0]

    walk("infobox", CANONICAL, 0)
    return docs.select(F.col(name).alias("id"), F.array(*nodes).alias("tree"))


def outline(tree: Tree) -> str:
    """A tree as indented lines: label, kind, value."""
    lines = []
    for i in tree.preorder():
        value = tree.numbers[i] if tree.kinds[i] == "num" else tree.items[i] if tree.kinds[i] == "list" else tree.texts[i]
        lines.append("  " * tree.depths[i] + f"{tree.labels[i]!r} ({tree.kinds[i]})" + ("" if tree.kinds[i] == "dict" else f" = {value!r}"))
    return "\n".join(lines)


def value_of(tree: Tree, i: int | None = None, kids: list[list[int]] | None = None) -> Any:
    """The JSON value of a node and what is below it. Containers of item children are arrays; keys that occur again gather in one."""
    i, kids = len(tree) - 1 if i is None else i, tree.children() if kids is None else kids
    kind = tree.kinds[i]
    if kind == "num":
        return tree.numbers[i]
    if kind == "list":
        return tree.items[i]
    if kind != "dict":
        return tree.texts[i]
    below = [(tree.labels[k], value_of(tree, k, kids)) for k in kids[i]]
    if below and all(label == "item" for label, _ in below):
        return [v for _, v in below]
    out: dict[str, Any] = {}
    again: set[str] = set()
    for label, v in below:
        if label not in out:
            out[label] = v
        else:
            out[label] = [*(out[label] if label in again else [out[label]]), v]
            again.add(label)
    return out


def infobox_lines(value: Any, indent: int = 0) -> Iterator[str]:
    """A JSON value as text, an indent a level."""
    pad = "  " * indent
    if isinstance(value, dict | list):
        for k, v in value.items() if isinstance(value, dict) else ((None, v) for v in value):
            nested, head = isinstance(v, dict | list), "-" if k is None else f"{k}:"
            yield pad + head if nested else f"{pad}{head} {v}"
            if nested:
                yield from infobox_lines(v, indent + 1)
    else:
        yield f"{pad}{value}"


RENDERED = {"json": lambda t: json_text(value_of(t)), "infobox": lambda t: "\n".join(infobox_lines(value_of(t))), "outline": outline}


def rendered(rows: DataFrame, form: str = "json") -> DataFrame:
    """(id, text) of (id, tree): json, infobox or outline; null for a null tree."""
    write = RENDERED[form]

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else write(Tree.of(t)) for t in column])

    return rows.select("id", text("tree").alias("text"))
