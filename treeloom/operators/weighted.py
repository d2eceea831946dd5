"""Weighted tree edit distance of documents of any shape, its edit script, and delete-all / insert-all bounds.

A tree is an array of nodes in postorder (see NODE). Deleting or inserting a node costs its weight; a node may only
turn into one of its label, at its weight times the sharpened cost of the two values, containers for nothing. Pairs
come from an equi-join, and one row holds one pair; the kernel below is what a task does for a row.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pairs import batched, by_shape, column
from .shaped import Forests, Values, groups

#: kind: dict (a container), num, str, list or dist; left: place of the leftmost leaf below the node; depth: the root's is 0
NODE = "struct<label:string,kind:string,num:double,text:string,items:array<string>,dist:map<string,double>,weight:double,depth:int,left:int>"
FREE, TOKEN = math.inf, re.compile("[a-z0-9]+")


def leaf(label: str, kind: str, value: Column, weight: float, depth: int, left: Column) -> Column:
    """One leaf as a NODE."""
    slot = {"num": "num", "str": "text", "list": "items", "dist": "dist"}[kind]
    values = {k: F.lit(None) for k in ("num", "text", "items", "dist")} | {slot: value}
    return F.struct(F.lit(label).alias("label"), F.lit(kind).alias("kind"), *[v.alias(k) for k, v in values.items()], F.lit(weight).alias("weight"), F.lit(depth).alias("depth"), left.cast("int").alias("left")).cast(NODE)


def container(label: Column, weight: float, depth: int, left: Column) -> Column:
    return F.struct(label.alias("label"), F.lit("dict").alias("kind"), *[F.lit(None).alias(k) for k in ("num", "text", "items", "dist")], F.lit(weight).alias("weight"), F.lit(depth).alias("depth"), left.cast("int").alias("left")).cast(NODE)


@dataclass(frozen=True)
class Rules:
    sharpness: int = 3
    depth_factor: bool = False

    def sharpen(self, x: float) -> float:
        x = min(max(x, 0.0), 1.0)
        return {1: x, 3: x * x * (3 - 2 * x), 5: x * x * x * (x * (6 * x - 15) + 10)}[self.sharpness]


def _overlap(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def value_cost(a: dict, b: dict) -> float:
    """Cost in [0, 1] of two leaves of one kind; as the Columns of functions.costs."""
    kind = a["kind"]
    if kind == "num":
        x, y = a["num"], b["num"]
        if x is None or y is None:
            return 0.5
        if x == y:
            return 0.0
        if x <= 0 or y <= 0:
            return min(abs(x - y) / max(abs(x), abs(y)), 1.0)
        return min(abs(math.log(x) - math.log(y)) / math.log(100.0), 1.0)
    if kind == "str":
        x, y = a["text"] or "", b["text"] or ""
        if x == y or not (x and y):
            return float(x != y)
        return 1 - _overlap(set(TOKEN.findall(x.lower())), set(TOKEN.findall(y.lower())))
    if kind == "list":
        return 1 - _overlap(*({i.lower().strip() for i in n["items"] if i is not None} if n["items"] is not None else set() for n in (a, b)))
    if kind == "dist":
        x, y = dict(a["dist"] or {}), dict(b["dist"] or {})
        if not (x and y):
            return float(bool(x) != bool(y))
        return min(sum(abs(x.get(k, 0.0) - y.get(k, 0.0)) for k in sorted({*x, *y})) / 200.0, 1.0)
    return 1.0


def update_cost(a: dict, b: dict, rules: Rules) -> float:
    if a["label"] != b["label"]:
        return FREE
    if a["kind"] != b["kind"]:
        return a["weight"]
    if a["kind"] == "dict":
        return 0.0
    cost = rules.sharpen(value_cost(a, b)) * a["weight"]
    return cost / (1 + a["depth"]) if rules.depth_factor else cost


class Mapping:
    """Cheapest mapping of two postorder trees, by forests between key roots; a row of the table at a time."""

    def __init__(self, a: list[dict], b: list[dict], rules: Rules):
        self.a, self.b, self.la, self.lb = a, b, [n["left"] for n in a], [n["left"] for n in b]
        self.out, self.new = (np.array([n["weight"] for n in t], dtype=float) for t in (a, b))
        at = {}
        for j, n in enumerate(b):
            at.setdefault(n["label"], []).append(j)
        self.swap = np.full((len(a), len(b)), FREE)
        for i, n in enumerate(a):
            for j in at.get(n["label"], ()):
                self.swap[i, j] = update_cost(n, b[j], rules)
        self.tree = np.zeros((len(a), len(b)))
        roots = [sorted({left: i for i, left in enumerate(k)}.values()) for k in (self.la, self.lb)]
        for i in roots[0]:
            for j in roots[1]:
                self.forest(i, j, keep=True)

    def forest(self, i: int, j: int, keep: bool = False) -> np.ndarray:
        """Distances of the forests that start at the leftmost leaves of i and j; keep: enter those of whole trees."""
        li, lj = self.la[i], self.lb[j]
        cols = np.arange(lj, j + 1)
        left_b = np.array(self.lb)[cols]
        steps = np.concatenate([[0.0], np.cumsum(self.new[cols])])
        f = np.zeros((i - li + 2, len(cols) + 1))
        f[0] = steps
        for x in range(li, i + 1):
            r = x - li + 1
            whole = (left_b == lj) & (self.la[x] == li)
            other = f[self.la[x] - li, left_b - lj] + self.tree[x, cols]
            swap = np.where(whole, f[r - 1, :-1] + self.swap[x, cols], other)
            best = np.concatenate([[f[r - 1, 0] + self.out[x]], np.minimum(f[r - 1, 1:] + self.out[x], swap)])
            f[r] = np.minimum.accumulate(best - steps) + steps  # insertions run along the row
            if keep:
                self.tree[x, cols[whole]] = f[r, 1:][whole]
        return f

    def distance(self) -> float:
        return float(self.tree[-1, -1]) if self.a and self.b else float(self.out.sum() + self.new.sum())

    def script(self) -> list[tuple]:
        """(op, label, from, to, cost) of every node, in postorder of the trees; costs add up to the distance."""
        ops, todo = [], [(len(self.a) - 1, len(self.b) - 1)] if self.a and self.b else []
        if not todo:
            return [("delete", n["label"], i, None, n["weight"]) for i, n in enumerate(self.a)] + [("insert", n["label"], None, j, n["weight"]) for j, n in enumerate(self.b)]
        while todo:
            i, j = todo.pop()
            li, lj, f = self.la[i], self.lb[j], self.forest(i, j)
            x, y = i, j
            while x >= li or y >= lj:
                r, c = x - li + 1, y - lj + 1
                if r and math.isclose(f[r, c], f[r - 1, c] + self.out[x], abs_tol=1e-9):
                    ops.append(("delete", self.a[x]["label"], x, None, float(self.out[x])))
                    x -= 1
                elif c and math.isclose(f[r, c], f[r, c - 1] + self.new[y], abs_tol=1e-9):
                    ops.append(("insert", self.b[y]["label"], None, y, float(self.new[y])))
                    y -= 1
                elif self.la[x] == li and self.lb[y] == lj:
                    cost = float(self.swap[x, y])
                    ops.append(("update" if cost > 0 else "match", self.a[x]["label"], x, y, cost))
                    x, y = x - 1, y - 1
                else:
                    todo.append((x, y))
                    x, y = self.la[x] - 1, self.lb[y] - 1
        return ops[::-1]


def _nodes(x) -> list[dict]:
    return [n if isinstance(n, dict) else n.asDict() for n in x] if x is not None else []


def gaps(va: Values, i: int, vb: Values, j: int, kind: str) -> np.ndarray:
    """value_cost of two nodes of one kind, for all pairs."""
    if kind == "num":
        x, y = va.numbers(i), vb.numbers(j)
        with np.errstate(divide="ignore", invalid="ignore"):
            cost = np.minimum(np.abs(np.log(x) - np.log(y)) / math.log(100.0), 1.0)
            linear = np.minimum(np.abs(x - y) / np.maximum(np.abs(x), np.abs(y)), 1.0)
        cost = np.where(x == y, 0.0, np.where((x <= 0) | (y <= 0), linear, cost))
        return np.where(np.isnan(x) | np.isnan(y), 0.5, cost)
    held = {"str": _text, "list": _items, "dist": _dist}[kind]
    x, y = va.coded(i, held), vb.coded(j, held)
    _, first, back = np.unique(x * np.int64(len(va.codes)) + y, return_index=True, return_inverse=True)
    slot = {"str": "text", "list": "items", "dist": "dist"}[kind]
    node = lambda v, row, at: {"kind": kind, slot: {"str": v.trees[row].texts, "list": v.trees[row].items, "dist": v.trees[row].dists or {at: None}}[kind][at]}
    return np.array([value_cost(node(va, r, i), node(vb, r, j)) for r in first])[back]


def _text(t, i: int):
    return "str", t.texts[i]


def _items(t, i: int):
    return "list", None if t.items[i] is None else tuple(t.items[i])


def _dist(t, i: int):
    return "dist", tuple(sorted(dict(t.dists[i] or {}).items())) if t.dists else ()


def swaps(a: list, b: list, rules: Rules) -> dict[tuple[int, int], np.ndarray | float]:
    """update_cost of every two nodes of one label, for pairs of trees of the same two shapes."""
    codes: dict = {}
    va, vb, s, t, out = Values(a, codes), Values(b, codes), a[0], b[0], {}
    at: dict[str, list[int]] = {}
    for j, label in enumerate(t.labels):
        at.setdefault(label, []).append(j)
    for i, label in enumerate(s.labels):
        for j in at.get(label, ()):
            kind, weight = s.kinds[i], s.weights[i]
            if kind != t.kinds[j]:
                out[i, j] = weight
            elif kind == "dict":
                out[i, j] = 0.0
            elif kind in ("num", "str", "list", "dist"):
                x = gaps(va, i, vb, j, kind)
                cost = np.clip(x, 0.0, 1.0)
                cost = {1: cost, 3: cost * cost * (3 - 2 * cost), 5: cost * cost * cost * (cost * (6 * cost - 15) + 10)}[rules.sharpness] * weight
                out[i, j] = cost / (1 + s.depths[i]) if rules.depth_factor else cost
            else:
                out[i, j] = update_cost({"label": label, "kind": kind, "weight": weight, "depth": s.depths[i]}, {"label": label, "kind": kind}, rules)
    return out


def _mapped(a: list, b: list, rules: Rules, keep: bool = False) -> Forests:
    s, t = a[0], b[0]
    return Forests(s.left, t.left, s.weights, t.weights, swaps(a, b, rules), len(a), keep)


def _readers(read):
    from .nested import read_nodes  # it builds on this module

    return read or read_nodes


def distances(pairs: DataFrame, rules: Rules = Rules(), read=None) -> DataFrame:
    """(a_id, b_id, distance, size_a, size_b, bound) of pairs (a_id, a, b_id, b) of trees. A null tree is an empty one.

    read: what makes trees of a and b, if they are none yet (nested.read_texts).
    """
    read = _readers(read)

    def run(t: pa.Table) -> dict:
        a, b = read(column(t, "a")), read(column(t, "b"))
        far = np.empty(len(a))
        for rows in groups(a, b):
            far[rows] = _mapped([a[r] for r in rows], [b[r] for r in rows], rules).distance()
        bound = [sum(x.weights) + sum(y.weights) for x, y in zip(a, b, strict=True)]
        return {"a_id": column(t, "a_id"), "b_id": column(t, "b_id"), "distance": far, "size_a": [len(x) for x in a], "size_b": [len(x) for x in b], "bound": np.array(bound, dtype=float)}

    return batched(by_shape(pairs), run, f"{_ids(pairs)}, distance double, size_a long, size_b long, bound double")


def _ids(pairs: DataFrame) -> str:
    return ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in ("a_id", "b_id"))


def _close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """As math.isclose with abs_tol=1e-9."""
    return np.abs(x - y) <= np.maximum(1e-9 * np.maximum(np.abs(x), np.abs(y)), 1e-9)


def _traces(a: list, b: list, rules: Rules) -> list[list[tuple]]:
    """Mapping.script of each pair, of trees of the same two shapes."""
    s, t = a[0], b[0]
    if not (len(s) and len(t)):
        return [[("delete", x, i, None, w) for i, (x, w) in enumerate(zip(s.labels, s.weights, strict=True))] + [("insert", x, None, j, w) for j, (x, w) in enumerate(zip(t.labels, t.weights, strict=True))]] * len(a)
    m = _mapped(a, b, rules, keep=True)
    la, lb, choices = s.left, t.left, {}
    for (li, lj), f in m.tables.items():
        n, k = f.shape[0] - 1, f.shape[1] - 1
        choice = np.full(f.shape, 2, np.uint8)  # 0: delete, 1: insert, 2: neither
        choice[:, 1:][_close(f[:, 1:], f[:, :-1] + np.array(t.weights[lj : lj + k])[None, :, None])] = 1
        choice[1:][_close(f[1:], f[:-1] + np.array(s.weights[li : li + n])[:, None, None])] = 0
        choices[li, lj] = choice
    out = []
    for row in range(len(a)):
        ops, todo, own = [], [(len(s) - 1, len(t) - 1)], {}
        while todo:
            x, y = todo.pop()
            li, lj = la[x], lb[y]
            if (li, lj) not in own:
                own[li, lj] = choices[li, lj][:, :, row].tolist()
            choice = own[li, lj]
            while x >= li or y >= lj:
                step = choice[x - li + 1][y - lj + 1]
                if step == 0:
                    ops.append(("delete", s.labels[x], x, None, s.weights[x]))
                    x -= 1
                elif step == 1:
                    ops.append(("insert", t.labels[y], None, y, t.weights[y]))
                    y -= 1
                elif la[x] == li and lb[y] == lj:
                    swap = m.swap[x, y]
                    cost = float(swap if isinstance(swap, float) else swap[row])
                    ops.append(("update" if cost > 0 else "match", s.labels[x], x, y, cost))
                    x, y = x - 1, y - 1
                else:
                    todo.append((x, y))
                    x, y = la[x] - 1, lb[y] - 1
        out.append(ops[::-1])
    return out


def scripts(pairs: DataFrame, rules: Rules = Rules(), read=None) -> DataFrame:
    """(a_id, b_id, seq, op, label, from, to, cost): what each node of either tree becomes."""
    read = _readers(read)

    def run(t: pa.Table) -> dict:
        a, b = read(column(t, "a")), read(column(t, "b"))
        at: list[np.ndarray] = []
        seq, ops = [], []
        for rows in groups(a, b):
            for row, made in zip(rows.tolist(), _traces([a[r] for r in rows], [b[r] for r in rows], rules), strict=True):
                at.append(np.full(len(made), row))
                seq += range(len(made))
                ops += made
        take = pa.array(np.concatenate(at) if at else np.zeros(0, int))
        return {"a_id": column(t, "a_id").take(take), "b_id": column(t, "b_id").take(take), "seq": seq} | {k: [o[n] for o in ops] for n, k in enumerate(("op", "label", "from", "to", "cost"))}

    return batched(by_shape(pairs), run, f"{_ids(pairs)}, seq long, op string, label string, from int, to int, cost double")
