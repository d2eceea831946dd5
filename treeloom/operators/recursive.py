"""Recursive tree edit distance over ordered children: relabelling, whole subtrees deleted or inserted, its script, paths,
patch ids, and replay.

Two nodes are compared by aligning their child lists; a subtree that is contained in the other tree moves at a small
fixed cost instead of one for each of its nodes. Costs are a setting: EARLY counts labels as equal or not and every
node 1; LATER compares labels by edit distance, weighs numbers beyond a tolerance, and lessens the cost with depth.

Pairs (a_id, a, b_id, b) of trees come from Spark joins; one row is one pair.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from . import weighted as W
from .nested import Tree, plain_text, read_nodes
from .pairs import batched, by_shape, column, spread
from .shaped import Values, groups

#: Labels that start a section of their own.
SECTIONS = frozenset({"General", "Government", "Area", "Population", "Economy", "Demographics", "Administrative details"})


@dataclass(frozen=True)
class Costs:
    """Fixed defaults: those of LATER."""

    node: float = 2.0  # deleting or inserting one node
    moved: float = 0.25  # a subtree that the other tree contains
    fuzzy: bool = True  # labels by edit distance
    mismatch: float = 3.0  # factor of labels too different to be one
    section: float = 2.0  # factor of labels of different sections
    by_depth: bool = True
    tolerance: float = 0.02
    number: float = 3.0
    quadratic: bool = False
    text: float = 0.0
    sections: frozenset[str] | None = SECTIONS


LATER = Costs()
EARLY = Costs(node=1.0, moved=1.0, fuzzy=False, mismatch=1.0, section=1.0, by_depth=False, tolerance=0.0, number=1.0, text=1.0)


def letters_apart(a: str, b: str) -> int:
    """Levenshtein distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


plain_label = lru_cache(1 << 14)(plain_text)


class Side:
    """One tree with what the kernel asks of it again and again."""

    def __init__(self, tree: Tree, costs: Costs):
        self.tree, self.kids = tree, tree.children()
        self.labels, self.texts = [plain_label(x) for x in tree.labels], [None if x is None else plain_text(x) for x in tree.texts]
        self.size = [i - left + 1 for i, left in enumerate(tree.left)]
        self.section = tree.sections(costs.sections)
        self.place = [0] * len(tree)  # among its siblings, from 1
        self.parent = [-1] * len(tree)
        for i, own in enumerate(self.kids):
            for n, k in enumerate(own, 1):
                self.place[k], self.parent[k] = n, i
        self.uid = [""] * len(tree)
        for n, i in enumerate(tree.preorder(), 1):
            self.uid[i] = f"n{n:06d}"

    def path(self, i: int) -> str:
        steps = []
        while self.parent[i] >= 0:
            steps.append(f"{self.tree.labels[i]}[{self.place[i]}]")
            i = self.parent[i]
        return "/".join(["root", *reversed(steps)])

    def subtree(self, i: int) -> list[dict]:
        """The nodes of a subtree as a tree of its own."""
        first = self.tree.left[i]
        rows = [dict(r) for r in Tree(*(getattr(self.tree, f)[first : i + 1] for f in ("labels", "kinds", "numbers", "texts", "items", "depths", "left"))).rows()]
        for r in rows:
            r["left"] -= first
        return rows


class Alignment:
    def __init__(self, a: Tree, b: Tree, costs: Costs):
        self.costs, self.a, self.b = costs, Side(a, costs), Side(b, costs)
        self.known: dict[tuple[int, int], float] = {}
        self.tables: dict[tuple[int, int], list[list[float]]] = {}
        self.label_costs: dict[tuple[str, str], tuple[float, bool]] = {}
        self.inside: dict[tuple[bool, int, int], bool] = {}
        self.within: dict[tuple[bool, int, int], bool] = {}

    def label_gap(self, x: str, y: str) -> tuple[float, bool]:
        """One minus the likeness of two labels, and whether they count as one."""
        got = self.label_costs.get((x, y))
        if got is None:
            if self.costs.fuzzy:
                longest = max(len(x), len(y))
                gap = letters_apart(x, y) / longest if longest else 0.0
                got = gap, 1 - gap >= 1 - max(1, max(longest, 1) // 3) / max(longest, 1)
            else:
                got = float(x != y), x == y
            self.label_costs[x, y] = got
        return got

    def same(self, p: Side, i: int, t: Side, j: int) -> bool:
        x, y = (p, t) if p is self.a else (t, p)
        at = (i, j) if p is self.a else (j, i)
        if not self.label_gap(x.labels[at[0]], y.labels[at[1]])[1]:
            return False
        m, n = p.tree.numbers[i], t.tree.numbers[j]
        if p.tree.kinds[i] == t.tree.kinds[j] == "num":
            return m is not None and n is not None and math.isclose(m, n, abs_tol=1e-12)
        return self.value(p, i) == self.value(t, j)

    @staticmethod
    def value(s: Side, i: int) -> str:
        kind = s.tree.kinds[i]
        return f"{s.tree.numbers[i]:.12f}" if kind == "num" and s.tree.numbers[i] is not None else s.texts[i] or ""

    def contained(self, p: Side, i: int, t: Side, j: int) -> bool:
        """Whether a subtree's nodes are below t's node j in the same order: each child in the first fitting one after the last."""
        key = (p is self.a, i, j)
        got = self.inside.get(key)
        if got is None:
            got = self.same(p, i, t, j)
            if got:
                rest = iter(t.kids[j])
                got = all(any(self.contained(p, k, t, at) for at in rest) for k in p.kids[i])
            self.inside[key] = got
        return got

    def anywhere(self, p: Side, i: int, t: Side, j: int) -> bool:
        """Whether it is contained at j or at any node below."""
        key = (p is self.a, i, j)
        got = self.within.get(key)
        if got is None:
            got = self.within[key] = any(self.contained(p, i, t, at) for at in range(j, t.tree.left[j] - 1, -1) if t.size[at] >= p.size[i])
        return got

    def whole(self, p: Side, i: int, t: Side, j: int) -> float:
        """Cost of deleting or inserting a subtree next to the other tree's node j."""
        return self.costs.moved if self.anywhere(p, i, t, j) else self.costs.node * p.size[i]

    def relabel(self, i: int, j: int) -> float:
        a, b, c = self.a, self.b, self.costs
        gap, one = self.label_gap(a.labels[i], b.labels[j])
        if not one:
            gap *= c.mismatch
        if a.section[i] != b.section[j]:
            gap *= c.section
        if c.by_depth:
            gap /= 1 + a.tree.depths[i]
        return gap + self.value_gap(i, j)

    def value_gap(self, i: int, j: int) -> float:
        a, b, c = self.a, self.b, self.costs
        if a.kids[i] or b.kids[j]:
            return 0.0
        x, y = a.tree.kinds[i], b.tree.kinds[j]
        if x == y == "num":
            m, n = a.tree.numbers[i], b.tree.numbers[j]
            if m is None or n is None:
                return c.number
            gap = max(0.0, abs(m - n) - c.tolerance)
            return (gap * gap if c.quadratic else gap) * c.number
        if x == y and a.texts[i] == b.texts[j]:
            return 0.0
        return c.text

    def distance(self, i: int, j: int) -> float:
        got = self.known.get((i, j))
        if got is None:
            got = self.known[i, j] = self.table(i, j)[-1][-1]
        return got

    def table(self, i: int, j: int) -> list[list[float]]:
        """Costs of aligning the first children of i with the first ones of j."""
        got = self.tables.get((i, j))
        if got is not None:
            return got
        a, b = self.a, self.b
        out = [self.whole(a, k, b, j) for k in a.kids[i]]
        new = [self.whole(b, k, a, i) for k in b.kids[j]]
        row = [self.relabel(i, j)]
        for n in new:
            row.append(row[-1] + n)
        t = [row]
        for k, o in zip(a.kids[i], out, strict=True):
            above, row = row, [row[0] + o]
            for y, (m, n) in enumerate(zip(b.kids[j], new, strict=True)):
                row.append(min(above[y] + self.distance(k, m), above[y + 1] + o, row[y] + n))
            t.append(row)
        self.tables[i, j] = t
        return t

    @cached_property
    def total(self) -> float:
        if not (self.a.size and self.b.size):
            return self.costs.node * (len(self.a.size) + len(self.b.size))
        return self.distance(len(self.a.size) - 1, len(self.b.size) - 1)

    @property
    def similarity(self) -> float:
        most = self.costs.node * (len(self.a.size) + len(self.b.size))
        return max(0.0, 1 - self.total / most) if most else 1.0

    def content(self, s: Side, i: int) -> tuple:
        t = s.tree
        return t.labels[i], t.kinds[i], t.numbers[i], t.texts[i], t.items[i]

    def script(self, complete: bool = False) -> list[tuple]:
        """(op, path, at, cost, uid, nodes) in order: a node's own change before those of its children, left to right.

        complete: also changes that cost nothing, such as those between a leaf and a container, so that a replay gives
        the very tree and not one at distance zero.
        """
        if not (self.a.size and self.b.size):
            raise ValueError("a script needs two trees")
        ops: list[tuple] = []
        close = lambda x, y: math.isclose(x, y, abs_tol=1e-9)
        todo: list = [(len(self.a.size) - 1, len(self.b.size) - 1)]
        while todo:
            step = todo.pop()
            if len(step) > 2:
                ops.append(step)
                continue
            i, j = step
            a, b, t = self.a, self.b, self.table(i, j)
            cost = t[0][0]
            if cost > 0 or (complete and self.content(a, i) != self.content(b, j)):
                same = self.label_gap(a.labels[i], b.labels[j])[1]
                node = self.b.tree.rows()[j] | {"left": 0}
                ops.append(("update_value" if same else "update_node", a.path(i), None, cost, a.uid[i], [node]))
            x, y = len(a.kids[i]), len(b.kids[j])
            # found from the last child back, so that the stack hands them out from the first on
            while x or y:
                if x and y and close(t[x][y], t[x - 1][y - 1] + self.distance(a.kids[i][x - 1], b.kids[j][y - 1])):
                    x, y = x - 1, y - 1
                    todo.append((a.kids[i][x], b.kids[j][y]))
                elif x and close(t[x][y], t[x - 1][y] + (gone := self.whole(a, a.kids[i][x - 1], b, j))):
                    x -= 1
                    k = a.kids[i][x]
                    todo.append(("delete_tree", a.path(k), None, gone, a.uid[k], a.subtree(k)))
                else:
                    y -= 1
                    k = b.kids[j][y]
                    todo.append(("insert_tree", a.path(i), y + 1, self.whole(b, k, a, i), a.uid[i], b.subtree(k)))
        return ops


def _entry(x, rows: np.ndarray):
    return x[rows] if isinstance(x, np.ndarray) and x.ndim else x


def _close(x, y, tolerance: float):
    """As math.isclose with an abs_tol."""
    with np.errstate(invalid="ignore"):
        return (x == y) | (np.abs(x - y) <= np.maximum(1e-9 * np.maximum(np.abs(x), np.abs(y)), tolerance))


def _said(t: Tree, i: int) -> tuple:
    return "said", t.texts[i]


def _plain(t: Tree, i: int) -> tuple:
    return "plain", None if t.texts[i] is None else plain_text(t.texts[i])


def _value(t: Tree, i: int) -> tuple:
    x = t.numbers[i] if t.kinds[i] == "num" else None
    return "value", f"{x:.12f}" if x is not None else plain_text(t.texts[i] or "")


def _listed(t: Tree, i: int) -> tuple:
    return "listed", None if t.items[i] is None else tuple(t.items[i])


class Group(Alignment):
    """Alignments of many pairs of trees of the same two shapes: costs that values decide are vectors, one entry a pair, others numbers."""

    def __init__(self, a: list[Tree], b: list[Tree], costs: Costs):
        super().__init__(a[0], b[0], costs)
        codes: dict = {}
        self.pairs, self.values = (a, b), {True: Values(a, codes), False: Values(b, codes)}

    def of(self, s: Side) -> Values:
        return self.values[s is self.a]

    def empty(self, s: Side, i: int) -> bool:
        """Whether no pair has a text there."""
        v = self.of(s)
        return v.made(("empty", i), lambda: all(t.texts[i] is None for t in v.trees))

    def same(self, p: Side, i: int, t: Side, j: int):
        x, y = ((p, i), (t, j)) if p is self.a else ((t, j), (p, i))
        if not self.label_gap(x[0].labels[x[1]], y[0].labels[y[1]])[1]:
            return False
        kinds = p.tree.kinds[i], t.tree.kinds[j]
        if kinds == ("num", "num"):
            return _close(self.of(p).numbers(i), self.of(t).numbers(j), 1e-12)
        if "num" not in kinds and self.empty(p, i) and self.empty(t, j):
            return True
        return self.of(p).coded(i, _value) == self.of(t).coded(j, _value)

    def contained(self, p: Side, i: int, t: Side, j: int):
        key = (p is self.a, i, j)
        got = self.inside.get(key)
        if got is None:
            got, first = self.same(p, i, t, j), 0  # first: the place of the first child that is left, of each pair
            for k in p.kids[i] if got is not False else ():
                found, after = False, first
                for n, at in enumerate(t.kids[j]):
                    here = self.contained(p, k, t, at)
                    if here is not False:
                        here = np.logical_and(np.logical_and(here, np.less_equal(first, n)), np.logical_not(found))
                        found, after = np.logical_or(found, here), np.where(here, n + 1, after)
                got, first = (False if found is False else np.logical_and(got, found)), after
                if got is False:
                    break
            self.inside[key] = got
        return got

    def anywhere(self, p: Side, i: int, t: Side, j: int):
        key = (p is self.a, i, j)
        got = self.within.get(key)
        if got is None:
            got = False
            for at in range(j, t.tree.left[j] - 1, -1):
                if t.size[at] >= p.size[i] and (here := self.contained(p, i, t, at)) is not False:
                    got = np.logical_or(got, here)
            self.within[key] = got
        return got

    def whole(self, p: Side, i: int, t: Side, j: int):
        every = self.costs.node * p.size[i]
        there = self.anywhere(p, i, t, j)
        return every if there is False else np.where(there, self.costs.moved, every)

    def value_gap(self, i: int, j: int):
        a, b, c = self.a, self.b, self.costs
        if a.kids[i] or b.kids[j]:
            return 0.0
        x, y = a.tree.kinds[i], b.tree.kinds[j]
        if x == y == "num":
            with np.errstate(invalid="ignore"):
                gap = np.maximum(0.0, np.abs(self.of(a).numbers(i) - self.of(b).numbers(j)) - c.tolerance)
            return np.where(np.isnan(gap), c.number, (gap * gap if c.quadratic else gap) * c.number)
        if x != y or not c.text:
            return c.text
        return np.where(self.of(a).coded(i, _plain) == self.of(b).coded(j, _plain), 0.0, c.text)

    def table(self, i: int, j: int) -> list[list]:
        got = self.tables.get((i, j))
        if got is not None:
            return got
        a, b = self.a, self.b
        out = [self.whole(a, k, b, j) for k in a.kids[i]]
        new = [self.whole(b, k, a, i) for k in b.kids[j]]
        row = [self.relabel(i, j)]
        for n in new:
            row.append(row[-1] + n)
        t = [row]
        for k, o in zip(a.kids[i], out, strict=True):
            above, row = row, [row[0] + o]
            for y, (m, n) in enumerate(zip(b.kids[j], new, strict=True)):
                row.append(np.minimum(np.minimum(above[y] + self.distance(k, m), above[y + 1] + o), row[y] + n))
            t.append(row)
        self.tables[i, j] = t
        return t

    @property
    def similarity(self):
        most = self.costs.node * (len(self.a.size) + len(self.b.size))
        return np.maximum(0.0, 1 - self.total / most) if most else 1.0

    def differ(self, p: Side, i: int, t: Side, j: int):
        """Whether the contents of two nodes differ."""
        if (p.tree.labels[i], p.tree.kinds[i]) != (t.tree.labels[j], t.tree.kinds[j]):
            return True
        x, y = self.of(p), self.of(t)
        if p.tree.kinds[i] == "num":
            m, n = x.numbers(i), y.numbers(j)
            out = (m != n) & ~(np.isnan(m) & np.isnan(n))
        else:
            out = False
        for of in (_said, _listed):
            if of is _said and self.empty(p, i) and self.empty(t, j):
                continue
            if of is _listed and p.tree.kinds[i] != "list":
                continue
            out = out | (x.coded(i, of) != y.coded(j, of))
        return out

    def traces(self, complete: bool = False) -> list[tuple[np.ndarray, list[tuple]]]:
        """(rows, operations): the script of all pairs, those together whose scripts differ in values alone.

        An operation is (op, path, at, cost, uid, side, node): what it brings or takes is at or below that node of a or b.
        """
        if not (self.a.size and self.b.size):
            raise ValueError("a script needs two trees")
        a, b, out = self.a, self.b, []
        states: list[tuple] = [(np.arange(len(self.pairs[0])), [("node", len(a.size) - 1, len(b.size) - 1)], [])]

        def parted(rows: np.ndarray, yes) -> tuple[np.ndarray, np.ndarray]:
            """rows for which it holds and the others."""
            yes = np.broadcast_to(_entry(np.asarray(yes), rows), len(rows))
            return rows[yes], rows[~yes]

        while states:
            rows, todo, ops = states.pop()
            while todo and len(rows):
                kind, *step = todo.pop()
                if kind == "op":
                    ops.append(tuple(step))
                elif kind == "node":
                    i, j = step
                    cost = self.table(i, j)[0][0]
                    changed = np.greater(cost, 0) | self.differ(a, i, b, j) if complete else np.greater(cost, 0)
                    rows, others = parted(rows, changed)
                    children = ("align", i, j, len(a.kids[i]), len(b.kids[j]))
                    if len(others):
                        states.append((others, [*todo, children], [*ops]))
                    same = self.label_gap(a.labels[i], b.labels[j])[1]
                    ops.append(("update_value" if same else "update_node", a.path(i), None, cost, a.uid[i], "b", j))
                    todo.append(children)
                else:
                    i, j, x, y = step
                    if not (x or y):
                        continue
                    t = self.table(i, j)
                    if x and y:
                        k, m = a.kids[i][x - 1], b.kids[j][y - 1]
                        both, rows = parted(rows, _close(t[x][y], t[x - 1][y - 1] + self.distance(k, m), 1e-9))
                        if len(both):
                            states.append((both, [*todo, ("node", k, m), ("align", i, j, x - 1, y - 1)], [*ops]))
                    if x and len(rows):
                        k = a.kids[i][x - 1]
                        cost = self.whole(a, k, b, j)
                        gone, rows = parted(rows, _close(t[x][y], t[x - 1][y] + cost, 1e-9))
                        if len(gone):
                            states.append((gone, [*todo, ("op", "delete_tree", a.path(k), None, cost, a.uid[k], "a", k), ("align", i, j, x - 1, y)], [*ops]))
                    if len(rows):
                        k = b.kids[j][y - 1]
                        todo += [("op", "insert_tree", a.path(i), y, self.whole(b, k, a, i), a.uid[i], "b", k), ("align", i, j, x, y - 1)]
            if len(rows):
                out.append((rows, ops))
        return out

    def round_trip(self, rows: np.ndarray, ops: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """Whether the operations' replay gives the very tree, and one at distance zero, of each pair of rows.

        Replayed once, over trees whose nodes say where they are from; then what they hold is compared.
        """
        sides = {}
        for name, s in (("a", self.a), ("b", self.b)):
            t, n = s.tree, len(s.tree)
            sides[name] = Side.__new__(Side)
            sides[name].tree = Tree(t.labels, t.kinds, [None] * n, [f"{name}{i}" for i in range(n)], [None] * n, t.depths, t.left)
        draft = Draft(sides["a"].tree)
        draft.apply([{"op": op, "path": path, "at": at, "uid": uid, "nodes": sides[side].subtree(i) if op != "update_node" and op != "update_value" else [sides[side].tree.rows()[i] | {"left": 0}]} for op, path, at, _, uid, side, i in ops])
        made, target = draft.tree(), self.b.tree
        from_ = [(self.a if x[0] == "a" else self.b, int(x[1:])) for x in made.texts]
        if (made.labels, made.kinds, made.depths, made.left) == (target.labels, target.kinds, target.depths, target.left):
            differ = False
            for j, (s, i) in enumerate(from_):
                if s is not self.b or i != j:
                    differ = differ | np.asarray(self.differ(s, i, self.b, j))
            equal = ~np.broadcast_to(_entry(np.asarray(differ), rows), len(rows))
        else:
            equal = np.zeros(len(rows), bool)
        exact = equal.copy()  # equal trees are at distance zero if no number is missing
        missing = [j for j, kind in enumerate(target.kinds) if kind == "num"]
        for n, row in enumerate(rows.tolist()):
            b = self.pairs[1][row]
            if not equal[n] or any(b.numbers[j] is None for j in missing):
                held = [(self.pairs[0][row] if s is self.a else b, i) for s, i in from_]
                patched = Tree(made.labels, made.kinds, *([getattr(t, f)[i] for t, i in held] for f in ("numbers", "texts", "items")), made.depths, made.left)
                exact[n] = abs(Alignment(patched, b, self.costs).total) < 1e-9
        return equal, exact


SEGMENT = re.compile(r"^(.+)\[([0-9]+)\]$")


def path_steps(path: str) -> list[tuple[str, int]]:
    """(label, place from 0) of each step of a path such as root/General[2]/Capital[1]; labels may hold slashes."""
    if path in ("", "root"):
        return []
    steps, held = [], ""
    for part in path.removeprefix("root/").split("/"):
        held = f"{held}/{part}" if held else part
        if m := SEGMENT.match(held):
            steps.append((m[1], int(m[2]) - 1))
            held = ""
    if held:
        raise ValueError(f"no step of a path: {held}")
    return steps


class Draft:
    """A tree that operations are applied to: nodes by patch id, with their children."""

    def __init__(self, tree: Tree):
        self.kids: dict[str, list[str]] = {}
        self.rows: dict[str, dict] = {}
        self.parent: dict[str, str] = {}
        self.root = self.graft(tree.rows(), "n") if len(tree) else ""

    def graft(self, rows: list[dict], prefix: str) -> str:
        """Adds a subtree; ids are its preorder numbers after the prefix."""
        t = Tree.of(rows)
        kids, ids = t.children(), {}
        for n, i in enumerate(t.preorder(), 1):
            ids[i] = f"{prefix}{n:06d}"
        for i, row in enumerate(rows):
            self.rows[ids[i]], self.kids[ids[i]] = row, [ids[k] for k in kids[i]]
            for k in kids[i]:
                self.parent[ids[k]] = ids[i]
        return ids[len(rows) - 1]

    def apply(self, ops: list[dict]) -> None:
        """Deletions and updates first, deepest and rightmost first, then insertions from the top, left to right."""
        order = lambda o: ((s := path_steps(o["path"])), len(s), s[-1][1] if s else -1)[1:]
        for o in sorted((o for o in ops if o["op"] == "delete_tree"), key=order, reverse=True):
            self.kids[self.parent[o["uid"]]].remove(o["uid"])
        for o in sorted((o for o in ops if o["op"].startswith("update")), key=order, reverse=True):
            self.rows[o["uid"]] = o["nodes"][0]
        for n, o in enumerate(sorted((o for o in ops if o["op"] == "insert_tree"), key=lambda o: (len(path_steps(o["path"])), o["at"]))):
            new = self.graft(o["nodes"], f"i{n}-")
            self.parent[new] = o["uid"]
            self.kids[o["uid"]].insert(o["at"] - 1, new)

    def tree(self) -> Tree:
        out = Tree()
        if not self.root:
            return out
        todo: list[tuple[str, int, int]] = [(self.root, 0, -1)]
        while todo:
            at, depth, first = todo.pop()
            if first < 0:
                todo.append((at, depth, len(out)))  # closed after all below it, which start here
                todo += [(k, depth + 1, -1) for k in reversed(self.kids[at])]
            else:
                r = self.rows[at]
                out.add(r["label"], r["kind"], depth, first, r["num"], r["text"], r["items"])
        return out


def _ids(pairs: DataFrame) -> str:
    return ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in ("a_id", "b_id"))


def distances(pairs: DataFrame, costs: Costs = LATER, read=read_nodes, also: dict[str, Costs] | None = None) -> DataFrame:
    """(a_id, b_id, distance, similarity, size_a, size_b), and (k_distance, k_similarity) by further costs. A null tree is an empty one.

    read: what makes trees of a and b, if they are none yet (nested.read_texts).
    """
    settings = {"": costs} | {f"{k}_": c for k, c in (also or {}).items()}

    def run(t: pa.Table) -> dict:
        a, b = read(column(t, "a")), read(column(t, "b"))
        out = {f"{k}{m}": np.empty(len(a)) for k in settings for m in ("distance", "similarity")}
        for rows in groups(a, b):
            for k, c in settings.items():
                g = Group([a[r] for r in rows], [b[r] for r in rows], c)
                out[f"{k}distance"][rows], out[f"{k}similarity"][rows] = g.total, g.similarity
        return {"a_id": column(t, "a_id"), "b_id": column(t, "b_id"), "size_a": [len(x) for x in a], "size_b": [len(x) for x in b]} | out

    more = "".join(f", {k}distance double, {k}similarity double" for k in settings if k)
    return batched(by_shape(pairs), run, f"{_ids(pairs)}, distance double, similarity double, size_a long, size_b long{more}")


def _brought(t: Tree, op: str, i: int) -> list[dict]:
    """The nodes of an operation: one that is changed, or a subtree as a tree of its own."""
    first = i if op.startswith("update") else t.left[i]
    rows = Tree(*(getattr(t, f)[first : i + 1] for f in ("labels", "kinds", "numbers", "texts", "items", "depths", "left"))).rows()
    return [rows[0] | {"left": 0}] if op.startswith("update") else [r | {"left": r["left"] - first} for r in rows]


def scripts(pairs: DataFrame, costs: Costs = LATER, complete: bool = False, read=read_nodes, nodes: bool = True) -> DataFrame:
    """(a_id, b_id, seq, op, path, section, at, cost, uid, nodes): what turns a into b. Pairs with an empty tree have no script. nodes: without them that column is null."""

    def run(t: pa.Table) -> dict:
        a, b = read(column(t, "a")), read(column(t, "b"))
        at, ops, cost, held = [], [], [], []
        for rows in groups(a, b):
            if not (len(a[rows[0]]) and len(b[rows[0]])):
                continue
            g = Group([a[r] for r in rows], [b[r] for r in rows], costs)
            for own, made in g.traces(complete):
                for seq, o in enumerate(made):
                    at.append(rows[own])
                    ops.append((seq, *o[:3], o[4], len(own)))
                    cost.append(np.broadcast_to(_entry(np.asarray(o[3], dtype=float), own), len(own)))
                    if nodes:
                        held += [_brought((a if o[5] == "a" else b)[r], o[0], o[6]) for r in rows[own].tolist()]
        if not at:
            return pa.schema(kind).empty_table()
        take, times = pa.array(np.concatenate(at)), pa.array(np.repeat(np.arange(len(ops)), [o[5] for o in ops]))
        each = {k: pa.array([o[n] for o in ops], form).take(times) for n, (k, form) in enumerate((("seq", pa.int64()), ("op", pa.string()), ("path", pa.string()), ("at", pa.int32()), ("uid", pa.string())))}
        out = {"a_id": column(t, "a_id").take(take), "b_id": column(t, "b_id").take(take)} | each | {"cost": np.concatenate(cost), "nodes": held if nodes else pa.nulls(len(take), kind.field("nodes").type)}
        return {k: out[k] for k in kind.names}

    form = f"{_ids(pairs)}, seq long, op string, path string, at int, cost double, uid string, nodes array<{W.NODE}>"
    kind = to_arrow_schema(T.StructType.fromDDL(form))
    section = F.when(F.col("path") == "root", F.lit("<root>")).otherwise(F.regexp_extract(F.split_part("path", F.lit("/"), F.lit(2)), r"^(.+?)(\[[0-9]+\])?$", 1))
    return batched(by_shape(pairs), run, form).select("a_id", "b_id", "seq", "op", "path", section.alias("section"), "at", "cost", "uid", "nodes")


def round_trips(pairs: DataFrame, costs: Costs = LATER, read=read_nodes) -> DataFrame:
    """(a_id, b_id, equal, exact): whether a after its complete script is b node by node, and whether it is at distance zero of b.

    What replayed finds of the scripts, without a table of them in between.
    """

    def run(t: pa.Table) -> dict:
        a, b = read(column(t, "a")), read(column(t, "b"))
        equal, exact = np.zeros(len(a), bool), np.zeros(len(a), bool)
        for rows in groups(a, b):
            s, u = a[rows[0]], b[rows[0]]
            if not (len(s) and len(u)):  # no script
                equal[rows], exact[rows] = len(s) == len(u), Alignment(s, u, costs).total < 1e-9
                continue
            g = Group([a[r] for r in rows], [b[r] for r in rows], costs)
            for own, ops in g.traces(complete=True):
                equal[rows[own]], exact[rows[own]] = g.round_trip(own, ops)
        return {"a_id": column(t, "a_id"), "b_id": column(t, "b_id"), "equal": equal, "exact": exact}

    return batched(by_shape(pairs), run, f"{_ids(pairs)}, equal boolean, exact boolean")


def section_summary(ops: DataFrame) -> DataFrame:
    """(a_id, b_id, section, total_ops, updates, inserts, deletes, total_cost)."""
    kinds = [F.count_if(F.col("op").startswith(k)).alias(f"{k}s") for k in ("update", "insert", "delete")]
    return ops.groupBy("a_id", "b_id", "section").agg(F.count("*").alias("total_ops"), *kinds, F.sum("cost").alias("total_cost"))


def replayed(pairs: DataFrame, ops: DataFrame, costs: Costs = LATER) -> DataFrame:
    """(a_id, b_id, patched, size_patched, size_b, distance_after, equal, exact): a after its script, how far from b it is, and whether it is b node by node."""

    form = f"struct<patched:array<{W.NODE}>,size_patched:long,size_b:long,distance_after:double,equal:boolean>"
    kind = to_arrow_type(T.DataType.fromDDL(form))

    @F.arrow_udf(form)
    def run(a: pa.Array, b: pa.Array, script: pa.Array) -> pa.Array:
        out = []
        for x, y, s in zip(a.to_pylist(), b.to_pylist(), script.to_pylist(), strict=True):
            draft, target = Draft(Tree.of(x)), Tree.of(y)
            draft.apply(s or [])
            t = draft.tree()
            out.append({"patched": t.rows(), "size_patched": len(t), "size_b": len(target), "distance_after": Alignment(t, target, costs).total, "equal": t == target})
        return pa.array(out, kind)

    own = ops.groupBy("a_id", "b_id").agg(F.collect_list(F.struct("op", "path", "at", "uid", "nodes")).alias("script"))  # in any order
    rows = spread(pairs.join(own, ["a_id", "b_id"], "left")).select("a_id", "b_id", run("a", "b", "script").alias("r")).select("a_id", "b_id", "r.*")
    return rows.withColumn("exact", F.abs("distance_after") < 1e-9)
