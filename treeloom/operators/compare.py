"""Likeness of trees by many methods side by side: edit distances at unit costs (by preorder sequences, by child lists, by
forests), feature sets, multisets and vectors, and the spectrum of the tag sequence; label scripts; containment joins.

Trees are columns (operators.nested). A leaf with a value is compared by its value, other nodes by their label.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import saved
from . import weighted as W
from .nested import Tree, node_column, read_nodes
from .pairs import batched, by_shape, column, spread
from .shaped import Forests, Subtrees, Values, groups, worker_subtrees
from .trees import tree_distance


def as_number(text: str) -> float | None:
    try:
        x = float(text)
    except ValueError:
        return None
    return x if math.isfinite(x) else None


def relabel_cost(x: str, y: str) -> float:
    """0 for equal labels, for two numbers their gap over the larger one, at most 1, and 1 for others."""
    if x == y:
        return 0.0
    m, n = as_number(x), as_number(y)
    return 1.0 if m is None or n is None else min(abs(m - n) / max(abs(m), abs(n), 2.220446049250313e-16), 1.0)


def compared_labels(tree: Tree) -> list[str]:
    kids = tree.children()
    value = lambda i: tree.texts[i] if tree.numbers[i] is None else str(tree.numbers[i])
    return [tree.labels[i] if own or value(i) is None else value(i) for i, own in enumerate(kids)]


def sequence_distance(a: Tree, b: Tree) -> float:
    """Edit distance of the preorder sequences of (label, depth): only nodes of one depth turn into each other."""
    x, y = ([(names[i], t.depths[i]) for i in t.preorder()] for t, names in ((t, compared_labels(t)) for t in (a, b)))
    steps = np.arange(len(y) + 1, dtype=float)
    row = steps.copy()
    for i, (label, depth) in enumerate(x, 1):
        swap = np.array([relabel_cost(label, other) if depth == at else math.inf for other, at in y])
        best = np.concatenate([[float(i)], np.minimum(row[1:] + 1, row[:-1] + swap)])
        row = np.minimum.accumulate(best - steps) + steps
    return float(row[-1])


def labels_contained(p: Tree, i: int, pk: list[list[int]], t: Tree, j: int, tk: list[list[int]], values: bool = False) -> bool:
    """Whether p's subtree at i is at t's node j: equal labels (values: and values), children in the first fitting ones, in order."""
    if p.labels[i] != t.labels[j] or (values and (p.numbers[i], p.texts[i]) != (t.numbers[j], t.texts[j])):
        return False
    rest = iter(tk[j])
    return all(any(labels_contained(p, k, pk, t, at, tk, values) for at in rest) for k in pk[i])


def children_distance(a: Tree, b: Tree) -> float:
    """Child lists aligned; a subtree that the opposite node contains costs 1, any other its number of nodes."""
    if not (len(a) and len(b)):
        return float(len(a) + len(b))
    ak, bk, la, lb = a.children(), b.children(), compared_labels(a), compared_labels(b)
    known: dict[tuple[int, int], float] = {}

    def whole(p: Tree, i: int, pk: list, t: Tree, j: int, tk: list) -> float:
        return 1.0 if labels_contained(p, i, pk, t, j, tk) else float(i - p.left[i] + 1)

    def distance(i: int, j: int) -> float:
        if (i, j) not in known:
            row = [float(n) for n in range(len(bk[j]) + 1)]
            new = [whole(b, k, bk, a, i, ak) for k in bk[j]]
            for n, k in enumerate(ak[i], 1):
                out, above, row = whole(a, k, ak, b, j, bk), row, [float(n)]
                for y, m in enumerate(bk[j]):
                    row.append(min(above[y + 1] + out, row[y] + new[y], above[y] + distance(k, m) + relabel_cost(la[k], lb[m])))
            known[i, j] = row[-1]
        return known[i, j]

    return distance(len(a) - 1, len(b) - 1) + relabel_cost(la[-1], lb[-1])


def forest_distance(a: Tree, b: Tree) -> float:
    la, lb = compared_labels(a), compared_labels(b)
    relabel = np.array([[relabel_cost(x, y) for y in lb] for x in la]).reshape(len(la), len(lb))
    return tree_distance((la, a.left), (lb, b.left), relabel)


DISTANCES: dict[str, Callable[[Tree, Tree], float]] = {"sequence": sequence_distance, "children": children_distance, "forest": forest_distance}
#: by 1 + d, by both sizes, by the larger size
NORMS = {"inverse": lambda d, m, n: 1 / (1 + d), "sum": lambda d, m, n: max(0.0, 1 - d / (m + n)) if m + n else 1.0, "max": lambda d, m, n: max(0.0, 1 - d / max(m, n)) if m + n else 1.0}

NORM_VECTORS = {"inverse": NORMS["inverse"], "sum": lambda d, m, n: np.maximum(0.0, 1 - d / (m + n)) if m + n else np.ones_like(d), "max": lambda d, m, n: np.maximum(0.0, 1 - d / max(m, n)) if m + n else np.ones_like(d)}


def tag_features(t: Tree) -> list[str]:
    return [t.labels[i] for i in t.preorder()]


def edge_features(t: Tree) -> list[str]:
    return [f"{t.labels[i]}/{t.labels[k]}" for i, own in enumerate(t.children()) for k in own]


def _paths(t: Tree, steps: list[str]) -> list[str]:
    """Path of each node, given its own step."""
    kids, out = t.children(), list(steps)
    for i in t.preorder():
        for k in kids[i]:
            out[k] = f"{out[i]}/{steps[k]}" if out[i] else steps[k]
    return out


def all_path_features(t: Tree) -> list[str]:
    paths = _paths(t, t.labels)
    return [paths[i] for i in t.preorder()]


def root_path_features(t: Tree) -> list[str]:
    paths, kids = _paths(t, t.labels), t.children()
    return [paths[i] for i in t.preorder() if not kids[i]]


def xpath_features(t: Tree) -> list[str]:
    """Paths below the root, each step with its number among siblings of its label."""
    steps = [""] * len(t)
    for own in t.children():
        met: Counter[str] = Counter()
        for k in own:
            met[t.labels[k]] += 1
            steps[k] = f"{t.labels[k]}[{met[t.labels[k]]}]"
    paths = _paths(t, steps)
    return [paths[i] for i in t.preorder()[1:]]


FEATURES: dict[str, Callable[[Tree], list[str]]] = {"tag": tag_features, "edge": edge_features, "path_root": root_path_features, "path_all": all_path_features, "path_xpath": xpath_features}


def skeleton(t: Tree) -> list[str]:
    """Opening and closing tags in document order."""
    kids, out, todo = t.children(), [], [(len(t) - 1, False)] if len(t) else []
    while todo:
        i, closing = todo.pop()
        out.append(f"</{t.labels[i]}>" if closing else f"<{t.labels[i]}>")
        if not closing:
            todo.append((i, True))
            todo += [(k, False) for k in reversed(kids[i])]
    return out


def spectral_likeness(a: Tree, b: Tree) -> float:
    """Cosine of the magnitudes of the two tag signals: each tag its number of first appearance, closing ones negative."""
    x, y = skeleton(a), skeleton(b)
    heights: dict[str, float] = {}
    for tag in [*x, *y]:
        if not tag.startswith("</"):
            heights.setdefault(tag, len(heights) + 1.0)
    signal = lambda tags: [heights[g] if g in heights else -heights[g.replace("</", "<", 1)] for g in tags]
    n = max(len(x), len(y), 1)
    p, q = (np.abs(np.fft.fft(signal(tags), n)) for tags in (x, y))
    size = float(np.linalg.norm(p) * np.linalg.norm(q))
    return min(1.0, max(0.0, float(p @ q) / size)) if size else 0.0


def set_likeness(x: list[str], y: list[str], measure: str, tf: str = "raw") -> float:
    s, t = {*x}, {*y}
    both = len(s & t)
    return {"intersection": lambda: both / max(len(s), len(t), 1), "jaccard": lambda: both / len(s | t) if s or t else 1.0, "dice": lambda: 2 * both / (len(s) + len(t)) if s or t else 1.0}[measure]()


def multiset_likeness(x: list[str], y: list[str], measure: str, tf: str = "raw") -> float:
    both = (Counter(x) & Counter(y)).total()
    union = (Counter(x) | Counter(y)).total()
    return {"intersection": lambda: both / max(len(x), len(y), 1), "jaccard": lambda: both / union if union else 1.0, "dice": lambda: 2 * both / (len(x) + len(y)) if x or y else 1.0}[measure]()


def vector_likeness(x: list[str], y: list[str], measure: str, tf: str = "raw") -> float:
    f, g = Counter(x), Counter(y)
    keys = sorted({*f, *g})
    u, v = (np.array([c[k] for k in keys], float) for c in (f, g))
    if tf == "log":
        u, v = np.log1p(u), np.log1p(v)
    elif tf == "normalized":
        u, v = u / max(f.values(), default=1), v / max(g.values(), default=1)
    dot, uu, vv = float(u @ v), float(u @ u), float(v @ v)
    if measure == "pearson":
        u, v = (w - w.mean() if len(w) else w for w in (u, v))
        size = math.sqrt(float(u @ u) * float(v @ v))
        return max(0.0, float(u @ v) / size) if size > 1e-12 else 0.0
    return {
        "cosine": lambda: dot / math.sqrt(uu * vv) if uu * vv else 0.0,
        "euclidean": lambda: 1 / (1 + math.sqrt(float(((u - v) ** 2).sum()))),
        "manhattan": lambda: 1 / (1 + float(np.abs(u - v).sum())),
        "tanimoto": lambda: dot / (uu + vv - dot) if uu + vv - dot else 1.0,
        "dice": lambda: 2 * dot / (uu + vv) if uu + vv else 1.0,
    }[measure]()


VARIANTS = {"set": set_likeness, "multiset": multiset_likeness, "vector": vector_likeness}
#: The methods of the whole comparison, in order.
METHODS = (
    *[f"{d}/{n}" for n in ("max", "sum", "inverse") for d in ("sequence", "children", "forest")],
    "tag/set/jaccard", "tag/multiset/jaccard", "tag/vector/cosine/raw", "tag/vector/cosine/log",
    "edge/set/jaccard", "edge/vector/cosine/raw",
    "path_root/set/jaccard", "path_all/set/jaccard", "path_xpath/set/jaccard", "path_root/vector/cosine/raw",
    "spectral",
)


class Comparison:
    """Two trees under any method; distances and features are made once."""

    def __init__(self, a: Tree, b: Tree):
        self.a, self.b, self.known = a, b, {}

    def once(self, key: str, make: Callable):
        if key not in self.known:
            self.known[key] = make()
        return self.known[key]

    def likeness(self, method: str) -> float:
        name, *rest = method.split("/")
        if name in DISTANCES:
            d = self.once(name, lambda: DISTANCES[name](self.a, self.b))
            return NORMS[rest[0]](d, len(self.a), len(self.b))
        if name == "spectral":
            return spectral_likeness(self.a, self.b)
        x, y = self.once(name, lambda: tuple(FEATURES[name](t) for t in (self.a, self.b)))
        return VARIANTS[rest[0]](x, y, *rest[1:])


class Labels:
    """What the nodes of trees of one shape are compared by (compared_labels): one label, or texts and numbers, a vector a node."""

    def __init__(self, trees: list[Tree], codes: dict):
        self.values, t = Values(trees, codes), trees[0]
        self.fixed: list[str | None] = []  # the label where it is the same in all trees
        for i, own in enumerate(t.children()):
            held = any(x.texts[i] is not None or x.numbers[i] is not None for x in trees)
            self.fixed.append(t.labels[i] if own or not held else None)

    def numbers(self, i: int) -> np.ndarray | float:
        """As a number, NaN for other texts."""
        if self.fixed[i] is not None:
            return np.nan if (x := as_number(self.fixed[i])) is None else x
        return self.values.made(("as number", i), lambda: np.array([np.nan if (x := as_number(self.text(t, i))) is None else x for t in self.values.trees]) if any(t.numbers[i] is None for t in self.values.trees) else np.where(np.isfinite(x := self.values.numbers(i)), x, np.nan))

    @staticmethod
    def text(t: Tree, i: int) -> str:
        value = t.texts[i] if t.numbers[i] is None else str(t.numbers[i])
        return t.labels[i] if value is None else value

    def coded(self, i: int) -> np.ndarray | int:
        if self.fixed[i] is not None:
            return self.values.codes.setdefault(self.fixed[i], len(self.values.codes))
        return self.values.coded(i, self.text)


def relabel_costs(x: Labels, i: int, y: Labels, j: int) -> np.ndarray | float:
    """relabel_cost, for all pairs."""
    if x.fixed[i] is not None and y.fixed[j] is not None:
        return relabel_cost(x.fixed[i], y.fixed[j])
    m, n = x.numbers(i), y.numbers(j)
    known = ~np.isnan(m) & ~np.isnan(n)  # equal texts of numbers have no gap
    with np.errstate(invalid="ignore"):
        gap = np.minimum(np.abs(m - n) / np.maximum(np.maximum(np.abs(m), np.abs(n)), 2.220446049250313e-16), 1.0)
    if known.all():
        return gap
    return np.where(known, gap, x.coded(i) != y.coded(j))


def group_distances(a: list[Tree], b: list[Tree]) -> dict[str, np.ndarray]:
    """DISTANCES of pairs of trees of the same two shapes."""
    s, t, width = a[0], b[0], len(a)
    if not (len(s) and len(t)):
        return dict.fromkeys(DISTANCES, np.full(width, float(len(s) + len(t))))
    codes: dict = {}
    x, y = Labels(a, codes), Labels(b, codes)
    made: dict[tuple[int, int], np.ndarray | float] = {}

    def relabel(i: int, j: int) -> np.ndarray | float:
        if (i, j) not in made:
            made[i, j] = relabel_costs(x, i, y, j)
        return made[i, j]

    # sequence
    inner = [np.full(width, float(n)) for n in range(len(t) + 1)]
    order = [(j, t.depths[j]) for j in t.preorder()]
    for n, i in enumerate(s.preorder(), 1):
        above, inner = inner, [np.full(width, float(n))]
        for k, (j, depth) in enumerate(order):
            best = np.minimum(above[k + 1], inner[k]) + 1
            inner.append(np.minimum(best, above[k] + relabel(i, j)) if depth == s.depths[i] else best)
    # children
    ak, bk = s.children(), t.children()
    known: dict[tuple[int, int], np.ndarray] = {}

    def whole(p: Tree, i: int, pk: list, q: Tree, j: int, qk: list) -> float:
        return 1.0 if labels_contained(p, i, pk, q, j, qk) else float(i - p.left[i] + 1)

    def distance(i: int, j: int) -> np.ndarray:
        if (i, j) not in known:
            row = [np.full(width, float(n)) for n in range(len(bk[j]) + 1)]
            new = [whole(t, k, bk, s, i, ak) for k in bk[j]]
            for n, k in enumerate(ak[i], 1):
                out, above, row = whole(s, k, ak, t, j, bk), row, [np.full(width, float(n))]
                for at, m in enumerate(bk[j]):
                    row.append(np.minimum(np.minimum(above[at + 1] + out, row[at] + new[at]), above[at] + distance(k, m) + relabel(k, m)))
            known[i, j] = row[-1]
        return known[i, j]

    children = distance(len(s) - 1, len(t) - 1) + relabel(len(s) - 1, len(t) - 1)
    swap = {(i, j): relabel(i, j) for i in range(len(s)) for j in range(len(t))}
    forest = Forests(s.left, t.left, [1.0] * len(s), [1.0] * len(t), swap, width).distance()
    return {"sequence": inner[-1], "children": children, "forest": forest}


@functools.lru_cache(1 << 12)
def shape_likeness(labels_a: tuple, left_a: tuple, labels_b: tuple, left_b: tuple, methods: tuple[str, ...]) -> list[float]:
    """By each method that asks for labels and form alone; NaN for distances."""
    both = Comparison(*(shape_tree({"labels": list(x), "left": list(y), "values": None}) for x, y in ((labels_a, left_a), (labels_b, left_b))))
    return [np.nan if m.split("/")[0] in DISTANCES else both.likeness(m) for m in methods]


def compare_all(pairs: DataFrame, methods: tuple[str, ...] = METHODS, read=None) -> DataFrame:
    """(a_id, b_id, place, method, similarity) of pairs (a_id, a, b_id, b) of trees, a row a method. A null tree is an empty one.

    Features and tag signals are those of shapes, so they are compared once for all pairs of the same two shapes.
    """
    read = read or read_nodes
    measured = [m for m in methods if m.split("/")[0] in DISTANCES]

    def run(table: pa.Table) -> dict:
        a, b = read(column(table, "a")), read(column(table, "b"))
        out = np.empty((len(a), len(methods)))
        for rows in groups(a, b):
            s, t = a[rows[0]], b[rows[0]]
            far = group_distances([a[r] for r in rows], [b[r] for r in rows]) if measured else {}
            out[rows] = shape_likeness(tuple(s.labels), tuple(s.left), tuple(t.labels), tuple(t.left), methods)
            for n, m in enumerate(methods):
                if m in measured:
                    name, norm = m.split("/")
                    out[rows, n] = NORM_VECTORS[norm](far[name], len(s), len(t))
        n = len(methods)
        take = pa.array(np.repeat(np.arange(len(a)), n))
        return {"a_id": column(table, "a_id").take(take), "b_id": column(table, "b_id").take(take), "place": np.tile(np.arange(n, dtype=np.int32), len(a)), "method": pa.DictionaryArray.from_arrays(pa.array(np.tile(np.arange(n, dtype=np.int32), len(a))), pa.array(methods, pa.string())).cast(pa.string()), "similarity": out.ravel()}

    ids = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in ("a_id", "b_id"))
    return batched(by_shape(pairs), run, f"{ids}, place int, method string, similarity double")


def tokens(x: list[str], y: list[str], plain: set[str]) -> tuple[list, list]:
    """Labels as they tell on each other, so that different pairs have tokens in common.

    Those that meet neither their like nor, as numbers, a number are all the same, a token a side; other texts that both
    sides have go by the order of their appearance. plain: labels (tags) that stay as they are where both sides have them.
    """
    s, t = {*x}, {*y}
    m, n = ({v for v in u if as_number(v) is not None} for u in (s, t))
    numbers = (m if n else set()) | (n if m else set())
    given: dict[str, object] = {v: v for v in numbers | (s & t & plain)}
    shared = 0
    for v in x:
        if v in t and v not in given:
            given[v] = ("=", shared := shared + 1)
    return [given.get(v, (1,)) for v in x], [given.get(v, (2,)) for v in y]


def token_costs(x: list, y: list) -> np.ndarray:
    """relabel_cost of every two tokens."""
    codes: dict = {}
    a, b = (np.array([codes.setdefault(v, len(codes)) for v in u]) for u in (x, y))
    out = (a[:, None] != b).astype(float)
    numbers = [np.array([np.nan if not isinstance(v, str) or (n := as_number(v)) is None else n for v in u]) for u in (x, y)]
    for i in np.flatnonzero(~np.isnan(numbers[0])):
        for j in np.flatnonzero(~np.isnan(numbers[1])):
            out[i, j] = relabel_cost(x[i], y[j])
    return out


def known_distances(s: Tree, t: Tree, known: Subtrees) -> tuple[float, ...]:
    """DISTANCES of two trees; what is found out of subtrees stays known."""
    if not (len(s) and len(t)) or not known.fits(len(s) + len(t)):
        return tuple(d(s, t) for d in DISTANCES.values())
    x, y = tokens(compared_labels(s), compared_labels(t), {*s.labels, *t.labels})
    a, b = (known.numbered(list(zip(u.labels, v, strict=True)), u.left) for u, v in ((s, x), (t, y)))
    whole = ("all", a[-1], b[-1])
    if whole in known.more:
        return known.more[whole]
    costs = token_costs(x, y)
    # sequence
    p, q = s.preorder(), t.preorder()
    swap = np.where(np.array(s.depths)[p][:, None] == np.array(t.depths)[q], costs[np.ix_(p, q)], np.inf)
    steps = np.arange(len(q) + 1, dtype=float)
    row = steps.copy()
    for i in range(len(p)):
        best = np.concatenate([[i + 1.0], np.minimum(row[1:] + 1, row[:-1] + swap[i])])
        row = np.minimum.accumulate(best - steps) + steps
    # children
    ak, bk, more = s.children(), t.children(), known.more

    def out_cost(u: Tree, i: int, uk: list, ui: list[int], v: Tree, j: int, vk: list, vi: list[int]) -> float:
        key = "in", ui[i], vi[j]
        if key not in more:
            more[key] = labels_contained(u, i, uk, v, j, vk)
        return 1.0 if more[key] else float(i - u.left[i] + 1)

    def distance(i: int, j: int) -> float:
        key = "children", a[i], b[j]
        if key not in more:
            line = [float(n) for n in range(len(bk[j]) + 1)]
            new = [out_cost(t, k, bk, b, s, i, ak, a) for k in bk[j]]
            for n, k in enumerate(ak[i], 1):
                out, above, line = out_cost(s, k, ak, a, t, j, bk, b), line, [float(n)]
                for at, m in enumerate(bk[j]):
                    line.append(min(above[at + 1] + out, line[at] + new[at], above[at] + distance(k, m) + costs[k, m]))
            more[key] = float(line[-1])
        return more[key]

    children = distance(len(s) - 1, len(t) - 1) + float(costs[-1, -1])
    forest = known.distance(a, s.left, b, t.left, lambda: costs)
    return more.setdefault(whole, (float(row[-1]), children, forest))


def tree_distances(pairs: DataFrame, read=read_nodes) -> DataFrame:
    """(a_id, b_id, sequence, children, forest, size_a, size_b)."""

    def run(table: pa.Table) -> dict:
        a, b, known = read(column(table, "a")), read(column(table, "b")), worker_subtrees("labels")
        far = [known_distances(s, t, known) for s, t in zip(a, b, strict=True)]
        return {"a_id": column(table, "a_id"), "b_id": column(table, "b_id"), "size_a": [len(x) for x in a], "size_b": [len(x) for x in b]} | {k: [d[n] for d in far] for n, k in enumerate(DISTANCES)}

    ids = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in ("a_id", "b_id"))
    return batched(spread(pairs), run, f"{ids}, sequence double, children double, forest double, size_a long, size_b long")


def features(trees: DataFrame) -> DataFrame:
    """(id, kind, feature): every feature of every kind, repeated ones too."""

    @F.pandas_udf("array<struct<kind:string,feature:string>>")
    def found(column: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "feature": x} for t in [Tree.of(nodes)] for k, make in FEATURES.items() for x in make(t)] for nodes in column])

    return trees.select("id", F.explode(found("tree")).alias("f")).select("id", "f.*")


def feature_counts(rows: DataFrame, text: str, read) -> DataFrame:
    """(kind, feature, n): how often each feature occurs in all trees of a column of texts (read: nested.read_texts).

    Features are those of labels and form, so a task makes those of each shape once, and gives sums, not rows a tree.
    """

    def run(table: pa.Table) -> dict:
        shapes = Counter((tuple(t.labels), tuple(t.left)) for t in read(column(table, text)))
        found: Counter[tuple[str, str]] = Counter()
        for (labels, left), times in shapes.items():
            t = shape_tree({"labels": list(labels), "left": list(left), "values": None})
            for kind, make in FEATURES.items():
                for feature, n in Counter(make(t)).items():
                    found[kind, feature] += n * times
        return {"kind": [k for k, _ in found], "feature": [f for _, f in found], "n": list(found.values())}

    counted = batched(rows.select(text), run, "kind string, feature string, n long", most_bytes=1 << 22)
    return counted.groupBy("kind", "feature").agg(F.sum("n").alias("n"))


def label_script(x: list[str], y: list[str]) -> list[tuple[str, str, str | None]]:
    """(op, node, to): cheapest way from one sequence of labels to the other; changes before deletions before insertions, from the end."""
    table = [list(range(len(y) + 1))]
    for i, label in enumerate(x, 1):
        above, row = table[-1], [i]
        for j, other in enumerate(y, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (label != other)))
        table.append(row)
    ops, i, j = [], len(x), len(y)
    while i or j:
        if i and j and table[i][j] == table[i - 1][j - 1] + (x[i - 1] != y[j - 1]):
            i, j = i - 1, j - 1
            if x[i] != y[j]:
                ops.append(("update", x[i], y[j]))
        elif i and table[i][j] == table[i - 1][j] + 1:
            i -= 1
            ops.append(("delete", x[i], None))
        else:
            j -= 1
            ops.append(("insert", y[j], None))
    return ops[::-1]


def label_scripts(pairs: DataFrame) -> DataFrame:
    """(a_id, b_id, seq, op, node, to): edit script of the labels in preorder; each operation costs 1."""

    @F.pandas_udf("array<struct<op:string,node:string,to:string>>")
    def traced(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("op", "node", "to"), o, strict=True)) for o in label_script(tag_features(Tree.of(x)), tag_features(Tree.of(y)))] for x, y in zip(a, b, strict=True)])

    rows = spread(pairs).select("a_id", "b_id", F.posexplode(traced("a", "b")).alias("seq", "o"))
    return rows.select("a_id", "b_id", F.col("seq").cast("long").alias("seq"), "o.*")


def downward_paths(t: Tree, i: int, kids: list[list[int]], leaves_only: bool = False) -> set[int]:
    """Hashes of the label paths from a node down to each node below it, itself included."""
    out, todo = set(), [(i, t.labels[i])]
    while todo:
        at, path = todo.pop()
        if not leaves_only or not kids[at]:
            out.add(xxhash.xxh3_64_intdigest(path.encode("utf-8", "surrogatepass")) - (1 << 63))
        todo += [(k, f"{path}\x00{t.labels[k]}") for k in kids[at]]
    return out


#: What containment asks of a tree: labels, places of leftmost leaves, and, if values count, what leaves hold.
SHAPE = "struct<labels:array<string>,left:array<int>,values:array<string>>"


def shapes(trees: DataFrame, values: bool) -> DataFrame:
    """(id, shape, key) of trees; equal shapes have equal keys."""
    of = lambda make: F.transform("tree", make)
    held = of(lambda n: F.coalesce(F.concat(F.lit("text "), n["text"]), F.concat(F.lit("number "), n["num"].cast("string")), F.lit(""))) if values else F.lit(None)
    shape = F.struct(of(lambda n: n["label"]).alias("labels"), of(lambda n: n["left"]).alias("left"), held.alias("values")).cast(SHAPE)
    return trees.filter("size(tree) > 0").select("id", shape.alias("shape")).withColumn("key", F.sha2(F.to_json("shape"), 256))


def shape_tree(shape: dict) -> Tree:
    n = len(shape["labels"])
    return Tree(shape["labels"], ["dict"] * n, [None] * n, shape["values"] or [None] * n, [None] * n, [0] * n, shape["left"])


def inclusions(patterns: DataFrame, trees: DataFrame, values: bool = False) -> DataFrame:
    """(pattern_id, id, nodes): trees that contain a pattern anywhere, and the places of all nodes where they do.

    patterns and trees are (id, tree). Trees of one shape are matched once. Every node of a shape is indexed by its
    downward label paths; a pattern is looked up by the one of its root-to-leaf paths that fewest nodes have, and what
    it meets is matched in order. Null and empty trees take no part; an equal id on both sides is a pair like any other.
    """

    @F.arrow_udf("array<struct<node:int,path:long>>")
    def indexed(column: pa.Array) -> pa.Array:
        out = []
        for t in map(shape_tree, column.to_pylist()):
            kids = t.children()
            out.append([{"node": i, "path": p} for i in range(len(t)) for p in downward_paths(t, i, kids)])
        return pa.array(out, pa.list_(pa.struct([("node", pa.int32()), ("path", pa.int64())])))

    @F.arrow_udf("array<long>")
    def wanted(column: pa.Array) -> pa.Array:
        made = map(shape_tree, column.to_pylist())
        return pa.array([sorted(downward_paths(t, len(t) - 1, t.children(), leaves_only=True)) for t in made], pa.list_(pa.int64()))

    @F.arrow_udf("array<int>")
    def matched(pattern: pa.Array, tree: pa.Array, nodes: pa.Array) -> pa.Array:
        out = []
        for x, y, at in zip(pattern.to_pylist(), tree.to_pylist(), nodes.to_pylist(), strict=True):
            p, t = shape_tree(x), shape_tree(y)
            pk, tk = p.children(), t.children()
            out.append(sorted(j for j in at if labels_contained(p, len(p) - 1, pk, t, j, tk, values)))
        return pa.array(out, pa.list_(pa.int32()))

    p, t = (saved(shapes(x, values), "shapes") for x in (patterns, trees))
    some_p, some_t = (x.dropDuplicates(["key"]).select("key", "shape") for x in (p, t))
    index = saved(some_t.select(F.col("key").alias("b_id"), F.explode(indexed("shape")).alias("e")).select("b_id", "e.node", "e.path"), "index")
    often = index.groupBy("path").agg(F.count("*").alias("times"))
    keys = some_p.select(F.col("key").alias("a_id"), F.explode(wanted("shape")).alias("path"))
    key = keys.join(often, "path", "left").groupBy("a_id").agg(F.min_by("path", F.struct(F.coalesce("times", F.lit(0)), "path")).alias("path"))
    met = key.join(index, "path").groupBy("a_id", "b_id").agg(F.collect_set("node").alias("nodes"))
    met = met.join(some_p.select(F.col("key").alias("a_id"), F.col("shape").alias("p")), "a_id").join(some_t.select(F.col("key").alias("b_id"), F.col("shape").alias("t")), "b_id")
    found = spread(met).select("a_id", "b_id", matched("p", "t", "nodes").alias("nodes")).filter("size(nodes) > 0")
    found = found.join(_id_lists(p, "a_id", "pattern_id"), "a_id").join(_id_lists(t, "b_id", "id"), "b_id")
    # pairs of lists are dealt out; single pairs are made where they are written, as there may be as many as rows squared
    n = 2 * max(int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")), p.sparkSession.sparkContext.defaultParallelism)
    found = found.repartition(n, "a_id", "b_id", "pattern_id_part", "id_part")
    return found.select(F.explode("pattern_id").alias("pattern_id"), "id", "nodes").select("pattern_id", F.explode("id").alias("id"), "nodes")


#: Ids of a list that _id_lists makes, about.
LISTED = 1000


def _id_lists(shaped: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name, name_part) of (id, key): the ids of each key as lists of bounded length, so that a key that many have meets no join row by row."""
    parts = shaped.groupBy("key").agg(F.ceil(F.count("*") / LISTED).alias("parts"))
    rows = shaped.select("id", "key").join(parts, "key").select(F.col("key").alias(key), "id", F.pmod(F.xxhash64("id"), "parts").alias(f"{name}_part"))
    return rows.groupBy(key, f"{name}_part").agg(F.collect_list("id").alias(name))


def subtrees(trees: DataFrame, label: str) -> DataFrame:
    """(id, tree): of each tree the first subtree whose root has the label; trees without one have no row."""

    @F.arrow_udf(f"array<{W.NODE}>")
    def cut(nodes: pa.Array) -> pa.Array:
        out: list[Tree | None] = []
        for t in read_nodes(nodes):
            at = next((i for i in t.preorder() if t.labels[i] == label), None)
            if at is None:
                out.append(None)
                continue
            first = t.left[at]
            own = Tree(*(getattr(t, f)[first : at + 1] for f in ("labels", "kinds", "numbers", "texts", "items", "depths", "left")))
            own.depths, own.left = [d - t.depths[at] for d in own.depths], [x - first for x in own.left]
            out.append(own)
        return node_column(out)

    return trees.select("id", cut("tree").alias("tree")).filter("tree is not null")
