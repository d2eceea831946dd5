"""Kernels over many pairs of trees at once: pairs of the same two shapes go through one table, whose entries are vectors.

A shape is what a tree is without its values: labels, kinds, weights and form. The numbers and texts of all pairs of one
shape are vectors, one entry a pair; what shapes alone decide is decided once. Trees whose shapes are all different cost
what they would one by one.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np

#: Cells of all tables of a group that are held at once.
CELLS = 1 << 21


def shape(tree) -> tuple:
    return tuple(tree.labels), tuple(tree.kinds), tuple(tree.left), None if tree.weights is None else tuple(tree.weights)


def groups(a: list, b: list) -> Iterator[np.ndarray]:
    """Rows of pairs with the same two shapes, so many at a time that tables stay small."""
    ids: dict[tuple, int] = {}
    met: dict[tuple[int, int], list[int]] = {}
    for row, (x, y) in enumerate(zip(a, b, strict=True)):
        key = ids.setdefault(shape(x), len(ids)), ids.setdefault(shape(y), len(ids))
        met.setdefault(key, []).append(row)
    for rows in met.values():
        x, y = a[rows[0]], b[rows[0]]
        most = max(1, CELLS // ((len(x) + 1) * (len(y) + 1)))
        for at in range(0, len(rows), most):
            yield np.array(rows[at : at + most])


class Values:
    """What the nodes of trees of one shape hold, a vector a node. Codes of two columns are equal where their texts are."""

    def __init__(self, trees: list, codes: dict):
        self.trees, self.codes, self.known = trees, codes, {}

    def numbers(self, i: int) -> np.ndarray:
        """Missing ones are NaN."""
        return self.made(("number", i), lambda: np.array([np.nan if (x := t.numbers[i]) is None else x for t in self.trees], dtype=float))

    def coded(self, i: int, of) -> np.ndarray:
        """Codes of a value of(tree, i), which has to be hashable."""
        return self.made((of, i), lambda: np.array([self.codes.setdefault(of(t, i), len(self.codes)) for t in self.trees]))

    def made(self, key, make):
        got = self.known.get(key)
        if got is None:
            got = self.known[key] = make()
        return got


def key_roots(left: list[int]) -> list[int]:
    return sorted({at: i for i, at in enumerate(left)}.values())


class Forests:
    """Edit distances between all subtrees of two trees, and of the forests before them, by forests between key roots.

    out, new: costs of deleting and inserting each node. swap: cost of turning a's node into b's, a number or a vector;
    nodes without an entry never turn into each other. Every table entry is a vector, one number a pair.
    """

    def __init__(self, la: list[int], lb: list[int], out: list[float], new: list[float], swap: dict, width: int, keep: bool = False):
        self.la, self.lb, self.out, self.new, self.swap = la, lb, out, new, swap
        self.tree = np.zeros((len(la), len(lb), width))
        met = np.zeros((len(la) + 1, len(lb) + 1), int)
        for i, j in swap:
            met[i + 1, j + 1] = 1
        self.met = met.cumsum(0).cumsum(1)
        #: tables of forests by the leftmost leaves that they start at, if kept
        self.tables: dict[tuple[int, int], np.ndarray] = {}
        for i in key_roots(la):
            for j in key_roots(lb):
                if not keep and not self.meet(i, j):
                    self.apart(i, j)
                    continue
                f = self.forest(i, j)
                if keep:
                    self.tables[la[i], lb[j]] = f

    def meet(self, i: int, j: int) -> bool:
        """Whether any node below i may turn into one below j."""
        li, lj, n = self.la[i], self.lb[j], self.met
        return bool(n[i + 1, j + 1] - n[li, j + 1] - n[i + 1, lj] + n[li, lj])

    def apart(self, i: int, j: int) -> None:
        """Enters distances where all is deleted and inserted."""
        li, lj = self.la[i], self.lb[j]
        out, new = np.cumsum(self.out[li : i + 1]), np.cumsum(self.new[lj : j + 1])
        cols = [y for y in range(lj, j + 1) if self.lb[y] == lj]
        for x in range(li, i + 1):
            if self.la[x] == li:
                self.tree[x, cols] = (out[x - li] + new[[y - lj for y in cols]])[:, None]

    def forest(self, i: int, j: int) -> np.ndarray:
        la, lb, tree = self.la, self.lb, self.tree
        li, lj = la[i], lb[j]
        f = np.empty((i - li + 2, j - lj + 2, tree.shape[2]))
        f[0] = np.concatenate([[0.0], np.cumsum(self.new[lj : j + 1])])[:, None]
        f[:, 0] = np.concatenate([[0.0], np.cumsum(self.out[li : i + 1])])[:, None]
        for x in range(li, i + 1):
            r, lx, out = x - li + 1, la[x] - li, self.out[x]
            whole = lx == 0
            gone = f[r - 1] + out
            for y in range(lj, j + 1):
                c, ly = y - lj + 1, lb[y] - lj
                best = np.add(f[r, c - 1], self.new[y], out=f[r, c])
                np.minimum(best, gone[c], out=best)
                if whole and ly == 0:
                    if (swap := self.swap.get((x, y))) is not None:
                        np.minimum(best, f[r - 1, c - 1] + swap, out=best)
                    tree[x, y] = best
                else:
                    np.minimum(best, f[lx, ly] + tree[x, y], out=best)
        return f

    def distance(self) -> np.ndarray:
        if not (len(self.la) and len(self.lb)):
            return np.full(self.tree.shape[2], float(sum(self.out) + sum(self.new)))
        return self.tree[-1, -1]


class Subtrees:
    """Numbers for subtrees, equal ones the same, and what is known of every two: measured once, wherever they occur.

    Beyond `limit` different subtrees or `most` pairs all is forgotten, so memory is bounded.
    """

    def __init__(self, limit: int = 1500, most: int = 1 << 18):
        self.limit, self.most = limit, most
        self.clear()

    def clear(self) -> None:
        self.ids: dict[tuple, int] = {}
        #: distances of subtrees, negative where unknown
        self.far = np.full((self.limit, self.limit), -1.0)
        #: results of further kernels, by their own keys
        self.more: dict[tuple, object] = {}

    def fits(self, n: int) -> bool:
        """Whether two trees of n nodes together can be numbered; makes room for them."""
        if n > self.limit:
            return False
        if len(self.ids) + n > self.limit or len(self.more) > self.most:
            self.clear()
        return True

    def numbered(self, tokens: list, left: list[int]) -> list[int]:
        """Of each node, in postorder, the number of its subtree. tokens: what nodes are compared by, hashable."""
        out: list[int] = []
        for i, token in enumerate(tokens):
            below, at = [], i - 1
            while at >= left[i]:
                below.append(out[at])
                at = left[at] - 1
            out.append(self.ids.setdefault((token, *below), len(self.ids)))
        return out

    def distance(self, a: list[int], la: list[int], b: list[int], lb: list[int], relabel: Callable[[], np.ndarray]) -> float:
        """Edit distance at unit costs of two trees as numbers of subtrees. relabel: makes the costs of turning nodes into each other."""
        far, ua, ub = self.far, np.array(a), np.array(b)
        if far[a[-1], b[-1]] >= 0:
            return float(far[a[-1], b[-1]])
        cost, left_b = relabel(), np.array(lb)
        for i in key_roots(la):
            for j in key_roots(lb):
                if far[a[i], b[j]] >= 0:
                    continue  # and with it all on their leftmost paths
                li, lj = la[i], lb[j]
                cols = slice(lj, j + 1)
                steps, start = np.arange(j - lj + 2, dtype=float), left_b[cols] - lj
                whole_b = start == 0
                f = np.empty((i - li + 2, j - lj + 2))
                f[0] = steps
                for x in range(li, i + 1):
                    r = x - li + 1
                    swap = f[la[x] - li, start] + far[ua[x], ub[cols]]
                    if la[x] == li:
                        swap = np.where(whole_b, f[r - 1, :-1] + cost[x, cols], swap)
                    row = f[r]
                    row[0] = r
                    np.minimum(f[r - 1, 1:] + 1, swap, out=row[1:])
                    row -= steps
                    np.minimum.accumulate(row, out=row)  # insertions run along the row
                    row += steps
                    if la[x] == li:
                        far[ua[x], ub[cols][whole_b]] = row[1:][whole_b]
        return float(far[a[-1], b[-1]])


@functools.lru_cache(4)
def worker_subtrees(kernel: str) -> Subtrees:
    """What a kernel knows, kept by a worker from one table to the next."""
    return Subtrees()
