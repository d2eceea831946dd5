"""The weighted tree edit distance against a plain recursion over forests, and its script."""

import random
from functools import lru_cache

import pytest

from treeloom.operators.weighted import Mapping, Rules, update_cost


def random_tree(rng, size):
    """(postorder nodes, nested form) of a random tree."""
    nodes = []

    def build(n, depth):
        first, below = len(nodes), []
        n -= 1
        while n > 0:
            k = rng.randint(1, n)
            below.append(build(k, depth + 1))
            n -= k
        kind = "dict" if below else rng.choice(["num", "str"])
        nodes.append({"label": rng.choice("abc"), "kind": kind, "num": rng.choice([None, 1.0, 5.0, -2.0]), "text": rng.choice(["", "x y", "y z"]), "items": None, "dist": None, "weight": rng.choice([0.3, 1.0, 2.5]), "depth": depth, "left": first})
        return (len(nodes) - 1, tuple(below))

    return nodes, build(size, 0)


def plain(a, ta, b, tb, rules):
    @lru_cache(None)
    def forests(x, y):
        if not x and not y:
            return 0.0
        options = []
        if x:
            options.append(forests(x[:-1] + x[-1][1], y) + a[x[-1][0]]["weight"])
        if y:
            options.append(forests(x, y[:-1] + y[-1][1]) + b[y[-1][0]]["weight"])
        if x and y:
            options.append(forests(x[:-1], y[:-1]) + forests(x[-1][1], y[-1][1]) + update_cost(a[x[-1][0]], b[y[-1][0]], rules))
        return min(options)

    return forests((ta,), (tb,))


@pytest.mark.parametrize("seed", range(40))
def test_distance_and_script(seed):
    rng = random.Random(seed)
    rules = Rules(rng.choice([1, 3, 5]), rng.random() < 0.3)
    (a, ta), (b, tb) = random_tree(rng, rng.randint(1, 9)), random_tree(rng, rng.randint(1, 9))
    got = Mapping(a, b, rules)
    assert got.distance() == pytest.approx(plain(a, ta, b, tb, rules))
    ops = got.script()
    assert sum(o[4] for o in ops) == pytest.approx(got.distance())
    assert sorted(o[2] for o in ops if o[2] is not None) == list(range(len(a)))
    assert sorted(o[3] for o in ops if o[3] is not None) == list(range(len(b)))


def test_an_empty_tree_costs_all_of_the_other():
    a, _ = random_tree(random.Random(1), 5)
    assert Mapping(a, [], Rules()).distance() == Mapping([], a, Rules()).distance() == pytest.approx(sum(n["weight"] for n in a))
    assert [o[0] for o in Mapping([], a, Rules()).script()] == ["insert"] * 5
