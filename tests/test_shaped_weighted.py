"""Weighted distances of many pairs at once against the kernel of one pair, and how often a shape is worked through."""

import json
import random

import pyarrow as pa

from treeloom.operators import nested as N
from treeloom.operators import shaped
from treeloom.operators import weighted as W

WEIGHTS = {"x": 0.5, "y": 2.0, "part": 0.3}


def documents(seed, n):
    rng = random.Random(seed)
    leaf = lambda: rng.choice([1, 2.5, -3, 0, "one two", "two three", "", None, ["a", "b"], ["b"], [], {}])
    part = lambda: {k: leaf() for k in rng.sample(["x", "y", "z"], rng.randint(1, 3))}
    return [json.dumps({k: {"part": part(), "x": leaf()} if rng.random() < 0.5 else leaf() for k in rng.sample("pqr", rng.randint(1, 3))}) for _ in range(n)] + [None, "{broken", "[]", "5"]


def test_groups_of_pairs_measure_as_single_pairs():
    docs = documents(1, 150)
    read = N.read_texts("json", WEIGHTS)
    a, b = read(pa.array(docs)), read(pa.array(docs[::-1]))
    for rules in (W.Rules(), W.Rules(sharpness=5, depth_factor=True)):
        for rows in shaped.groups(a, b):
            xs, ys = [a[r] for r in rows], [b[r] for r in rows]
            far, traces = W._mapped(xs, ys, rules).distance(), W._traces(xs, ys, rules)
            for n, (x, y) in enumerate(zip(xs, ys, strict=True)):
                one = W.Mapping(x.rows(WEIGHTS), y.rows(WEIGHTS), rules)
                assert abs(far[n] - one.distance()) < 1e-9
                assert [o[:4] for o in traces[n]] == [o[:4] for o in one.script()]


def test_pairs_of_one_shape_share_their_tables(spark, monkeypatch):
    docs = [json.dumps({"head": {"x": i, "y": f"word{i % 3}"}, "total": i * 1.5}) for i in range(2000)]
    read = N.read_texts("json")
    trees = read(pa.array(docs))
    made = []
    monkeypatch.setattr(shaped.Forests, "forest", lambda self, i, j, f=shaped.Forests.forest: made.append(1) or f(self, i, j))
    for rows in shaped.groups(trees, trees[::-1]):
        W._mapped([trees[r] for r in rows], [trees[::-1][r] for r in rows], W.Rules()).distance()
    assert len(made) < 20
    rows = [(i, d, i + 1, e) for i, (d, e) in enumerate(zip(docs, docs[1:]))]
    pairs = spark.createDataFrame(rows, "a_id long, a string, b_id long, b string")
    got = {r.a_id: r for r in W.distances(pairs, read=read).collect()}
    assert len(got) == 1999 and all(abs(got[i].distance - W.Mapping(trees[i].rows(), trees[i + 1].rows(), W.Rules()).distance()) < 1e-9 for i in range(0, 1999, 37))
