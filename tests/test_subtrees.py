"""Distances with what is known of subtrees against those of single pairs, and features counted by shape."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treeloom.operators import compare as C
from treeloom.operators import nested as N
from treeloom.operators import shaped, trees


def pages(seed, n):
    rng = random.Random(seed)

    def part(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["", "one", "two words", "12", "13.5", "1e3", "nan", "inf", "p", "div"])
        return "".join(f"<{g}>{part(depth - 1)}</{g}>" for g in rng.choices(["p", "div", "b", "i"], k=rng.randint(1, 3)))

    return [part(4) for _ in range(n)] + ["", None, "<p>", "12", "<br>"]


@pytest.mark.parametrize("limit", [1500, 60])
def test_known_subtrees_change_no_distance(limit):
    docs = pages(1, 60)
    for read, known in ((N.read_texts("markup"), shaped.Subtrees(limit)),):
        made = read(pa.array(docs))
        for s, t in zip(made * 2, [*made[1:], *made[:1], *made[::-1]]):
            assert C.known_distances(s, t, known) == pytest.approx(tuple(d(s, t) for d in C.DISTANCES.values()))
    known = shaped.Subtrees(limit)
    tags = [trees.postorder(x) for x in docs]
    for a, b in zip(tags * 2, [*tags[1:], *tags[:1], *tags[::-1]]):
        assert trees.subtree_distance(a, b, known) == trees.tree_distance(a, b)


def test_equal_pairs_are_measured_once():
    known, asked = shaped.Subtrees(), []
    a, b = trees.postorder("<div><p></p><p><b></b></p></div>"), trees.postorder("<div><b></b></div>")
    for _ in range(5):
        x, y = known.numbered(*a), known.numbered(*b)
        known.distance(x, a[1], y, b[1], lambda: asked.append(1) or (shaped.np.array(a[0])[:, None] != shaped.np.array(b[0])))
    assert len(asked) == 1


def test_features_counted_by_shape_are_all_features(spark):
    for docs, form in ((pages(2, 40), "markup"), (['{"a": {"b": 1, "c": [1, 2]}}', '{"a": 1}', None, "{broken", '{"a": {"b": 2, "c": []}}'], "json")):
        rows = spark.createDataFrame(list(enumerate(docs)), "id long, text string")
        want = C.features(N.trees(rows, "id", "text", form)).groupBy("kind", "feature").agg(F.count("*").alias("n")).collect()
        got = C.feature_counts(rows, "text", N.read_texts(form)).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
