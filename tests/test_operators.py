"""Trees, diffs, clusterings: properties and brute-force comparisons on small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeloom.operators import cluster, diff, trees
from treeloom.operators.graph import components


def slow_distance(a, b):
    """Forest edit distance by its definition; a tree is (label, children)."""
    from functools import cache

    def size(forest):
        return sum(1 + size(t[1]) for t in forest)

    @cache
    def d(x, y):
        if not x or not y:
            return size(x) + size(y)
        (lx, cx), (ly, cy) = x[-1], y[-1]
        return min(d(x[:-1] + cx, y) + 1, d(x, y[:-1] + cy) + 1, d(cx, cy) + d(x[:-1], y[:-1]) + (lx != ly))

    return d((a,), (b,))


def grow(rng, n):
    kids = []
    n -= 1
    while n > 0:
        k = rng.randint(1, n)
        kids.append(grow(rng, k))
        n -= k
    return rng.choice("abc"), tuple(kids)


def html(t):
    return f"<{t[0]}>{''.join(map(html, t[1]))}</{t[0]}>"


def test_tree_distance_is_exact():
    rng = random.Random(5)
    for _ in range(60):
        a, b = grow(rng, rng.randint(1, 8)), grow(rng, rng.randint(1, 8))
        assert trees.tree_distance(trees.postorder(html(a)), trees.postorder(html(b))) == slow_distance(a, b)


def test_postorder_of_broken_markup():
    assert trees.postorder(None) == ([], [])
    assert trees.postorder("<a><br><b>x</a></c>")[0] == ["br", "b", "a"]
    assert trees.tree_distance(trees.postorder(""), trees.postorder("<a></a>")) == 1.0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (7, 7)], "a long, b long")
    assert {r.id: r.component for r in components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10}
    assert components(edges.limit(0)).count() == 0


def test_script_round_trip(spark):
    s = spark.createDataFrame([(1, "a/x", "a", "1"), (1, "a/y", "a", None), (1, "b/z", "b", "3")], "pair long, path string, section string, value string")
    t = spark.createDataFrame([(1, "a/x", "a", "2"), (1, "a/y", "a", None), (1, "c/w", "c", "9")], s.schema)
    ops = diff.script(s, t)
    assert [(r.op, r.path) for r in ops.orderBy("seq").collect()] == [("update", "a/x"), ("delete", "b/z"), ("insert", "c/w")]
    assert diff.verify(diff.apply_script(s, ops), t).head().equal
    assert diff.verify(diff.apply_script(t, diff.invert(ops)), s).head().equal
    assert not diff.verify(s, t).head().equal


def points(n=12):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.1, (n // 2, 2)), rng.normal(3, 0.1, (n // 2, 2))])
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def pairs_of(spark, d):
    return spark.createDataFrame([(i, j, float(d[i, j])) for i in range(len(d)) for j in range(len(d)) if i != j], "a_id long, b_id long, dist double")


@pytest.mark.parametrize("method", ["single", "average", "complete"])
def test_linkage(method):
    d = points()
    merges = cluster.linkage_merges(d, method)
    heights = [m[2] for m in merges]
    assert len(merges) == len(d) - 1 and merges[-1][3] == len(d)
    assert all(x <= y + 1e-12 for x, y in zip(heights, heights[1:], strict=False))
    assert heights[-1] > 2 > heights[-2]


def test_every_clustering_finds_two_groups(spark):
    d = points()
    p = pairs_of(spark, d)
    ids = p.select(F.col("a_id").alias("id")).distinct()
    truth = {i: 0 if i < 6 else 6 for i in range(12)}
    results = [cluster.single_linkage(ids, p, 1.0), cluster.dbscan(ids, p, 1.0, 3), cluster.agglomerative(p, "average", k=2), cluster.agglomerative(p, "complete", threshold=1.0), cluster.kmeans_on_scaling(p, 2), cluster.spectral(p.withColumn("dist", F.col("dist") / 5), 2)]
    for r in results:
        assert {x.id: x.cluster for x in r.collect()} == truth
    assert len({x.medoid for x in cluster.kmedoids_seeded(p, 2).collect()}) == 2


def test_dbscan_noise(spark):
    d = points()
    d = np.pad(d, (0, 1), constant_values=50.0)
    np.fill_diagonal(d, 0)
    p = pairs_of(spark, d)
    got = {x.id: x.cluster for x in cluster.dbscan(p.select(F.col("a_id").alias("id")).distinct(), p, 1.0, 3).collect()}
    assert got[12] == -1 and got[0] == 0


def test_scaling_reproduces_distances():
    d = points()
    x = cluster.smacof(d, 2)
    assert np.allclose(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), d, atol=1e-6)
