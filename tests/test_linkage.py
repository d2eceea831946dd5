"""Distributed linkage against merging one pair at a time."""

import numpy as np
import pytest

from treeloom.operators import cluster, linkage


def points(n, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, 3)) + np.arange(n)[:, None] % 4 * 2.0
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def pairs_of(spark, d):
    return spark.createDataFrame([(10 * i, 10 * j, float(d[i, j])) for i in range(len(d)) for j in range(len(d)) if i != j], "a_id long, b_id long, dist double")


@pytest.mark.parametrize("method", ["average", "complete"])
def test_linkage_is_that_of_single_merges(spark, method):
    d = points(24)
    got = [tuple(r) for r in linkage.linkage(pairs_of(spark, d), method).orderBy("step").collect()]
    want = [(s, a, b, h, n) for s, (a, b, h, n) in enumerate(cluster.linkage_merges(d, method))]
    assert [(r[0], r[1], r[2], r[4]) for r in got] == [(r[0], r[1], r[2], r[4]) for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])


def test_cut_and_leaf_order(spark):
    d = points(20, 5)
    pairs = pairs_of(spark, d)
    got = {r.id: r.cluster for r in linkage.cut(pairs, "complete", k=4).collect()}
    want = {r.id: r.cluster for r in cluster.agglomerative(pairs, "complete", k=4).collect()}
    assert got == want and len(set(got.values())) == 4
    merges = cluster.linkage_merges(d, "average")
    order = lambda i: [i] if i < 20 else [*order(merges[i - 20][0]), *order(merges[i - 20][1])]
    tree = linkage.dendrogram(pairs)
    assert [r.id // 10 for r in linkage.leaf_order(tree).orderBy("place").collect()] == order(38)
    rows = {r.node: r for r in tree.collect()}
    assert len(rows) == 39 and sum(r.parent is None for r in rows.values()) == 1
    assert all(r.parent is None or rows[r.parent].height >= r.height for r in rows.values())


def test_linkage_of_ties_and_of_no_pairs(spark):
    d = np.ones((5, 5)) - np.eye(5)
    steps = linkage.linkage(pairs_of(spark, d)).orderBy("step").collect()
    assert [r.height for r in steps] == pytest.approx([1.0] * 4) and steps[-1].size == 5
    assert linkage.linkage(pairs_of(spark, d[:0, :0])).collect() == []
