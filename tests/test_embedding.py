"""Landmark scaling and the spectral split against the whole matrix in numpy."""

import numpy as np
import pytest

from treeloom.operators import cluster, embedding


def pairs_of(spark, d):
    return spark.createDataFrame([(i, j, float(d[i, j])) for i in range(len(d)) for j in range(i)], "a_id long, b_id long, dist double")


def groups(n, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) * 0.05 + np.array([[0, 0], [0.5, 0], [0, 0.6]])[np.arange(n) % 3]
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def test_scaling_by_landmarks(spark):
    d = groups(60)
    pairs = pairs_of(spark, d)
    whole = {r.id: r.coords for r in embedding.landmark_scaling(pairs).collect()}
    x = np.array([whole[i] for i in range(60)])
    assert np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) == pytest.approx(d, abs=1e-6)  # points of a plane
    noisy = np.abs(d + np.random.default_rng(2).normal(size=d.shape) * 0.02)
    pairs = pairs_of(spark, noisy)
    few, all_ = (embedding.stress(pairs, embedding.landmark_scaling(pairs, landmarks=m)).first().stress for m in (12, 60))
    assert few <= 1.5 * all_ and few < 0.2
    assert embedding.landmark_scaling(pairs.limit(0)).collect() == []


def test_clusters_of_scaling_and_spectral(spark):
    d = groups(45)
    pairs = pairs_of(spark, d)
    want = {i: i % 3 for i in range(45)}
    assert {r.id: r.cluster for r in embedding.kmeans_on_scaling(pairs, 3, dims=2).collect()} == want
    assert {r.id: r.cluster for r in embedding.spectral(pairs, 3).collect()} == want == {r.id: r.cluster for r in cluster.spectral(embedding.both_ways(pairs), 3).collect()}
