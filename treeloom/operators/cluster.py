"""Clustering over a table of pairwise distances (a_id, b_id, dist), both directions without the diagonal.

Threshold graphs, DBSCAN, single linkage and k-medoids steps are joins and aggregates at any size. Average and complete
linkage, scaling and the spectral split need the matrix as a whole: one task, for at most MATRIX_ROWS documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import saved
from .graph import components

MATRIX_ROWS = 3000


def eps_graph(pairs: DataFrame, eps: float) -> DataFrame:
    return pairs.filter(F.col("dist") <= eps)


def _named(ids: DataFrame, groups: DataFrame) -> DataFrame:
    """Every id's component, its own id where it has no link."""
    return ids.join(groups, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def dbscan(ids: DataFrame, pairs: DataFrame, eps: float = 0.3, min_samples: int = 3) -> DataFrame:
    """(id, cluster): the smallest core id of the cluster, -1 for noise. A border point joins the lowest cluster near it."""
    near = eps_graph(pairs, eps)
    core = near.groupBy("a_id").agg(F.count("*").alias("n")).filter(F.col("n") + 1 >= min_samples).select(F.col("a_id").alias("id"))
    among = near.join(core.withColumnRenamed("id", "a_id"), "a_id", "left_semi").join(core.withColumnRenamed("id", "b_id"), "b_id", "left_semi")
    groups = _named(core, components(among.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))))
    border = near.join(groups, near.b_id == groups.id).groupBy("a_id").agg(F.min("component").alias("near"))
    out = ids.join(groups, "id", "left").join(border, ids.id == border.a_id, "left")
    return out.select("id", F.coalesce("component", "near", F.lit(-1)).alias("cluster"))


def single_linkage(ids: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Merges below the threshold are the components of the pairs below it."""
    links = pairs.filter(F.col("dist") < threshold).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return _named(ids, components(links)).withColumnRenamed("component", "cluster")


def nearest_medoid(pairs: DataFrame, medoids: DataFrame) -> DataFrame:
    """(id, medoid): medoids belong to themselves; ties go to the lowest medoid."""
    m = medoids.select(F.col("id").alias("b_id"))
    other = pairs.join(F.broadcast(m), "b_id").join(m.withColumnRenamed("b_id", "a_id"), "a_id", "left_anti")
    return other.groupBy(F.col("a_id").alias("id")).agg(F.min(F.struct("dist", "b_id"))["b_id"].alias("medoid")).unionByName(medoids.select("id", F.col("id").alias("medoid")))


def medoids_of(pairs: DataFrame, assigned: DataFrame, label: str = "medoid") -> DataFrame:
    """(label, id): the member with the least sum of distances to its cluster, ties to the lowest id."""
    a, b = assigned.select(F.col("id").alias("a_id"), F.col(label)), assigned.select(F.col("id").alias("b_id"), F.col(label).alias("other"))
    sums = a.join(pairs, "a_id", "left").join(b, "b_id", "left").groupBy("a_id", label).agg(F.round(F.sum(F.when(F.col("other") == F.col(label), F.col("dist")).otherwise(0.0)), 9).alias("total"))
    return sums.groupBy(label).agg(F.min(F.struct("total", "a_id"))["a_id"].alias("id"))


def kmedoids_from(pairs: DataFrame, medoids: DataFrame, rounds: int) -> DataFrame:
    """Alternating assignment and update from given medoids, for a fixed number of rounds."""
    for _ in range(rounds):
        medoids = saved(medoids_of(pairs, saved(nearest_medoid(pairs, medoids), "assigned")).select("id"), "medoids")
    return nearest_medoid(pairs, medoids)


def _matrix(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    ids = np.unique(np.concatenate([frame["a_id"], frame["b_id"]]))
    if len(ids) > MATRIX_ROWS:
        raise ValueError(f"{len(ids)} documents: more than {MATRIX_ROWS} in a matrix that one task holds")
    d = np.zeros((len(ids), len(ids)))
    d[np.searchsorted(ids, frame["a_id"]), np.searchsorted(ids, frame["b_id"])] = frame["dist"]
    return ids, d


def _whole(pairs: DataFrame, kernel, schema: str) -> DataFrame:
    return pairs.select("a_id", "b_id", "dist", F.lit(0).alias("all")).groupBy("all").applyInPandas(lambda frame: kernel(*_matrix(frame)), schema)


def linkage_merges(d: np.ndarray, method: str) -> list[tuple[int, int, float, int]]:
    """(left, right, height, size) of each merge, lowest first; new clusters are numbered from n on."""
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    name, size, live, out = list(range(n)), np.ones(n), np.ones(n, bool), []
    for step in range(n - 1):
        i, j = divmod(int(np.argmin(np.where(live[:, None] & live[None, :], d, np.inf))), n)
        i, j = min(i, j), max(i, j)
        out.append((*sorted((name[i], name[j])), float(d[i, j]), int(size[i] + size[j])))
        both = {"single": np.minimum(d[i], d[j]), "complete": np.maximum(d[i], d[j]), "average": (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])}[method]
        both[i] = np.inf
        d[i], d[:, i], live[j], size[i], name[i] = both, both, False, size[i] + size[j], n + step
    return out


def linkage(pairs: DataFrame, method: str = "average") -> DataFrame:
    """(step, left, right, height, size)."""
    def kernel(ids: np.ndarray, d: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame([(k, *m) for k, m in enumerate(linkage_merges(d, method))], columns=["step", "left", "right", "height", "size"])

    return _whole(pairs, kernel, "step bigint, left bigint, right bigint, height double, size bigint")


def agglomerative(pairs: DataFrame, method: str = "average", threshold: float | None = None, k: int | None = None) -> DataFrame:
    """(id, cluster), named by smallest member: merges below a height, or as many as leave k clusters."""
    def kernel(ids: np.ndarray, d: np.ndarray) -> pd.DataFrame:
        merges = linkage_merges(d, method)
        kept = merges[: len(ids) - k] if k else [m for m in merges if m[2] < threshold]
        member = {i: [i] for i in range(len(ids))}
        for step, (a, b, _, _) in enumerate(kept):
            member[len(ids) + step] = member.pop(a) + member.pop(b)
        return pd.DataFrame([(ids[i], ids[min(m)]) for m in member.values() for i in m], columns=["id", "cluster"])

    return _whole(pairs, kernel, "id bigint, cluster bigint")


def classical_scaling(d: np.ndarray, dims: int) -> np.ndarray:
    n = len(d)
    centre = np.eye(n) - 1 / n
    value, vector = np.linalg.eigh(-0.5 * centre @ (d * d) @ centre)
    best = np.argsort(-value)[:dims]
    return vector[:, best] * np.sqrt(np.maximum(value[best], 0))


def smacof(d: np.ndarray, dims: int, rounds: int = 300) -> np.ndarray:
    """Coordinates by majorisation from the classical solution; stress never grows."""
    x = classical_scaling(d, dims)
    for _ in range(rounds):
        e = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        b = -np.divide(d, e, out=np.zeros_like(d), where=e > 1e-12)
        np.fill_diagonal(b, 0)
        np.fill_diagonal(b, -b.sum(1))
        new = b @ x / len(d)
        if np.abs(new - x).max() < 1e-9:
            return new
        x = new
    return x


def mds(pairs: DataFrame, dims: int = 2) -> DataFrame:
    def kernel(ids: np.ndarray, d: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"id": ids, "coords": smacof(d, dims).tolist()})

    return _whole(pairs, kernel, "id bigint, coords array<double>")


def kmeans(x: np.ndarray, k: int, seed: int, starts: int = 10) -> np.ndarray:
    rng, best = np.random.default_rng(seed), None
    for _ in range(starts):
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(100):
            label = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
            c = np.array([x[label == j].mean(0) if (label == j).any() else x[rng.integers(len(x))] for j in range(k)])
        cost = ((x - c[label]) ** 2).sum()
        if best is None or cost < best[0]:
            best = cost, label
    return best[1]


def _by_smallest(ids: np.ndarray, label: np.ndarray) -> pd.DataFrame:
    names = {j: ids[label == j].min() for j in np.unique(label)}
    return pd.DataFrame({"id": ids, "cluster": [names[j] for j in label]})


def kmeans_on_scaling(pairs: DataFrame, k: int, dims: int = 10, seed: int = 42) -> DataFrame:
    def kernel(ids: np.ndarray, d: np.ndarray) -> pd.DataFrame:
        return _by_smallest(ids, kmeans(smacof(d / max(d.max(), 1e-12), min(dims, len(ids) - 1)), k, seed))

    return _whole(pairs, kernel, "id bigint, cluster bigint")


def spectral(pairs: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """On similarities 1 - dist, clipped to [0, 1]: normalised Laplacian, then k-means on its lowest eigenvectors."""
    def kernel(ids: np.ndarray, d: np.ndarray) -> pd.DataFrame:
        s = np.clip(1 - d, 0, 1)
        root = 1 / np.sqrt(s.sum(1))
        _, vector = np.linalg.eigh(np.eye(len(s)) - root[:, None] * s * root[None])
        return _by_smallest(ids, kmeans(vector[:, :k] * root[:, None], k, seed))

    return _whole(pairs, kernel, "id bigint, cluster bigint")


def kmedoids_seeded(pairs: DataFrame, k: int, starts: int = 10, seed: int = 42) -> DataFrame:
    """The cheapest of several random starts, each in a task of its own."""
    def kernel(frame: pd.DataFrame) -> pd.DataFrame:
        ids, d = _matrix(frame)
        start = int(frame["start"].iloc[0])
        medoids = np.sort(np.random.default_rng(seed + start).choice(len(ids), k, replace=False))
        for _ in range(300):
            label = d[:, medoids].argmin(1)
            new = np.array([(m := np.flatnonzero(label == j))[d[np.ix_(m, m)].sum(1).argmin()] for j in range(k)])
            if (np.sort(new) == medoids).all():
                break
            medoids = np.sort(new)
        near = d[:, medoids]
        return pd.DataFrame({"id": ids, "medoid": ids[medoids[near.argmin(1)]], "cost": near.min(1).sum(), "start": start})

    runs = pairs.select("a_id", "b_id", "dist").crossJoin(F.broadcast(pairs.sparkSession.range(starts).withColumnRenamed("id", "start")))
    out = runs.groupBy("start").applyInPandas(kernel, "id bigint, medoid bigint, cost double, start bigint")
    best = out.groupBy().agg(F.min(F.struct("cost", "start"))["start"].alias("start"))
    return out.join(F.broadcast(best), "start", "left_semi").select("id", "medoid")
