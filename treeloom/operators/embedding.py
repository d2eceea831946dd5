"""Coordinates and spectral clusters of a distance table, without the matrix in one place.

Landmark scaling solves the classical problem for a bounded number of landmarks and places every document by its
distances to them, a sum over a join. With as many landmarks as documents that is classical scaling itself. The spectral
split iterates a block of k vectors, each step a join of the pairs with the vectors, an aggregate, and a k x k matrix
on the driver that makes the vectors orthogonal again. Both end in Spark's own k-means.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import saved


def ids_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a_id").alias("id")).unionByName(pairs.select(F.col("b_id").alias("id"))).distinct()


def both_ways(pairs: DataFrame) -> DataFrame:
    """(a_id, b_id, dist) in both directions, once each."""
    there = pairs.filter("a_id <> b_id").select("a_id", "b_id", F.col("dist").cast("double").alias("dist"))
    back = there.select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"), "dist")
    return there.unionByName(back).groupBy("a_id", "b_id").agg(F.min("dist").alias("dist"))


def landmark_scaling(pairs: DataFrame, dims: int = 2, landmarks: int = 256, seed: int = 42) -> DataFrame:
    """(id, coords) of the documents of a table of distances. Landmarks are a documented, bounded sample: the smallest hashes of the ids.

    Only the distances among landmarks, at most landmarks squared, reach the driver. A document that lacks a distance to
    some landmark is placed by the others, as if it were at that one's mean distance. Each axis points so that the
    landmark with the largest share of it is positive.
    """
    pairs = saved(both_ways(pairs), "pairs")
    chosen = [r.id for r in ids_of(pairs).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(landmarks).collect()]
    if not chosen:
        return pairs.select(F.col("a_id").alias("id"), F.array(F.lit(0.0)).alias("coords")).limit(0)
    at = {x: i for i, x in enumerate(chosen)}
    spark = pairs.sparkSession
    marks = spark.createDataFrame([(x,) for x in chosen], f"b_id {dict(pairs.dtypes)['b_id']}")
    to_marks = pairs.join(F.broadcast(marks), "b_id", "left_semi")  # at most `landmarks` rows
    among = to_marks.join(F.broadcast(marks.withColumnRenamed("b_id", "a_id")), "a_id", "left_semi").collect()
    square = np.zeros((len(chosen), len(chosen)))
    for r in among:
        square[at[r.a_id], at[r.b_id]] = r.dist**2
    centre = np.eye(len(chosen)) - 1 / len(chosen)
    value, vector = np.linalg.eigh(-0.5 * centre @ square @ centre)
    best = np.argsort(-value)[:dims]
    value, vector = np.maximum(value[best], 0), vector[:, best]
    vector = vector * np.where(vector[np.abs(vector).argmax(0), np.arange(len(best))] < 0, -1, 1)
    share = np.divide(-0.5 * vector, np.sqrt(value), out=np.zeros_like(vector), where=value > 1e-12)
    rows = [(x, float(square[i].mean()), share[i].tolist()) for i, x in enumerate(chosen)]
    table = spark.createDataFrame(rows, f"b_id {dict(pairs.dtypes)['b_id']}, mean double, share array<double>")
    own = table.select(F.col("b_id").alias("a_id"), "b_id", F.lit(0.0).alias("dist"))
    terms = to_marks.select("a_id", "b_id", "dist").unionByName(own).join(F.broadcast(table), "b_id").withColumn("gap", F.col("dist") * F.col("dist") - F.col("mean"))
    sums = terms.groupBy(F.col("a_id").alias("id")).agg(*[F.sum(F.col("gap") * F.get("share", F.lit(k))).alias(f"c{k}") for k in range(len(best))])
    return sums.select("id", F.array(*[f"c{k}" for k in range(len(best))]).alias("coords"))


def stress(pairs: DataFrame, coords: DataFrame) -> DataFrame:
    """A row (stress): the root of the squared gaps of distances over the squared distances."""
    a, b = (coords.select(F.col("id").alias(f"{s}_id"), F.col("coords").alias(s)) for s in "ab")
    apart = F.sqrt(F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    both = both_ways(pairs).filter("a_id < b_id").join(a, "a_id").join(b, "b_id")
    return both.agg(F.sqrt(F.sum(F.pow(apart - F.col("dist"), F.lit(2.0))) / F.sum(F.col("dist") * F.col("dist"))).alias("stress"))


def clustered(points: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(id, cluster) of (id, coords) by k-means, named by the smallest member; of eight seeds the cheapest."""
    rows = saved(points.select("id", array_to_vector("coords").alias("features")), "points")
    fits = [KMeans(k=k, seed=seed + i, maxIter=100, tol=1e-9).fit(rows) for i in range(8)]
    model = min(fits, key=lambda m: m.summary.trainingCost)
    found = saved(model.transform(rows).select("id", "prediction"), "clusters")
    least = found.groupBy("prediction").agg(F.min("id").alias("cluster"))
    return found.join(least, "prediction").select("id", "cluster")


def kmeans_on_scaling(pairs: DataFrame, k: int, dims: int = 10, landmarks: int = 256, seed: int = 42) -> DataFrame:
    return clustered(landmark_scaling(pairs, dims, landmarks, seed), k, seed)


def spectral_vectors(pairs: DataFrame, k: int, seed: int = 42, rounds: int = 30, tolerance: float = 1e-4) -> DataFrame:
    """(id, coords): the k vectors that the normalised similarities 1 - dist, clipped to [0, 1], stretch most, over the root of a document's similarities.

    The matrix is moved by one, so that what is largest is also what is largest in size. Rounds end when the block's
    k x k image in its own coordinates settles, or after `rounds`.
    """
    alike = both_ways(pairs).select("a_id", "b_id", F.least(F.greatest(1 - F.col("dist"), F.lit(0.0)), F.lit(1.0)).alias("s"))
    own = ids_of(pairs).select(F.col("id").alias("a_id"), F.col("id").alias("b_id"), F.lit(1.0).alias("s"))
    alike = saved(alike.filter("s > 0").unionByName(own), "alike")
    total = saved(alike.groupBy(F.col("a_id").alias("id")).agg(F.sum("s").alias("total")), "totals")
    one, two = (total.select(F.col("id").alias(f"{s}_id"), F.col("total").alias(f"t_{s}")) for s in "ab")
    norm = saved(alike.join(one, "a_id").join(two, "b_id").select("a_id", "b_id", (F.col("s") / F.sqrt(F.col("t_a") * F.col("t_b"))).alias("m")), "normalised")
    names = [f"v{j}" for j in range(k)]
    start = [F.sqrt("total").alias("v0"), *[((F.pmod(F.xxhash64("id", F.lit(seed + j)), F.lit(1 << 20)) / float(1 << 20)) - 0.5).alias(f"v{j}") for j in range(1, k)]]
    block, before = saved(total.select("id", *start), "block"), None
    for _ in range(rounds):
        gram = _products(block, names, names)
        upper = np.linalg.cholesky(gram + 1e-14 * np.trace(gram) * np.eye(k))
        turn = np.linalg.inv(upper).T
        block = block.select("id", *_turned(names, turn))
        image = norm.join(block.withColumnRenamed("id", "b_id"), "b_id").groupBy(F.col("a_id").alias("id")).agg(*[F.sum(F.col("m") * F.col(n)).alias(f"w_{n}") for n in names])
        both = saved(block.join(image, "id"), "image")
        inner = _products(both, names, [f"w_{n}" for n in names])
        block = both.select("id", *[(F.col(n) + F.col(f"w_{n}")).alias(n) for n in names])
        value = np.sort(np.linalg.eigvalsh((inner + inner.T) / 2))
        if before is not None and np.abs(value - before).max() < tolerance:
            break
        before = value
    _, turn = np.linalg.eigh((inner + inner.T) / 2)
    turned = both.select("id", *_turned(names, turn[:, ::-1]))
    return turned.join(total, "id").select("id", F.array(*[F.col(n) / F.sqrt("total") for n in names]).alias("coords"))


def _products(rows: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
    """The inner products of columns with columns: one row of len(left) x len(right) sums."""
    sums = rows.agg(*[F.sum(F.col(x) * F.col(y)) for x in left for y in right]).first()
    return np.array(sums, float).reshape(len(left), len(right))


def _turned(names: list[str], turn: np.ndarray) -> list[Column]:
    return [sum((F.col(n) * float(turn[i, j]) for i, n in enumerate(names)), F.lit(0.0)).alias(names[j]) for j in range(len(names))]


def spectral(pairs: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(id, cluster): k-means on the spectral vectors."""
    return clustered(spectral_vectors(pairs, k, seed), k, seed)
