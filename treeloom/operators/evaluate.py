"""Scores of a clustering (id, cluster) over distances (a_id, b_id, dist), both directions without the diagonal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import medoids_of


def _real(assigned: DataFrame, noise: int | None) -> DataFrame:
    return assigned if noise is None else assigned.filter(F.col("cluster") != noise)


def _labelled(pairs: DataFrame, assigned: DataFrame) -> DataFrame:
    a = assigned.select(F.col("id").alias("a_id"), F.col("cluster").alias("ca"))
    b = assigned.select(F.col("id").alias("b_id"), F.col("cluster").alias("cb"))
    return pairs.join(a, "a_id").join(b, "b_id")


def silhouette(pairs: DataFrame, assigned: DataFrame, noise: int | None = -1) -> DataFrame:
    """(id, silhouette); a cluster of one scores 0; no rows with fewer than two clusters."""
    means = _labelled(pairs, _real(assigned, noise)).groupBy("a_id", "ca", "cb").agg(F.avg("dist").alias("m"))
    per = means.groupBy(F.col("a_id").alias("id")).agg(F.max(F.when(F.col("ca") == F.col("cb"), F.col("m"))).alias("own"), F.min(F.when(F.col("ca") != F.col("cb"), F.col("m"))).alias("other"))
    most = F.greatest("own", "other")
    return per.filter("other is not null").select("id", F.when(F.col("own").isNull() | (most == 0), F.lit(0.0)).otherwise((F.col("other") - F.col("own")) / most).alias("silhouette"))


def k_sweep(pairs: DataFrame, cuts: DataFrame) -> DataFrame:
    """(k, n_clusters, silhouette, intra) of clusterings (k, id, cluster): mean silhouette, null below two clusters, and mean distance within clusters, 0 where all stand alone.

    All clusterings share one join with the distances and one aggregation.
    """
    a = cuts.select("k", F.col("id").alias("a_id"), F.col("cluster").alias("ca"))
    b = cuts.select("k", F.col("id").alias("b_id"), F.col("cluster").alias("cb"))
    cells = pairs.join(a, "a_id").join(b, ["k", "b_id"]).groupBy("k", "a_id", "ca", "cb").agg(F.sum("dist").alias("total"), F.count("*").alias("n"))
    same = F.col("ca") == F.col("cb")
    mean = F.col("total") / F.col("n")
    per = cells.groupBy("k", "a_id").agg(F.max(F.when(same, mean)).alias("own"), F.min(F.when(~same, mean)).alias("other"), F.sum(F.when(same, F.col("total"))).alias("inner"), F.sum(F.when(same, F.col("n"))).alias("n"))
    most = F.greatest("own", "other")
    s = F.when(F.col("other").isNotNull(), F.when(F.col("own").isNull() | (most == 0), F.lit(0.0)).otherwise((F.col("other") - F.col("own")) / most))
    scores = per.groupBy("k").agg(F.avg(s).alias("silhouette"), F.coalesce(F.sum("inner") / F.sum("n"), F.lit(0.0)).alias("intra"))
    sizes = cuts.groupBy("k").agg(F.countDistinct("cluster").alias("n_clusters"))
    return sizes.join(scores, "k", "left").select("k", "n_clusters", "silhouette", "intra")


def best_k(sweep: DataFrame) -> DataFrame:
    """One row: the k of the greatest silhouette, of several the smallest."""
    return sweep.filter("silhouette is not null").agg(F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("k"), F.max("silhouette").alias("silhouette"))


def davies_bouldin_medoid(pairs: DataFrame, assigned: DataFrame, noise: int | None = -1) -> DataFrame:
    """One row: mean over clusters of the worst ratio of scatters to medoid distance; medoids count in the scatter."""
    real = _real(assigned, noise)
    medoids = medoids_of(pairs, real, "cluster").withColumnRenamed("id", "m")
    to = real.join(medoids, "cluster").join(pairs, (F.col("id") == pairs.a_id) & (F.col("m") == pairs.b_id), "left")
    scatter = to.groupBy("cluster", "m").agg(F.avg(F.coalesce("dist", F.lit(0.0))).alias("s"))
    x, y = (scatter.select(*[F.col(c).alias(f"{c}_{k}") for c in ("cluster", "m", "s")]) for k in "xy")
    both = x.join(y, F.col("cluster_x") != F.col("cluster_y")).join(pairs, (F.col("m_x") == pairs.a_id) & (F.col("m_y") == pairs.b_id)).filter("dist > 0")
    return both.groupBy("cluster_x").agg(F.max((F.col("s_x") + F.col("s_y")) / F.col("dist")).alias("r")).agg(F.avg("r").alias("davies_bouldin"))


def euclidean_scores(points: DataFrame) -> DataFrame:
    """One row of Davies-Bouldin and Calinski-Harabasz of points (id, cluster, x, y)."""
    centre = points.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    whole = points.agg(F.avg("x").alias("gx"), F.avg("y").alias("gy"), F.count("*").alias("total"))
    gap2 = F.pow(F.col("x") - F.col("cx"), F.lit(2)) + F.pow(F.col("y") - F.col("cy"), F.lit(2))
    spread = points.join(centre, "cluster").groupBy("cluster", "n", "cx", "cy").agg(F.avg(F.sqrt(gap2)).alias("s"), F.sum(gap2).alias("w"))
    a, b = (spread.select(*[F.col(c).alias(f"{c}_{k}") for c in ("cluster", "cx", "cy", "s")]) for k in "ab")
    far = F.sqrt(F.pow(F.col("cx_a") - F.col("cx_b"), F.lit(2)) + F.pow(F.col("cy_a") - F.col("cy_b"), F.lit(2)))
    db = a.join(b, F.col("cluster_a") != F.col("cluster_b")).withColumn("far", far).filter("far > 0").groupBy("cluster_a").agg(F.max((F.col("s_a") + F.col("s_b")) / F.col("far")).alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    between = F.col("n") * (F.pow(F.col("cx") - F.col("gx"), F.lit(2)) + F.pow(F.col("cy") - F.col("gy"), F.lit(2)))
    ch = spread.crossJoin(F.broadcast(whole)).agg(F.sum(between).alias("b"), F.sum("w").alias("w"), F.count("*").alias("k"), F.max("total").alias("t"))
    return db.crossJoin(ch).select("davies_bouldin", ((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("t") - F.col("k")))).alias("calinski_harabasz"))


def summary(pairs: DataFrame, assigned: DataFrame) -> DataFrame:
    """Per cluster: size, mean and largest distance within, medoid, members. A cluster of one has zeros."""
    inner = _labelled(pairs, assigned).filter("ca = cb").groupBy(F.col("ca").alias("cluster")).agg(F.avg("dist").alias("mean_dist"), F.max("dist").alias("diameter"))
    size = assigned.groupBy("cluster").agg(F.count("*").alias("size"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("members"))
    medoid = medoids_of(pairs, assigned, "cluster").withColumnRenamed("id", "medoid")
    return size.join(inner, "cluster", "left").join(medoid, "cluster").select("cluster", "size", F.coalesce("mean_dist", F.lit(0.0)).alias("mean_dist"), F.coalesce("diameter", F.lit(0.0)).alias("diameter"), "medoid", "members")


def external(assigned: DataFrame, reference: DataFrame) -> DataFrame:
    """One row of purity, entropy (log2, by size) and F-value against reference (id, class)."""
    cell = assigned.join(reference, "id").groupBy("cluster", "class").agg(F.count("*").alias("n"))
    cell = cell.withColumn("nc", F.sum("n").over(Window.partitionBy("cluster"))).withColumn("nk", F.sum("n").over(Window.partitionBy("class"))).withColumn("f", 2 * F.col("n") / (F.col("nc") + F.col("nk")))
    total = cell.agg(F.sum("n").alias("total"))
    clusters = cell.groupBy("cluster").agg(F.max("n").alias("top"), F.sum(-F.col("n") * F.log2(F.col("n") / F.col("nc"))).alias("h"))
    classes = cell.groupBy("class", "nk").agg(F.max("f").alias("best"))
    return clusters.agg(F.sum("top").alias("top"), F.sum("h").alias("h")).crossJoin(classes.agg(F.sum(F.col("best") * F.col("nk")).alias("bf"))).crossJoin(total).select((F.col("top") / F.col("total")).alias("purity"), (F.col("h") / F.col("total")).alias("entropy"), (F.col("bf") / F.col("total")).alias("f_value"))
