"""Cuts out of matrices, rankings of them, and measures of whole documents by their top-level keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import amplitudes


def name_key(name: Column) -> Column:
    """Names are the same if they are after trimming, in lower case."""
    return F.lower(F.trim(name))


def sliced(matrix: DataFrame, names: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of matrix (a_id, b_id, ...) of which both names are wanted. names: (id, name), wanted: (name)."""
    ids = names.join(wanted.select(name_key(F.col("name")).alias("k")), name_key(F.col("name")) == F.col("k"), "left_semi")
    for s in ("a_id", "b_id"):
        matrix = matrix.join(ids.select(F.col("id").alias(s)), s, "left_semi")
    return matrix


def unknown(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted names that nothing has."""
    return wanted.join(names.select(name_key(F.col("name")).alias("k")), name_key(F.col("name")) == F.col("k"), "left_anti")


def scaled_by_largest(matrix: DataFrame, value: str) -> DataFrame:
    """Values over the largest of all; as they are if that is not above 0."""
    largest = matrix.agg(F.max(value).alias("largest"))
    return matrix.crossJoin(F.broadcast(largest)).withColumn(value, F.when(F.col("largest") > 0, F.col(value) / F.col("largest")).otherwise(F.col(value))).drop("largest")  # one row


def extremes(matrix: DataFrame, value: str) -> DataFrame:
    """Of each a_id the others most and least like it (ties: the smaller id), and its mean likeness."""
    v = F.col(value)
    return matrix.filter("a_id <> b_id").groupBy("a_id").agg(F.max_by("b_id", F.struct(v, -F.col("b_id"))).alias("closest"), F.min_by("b_id", F.struct(v, "b_id")).alias("farthest"), F.avg(v).alias("mean"))


def cluster_counts(assigned: DataFrame, cluster: str) -> DataFrame:
    """One row: documents, clusters without noise (-1), and noise."""
    c = F.col(cluster)
    return assigned.agg(F.count("*").alias("n"), F.count_distinct(F.when(c >= 0, c)).alias("clusters"), F.count_if(c < 0).alias("outliers"))


def clamped_k(k: Column, n: Column) -> Column:
    """A number of clusters that n documents allow."""
    return F.greatest(F.lit(2), F.least(k, n - 1))


def _keys(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"a.{k}").cast("string").alias("x"), F.col(f"b.{k}").cast("string").alias("y")) for k in sorted(keys)]))
    return pairs.select("a_id", "b_id", rows.alias("r")).select("a_id", "b_id", "r.*")


def key_overlap(pairs: DataFrame, keys: Sequence[str], word: str) -> DataFrame:
    """For each pair (a_id, a, b_id, b) of structs and each key: distinct words of both values, shared ones, and their Jaccard."""
    x, y = (F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(word), F.lit(0))) for c in ("x", "y"))
    rows = _keys(pairs, keys).select("a_id", "b_id", "key", x.alias("x"), y.alias("y"))
    n, m, both = F.size("x"), F.size("y"), F.size(F.array_intersect("x", "y"))
    jaccard = F.when(n + m - both == 0, F.lit(1.0)).otherwise(both / (n + m - both))
    return rows.select("a_id", "b_id", "key", n.cast("long").alias("a_count"), m.cast("long").alias("b_count"), both.cast("long").alias("shared_count"), F.round(jaccard, 4).alias("jaccard"))


def value_ops(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each pair and key insert, delete, update or match. A null is a key that is not there; one that both lack gives no row."""
    x, y = F.col("x"), F.col("y")
    op = F.when(x.isNull(), "insert").when(y.isNull(), "delete").when(x == y, "match").otherwise("update")
    rows = _keys(pairs, keys).filter("x is not null or y is not null").withColumn("op", op)
    cut = lambda c: F.left(F.coalesce(c, F.lit("")), F.when(F.col("op") == "match", 80).otherwise(120))
    kind = F.when(F.col("op").isin("insert", "delete"), "structural").otherwise("semantic")
    return rows.select("a_id", "b_id", F.col("key").alias("path"), "op", cut(x).alias("from_val"), cut(y).alias("to_val"), kind.alias("dimension"))


def op_counters(ops: DataFrame) -> DataFrame:
    count = lambda k, name: F.count_if(F.col("op") == k).alias(name)
    return ops.groupBy("a_id", "b_id").agg(count("match", "same"), count("update", "differ"), count("delete", "only_a"), count("insert", "only_b"))


def without_contained(items: Column) -> Column:
    """Items that are in no other item as a part of it, whatever the case; of equal ones the first."""
    inside = lambda x: F.exists(items, lambda y: (F.lower(y) != F.lower(x)) & F.contains(F.lower(y), F.lower(x)))
    return F.array_distinct(F.filter(items, lambda x: ~inside(x)))


def chain_skeleton(steps: Column) -> Column:
    """Tags of a tree that is one chain: opened from the root down, closed from the leaf up."""
    return F.concat(F.transform(steps, lambda s: F.concat(F.lit("<"), s, F.lit(">"))), F.transform(F.reverse(steps), lambda s: F.concat(F.lit("</"), s, F.lit(">"))))


def spectral_likeness(pairs: DataFrame) -> DataFrame:
    """(a_id, b_id, similarity) of pairs with skeletons a and b: the cosine of their spectra's magnitudes.

    A tag's signal is its number among the pair's tags by first appearance, negative where it closes; the shorter
    skeleton is filled with zeros. Two empty ones have likeness 0.
    """
    opens = F.array_distinct(F.filter(F.concat("a", "b"), lambda t: ~t.startswith("</")))
    known = pairs.select("a_id", "b_id", "a", "b", opens.alias("opens"), F.greatest(F.size("a"), F.size("b")).alias("most"))
    place = lambda t: F.array_position("opens", t)
    signal = lambda c: F.transform(c, lambda t: F.when(t.startswith("</"), -place(F.concat(F.lit("<"), F.substring(t, 3, 1 << 30)))).otherwise(place(t)).cast("double"))
    full = lambda c: F.concat(signal(c), F.array_repeat(F.lit(0.0), F.col("most") - F.size(c)))
    sides = known.select("a_id", "b_id", F.explode(F.array(F.struct(F.lit("a").alias("side"), full("a").alias("x")), F.struct(F.lit("b").alias("side"), full("b").alias("x")))).alias("s"))
    rows = sides.select(F.struct("a_id", "b_id", "s.side").alias("id"), F.posexplode("s.x").alias("t", "x"))
    got = amplitudes(rows).select("id.a_id", "id.b_id", "id.side", "k", "amplitude")
    both = got.groupBy("a_id", "b_id", "k").agg(*[F.sum(F.when(F.col("side") == s, F.col("amplitude"))).alias(s) for s in "ab"])
    norm = F.sqrt(F.sum(F.col("a") * F.col("a"))) * F.sqrt(F.sum(F.col("b") * F.col("b")))
    likeness = both.groupBy("a_id", "b_id").agg(F.sum(F.col("a") * F.col("b")).alias("dot"), norm.alias("norm"))
    out = pairs.select("a_id", "b_id").join(likeness, ["a_id", "b_id"], "left")
    return out.select("a_id", "b_id", F.when(F.col("norm") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("dot") / F.col("norm")))).otherwise(F.lit(0.0)).alias("similarity"))
