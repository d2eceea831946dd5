"""Set, multiset and vector likeness of feature counts, each made of sums over an outer join or over shared features.

Counts are rows (id, feature, tf). Sums that need both sides run over the inner join on the feature; what only one
side has enters through totals per document, so no join grows beyond the features that pairs share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pairs import adjacent, batched, column


def counts(rows: DataFrame, id_col: str, feature: str) -> DataFrame:
    return rows.groupBy(F.col(id_col).alias("id"), F.col(feature).alias("feature")).agg(F.count("*").alias("tf"))


def tf_variants(tf: DataFrame) -> DataFrame:
    """raw, by the document's largest, and ln(1 + f)."""
    largest = F.max("tf").over(Window.partitionBy("id"))
    return tf.select("id", "feature", F.col("tf").cast("double").alias("tf_raw"), (F.col("tf") / largest).alias("tf_max"), F.log1p("tf").alias("tf_log"))


def totals(tf: DataFrame) -> DataFrame:
    return tf.groupBy("id").agg(F.count("*").alias("n"), F.sum("tf").alias("s"), F.sum(F.col("tf") * F.col("tf")).alias("q"))


def shared(tf: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each pair (a_id, b_id): totals of both sides and sums over the features that both have."""
    t = totals(tf)
    x, y = (tf.select(F.col("id").alias(f"{s}_id"), "feature", F.col("tf").alias(f"tf_{s}")) for s in "ab")
    both = pairs.join(x, "a_id").join(y, ["b_id", "feature"]).groupBy("a_id", "b_id").agg(F.count("*").alias("common"), F.sum(F.least("tf_a", "tf_b")).alias("low"), F.sum(F.col("tf_a") * F.col("tf_b")).alias("dot"), F.sum(F.abs(F.col("tf_a") - F.col("tf_b"))).alias("gap"), F.sum(F.col("tf_a") + F.col("tf_b")).alias("met"))
    for s in "ab":
        pairs = pairs.join(t.select(F.col("id").alias(f"{s}_id"), *[F.col(c).alias(f"{c}_{s}") for c in "nsq"]), f"{s}_id", "left")
    out = pairs.join(both, ["a_id", "b_id"], "left")
    names = [c for c in out.columns if c not in ("a_id", "b_id")]
    return out.select("a_id", "b_id", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names])


def shared_words(docs: DataFrame) -> DataFrame:
    """shared of each row of (id, words) and the one whose id is one more: words are counted where they are, pairs meet as rows of counts. Ids are unique."""

    @F.arrow_udf("struct<word:array<string>,tf:array<long>>")
    def counted(words: pa.Array) -> pa.Array:
        known = words.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(words)), np.nan_to_num(words.value_lengths().to_numpy(zero_copy_only=False)).astype(int))
        size = max(len(known.dictionary), 1)
        key, times = np.unique(row * np.int64(size) + known.indices.to_numpy(), return_counts=True)
        ends = pa.array(np.searchsorted(key, np.arange(len(words) + 1) * np.int64(size)), pa.int32())
        word = pa.ListArray.from_arrays(ends, known.dictionary.take(pa.array(key % size)))
        return pa.StructArray.from_arrays([word, pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))], ["word", "tf"])

    def measured(t: pa.Table) -> dict:
        n, out, sides = t.num_rows, {}, [column(t, s) for s in "ab"]
        words = [side.field("word") for side in sides]
        known = pa.concat_arrays([w.flatten() for w in words]).dictionary_encode()
        size, cut = max(len(known.dictionary), 1), len(words[0].flatten())
        total = lambda row, values: np.bincount(row, values, n).astype(np.int64)
        keys, tfs = [], []
        for name, side, word, codes in zip("ab", sides, words, (known.indices[:cut], known.indices[cut:]), strict=True):
            row, tf = np.repeat(np.arange(n), word.value_lengths().to_numpy()), side.field("tf").flatten().to_numpy()
            out |= {f"n_{name}": total(row, None), f"s_{name}": total(row, tf), f"q_{name}": total(row, tf * tf)}
            keys.append(row * np.int64(size) + codes.to_numpy())
            tfs.append(tf)
        both, x, y = np.intersect1d(*keys, assume_unique=True, return_indices=True)
        row, x, y = both // size, tfs[0][x], tfs[1][y]
        out |= {"common": total(row, None), "low": total(row, np.minimum(x, y)), "dot": total(row, x * y), "gap": total(row, np.abs(x - y)), "met": total(row, x + y)}
        return {"a_id": column(t, "a_id"), "b_id": column(t, "b_id")} | {k: out[k] for k in SHARED}

    pairs = adjacent(docs.select("id", counted("words").alias("counts")), "id", "counts")
    kind = pairs.schema["a_id"].dataType.simpleString()
    return batched(pairs, measured, f"a_id {kind}, b_id {kind}, " + ", ".join(f"{k} long" for k in SHARED))


#: What is summed up of a pair: different words, words and squares of either side, then of those that both have.
SHARED = ("n_a", "s_a", "q_a", "n_b", "s_b", "q_b", "common", "low", "dot", "gap", "met")


def _over(top, bottom, empty: float):
    return F.when(bottom == 0, F.lit(empty)).otherwise(top / bottom)


def set_measures(s: DataFrame) -> DataFrame:
    c = F.col
    return s.select("a_id", "b_id", _over(c("common"), F.greatest("n_a", "n_b"), 1.0).alias("set_intersection"), _over(c("common"), c("n_a") + c("n_b") - c("common"), 1.0).alias("set_jaccard"), _over(2 * c("common"), c("n_a") + c("n_b"), 1.0).alias("set_dice"))


def multiset_measures(s: DataFrame) -> DataFrame:
    c = F.col
    return s.select("a_id", "b_id", _over(c("low"), F.greatest("s_a", "s_b"), 1.0).alias("multi_intersection"), _over(c("low"), c("s_a") + c("s_b") - c("low"), 1.0).alias("multi_jaccard"), _over(2 * c("low"), c("s_a") + c("s_b"), 1.0).alias("multi_dice"))


def vector_measures(s: DataFrame) -> DataFrame:
    """Cosine, Pearson over the union of features, distances turned to 1 / (1 + d), Tanimoto and Dice."""
    c = F.col
    dims = c("n_a") + c("n_b") - c("common")
    cov = c("dot") - c("s_a") * c("s_b") / dims
    var = (c("q_a") - c("s_a") * c("s_a") / dims) * (c("q_b") - c("s_b") * c("s_b") / dims)
    square = c("q_a") + c("q_b") - 2 * c("dot")
    manhattan = c("gap") + (c("s_a") + c("s_b") - c("met"))
    return s.select(
        "a_id", "b_id",
        _over(c("dot"), F.sqrt(c("q_a").cast("double") * c("q_b").cast("double")), 0.0).alias("cosine"),
        F.when((dims == 0) | (var <= 1e-12), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), cov / F.sqrt(var))).alias("pearson"),
        (1 / (1 + F.sqrt(square.cast("double")))).alias("euclidean"), (1 / (1 + manhattan.cast("double"))).alias("manhattan"),
        _over(c("dot"), c("q_a") + c("q_b") - c("dot"), 1.0).alias("tanimoto"), _over(2 * c("dot"), c("q_a") + c("q_b"), 1.0).alias("vector_dice"),
    )


def path_features(paths: DataFrame, id_col: str, path_col: str) -> DataFrame:
    """Steps of slash-separated paths: depth, label, its parent edge, and the number of the label among its siblings."""
    steps = paths.select(F.col(id_col).alias("id"), F.filter(F.split(path_col, "/"), lambda x: x != "").alias("steps"))
    rows = steps.select("id", "steps", F.posexplode("steps").alias("depth", "label"))
    rows = rows.select("id", "depth", "label", F.when(F.col("depth") > 0, F.concat(F.get("steps", F.col("depth") - 1), F.lit(">"), F.col("label"))).alias("edge"), F.array_join(F.slice("steps", F.lit(1), F.col("depth") + 1), "/").alias("path"))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("id", "label").orderBy("depth")).cast("bigint"))


def amplitudes(signal: DataFrame) -> DataFrame:
    """Magnitude of each frequency of signals (id, t, x), scaled by their length: sums of cosines and sines."""
    n = signal.groupBy("id").agg(F.count("*").alias("n"))
    freq = n.select("id", "n", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("k"))
    angle = F.col("k") * F.col("t") * F.lit(2 * 3.141592653589793) / F.col("n")
    return freq.join(signal, "id").groupBy("id", "k").agg((F.sqrt(F.pow(F.sum(F.col("x") * F.cos(angle)), F.lit(2.0)) + F.pow(F.sum(F.col("x") * F.sin(angle)), F.lit(2.0))) / F.max("n")).alias("amplitude"))
