"""A distance matrix kept as a table, brought up to date by computing only the pairs of new or changed documents.

Versions are folders version=<n> of pairs and names below the cache's path; the highest one that was written to its end
counts, so readers see the old version until the new one is whole, and a writer that fails leaves the old one in place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Measure = Callable[[DataFrame], DataFrame]


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole versions: those whose names, written last, end with Spark's mark of success."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    found = [s.getPath().getName() for s in files.listStatus(root)]
    numbers = [int(n.removeprefix("version=")) for n in found if n.startswith("version=") and n.removeprefix("version=").isdigit()]
    return sorted(n for n in numbers if files.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/version={n}/names/_SUCCESS")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(id, mark): a hash of each document's content."""
    return docs.select("id", F.xxhash64(F.to_json("doc")).alias("mark"))


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """Pairs and names (id, mark) of the latest version, or None."""
    found = versions(spark, path)
    if not found:
        return None
    at = f"{path}/version={found[-1]}"
    return spark.read.parquet(f"{at}/pairs"), spark.read.parquet(f"{at}/names")


def write(spark: SparkSession, path: str, pairs: DataFrame, names: DataFrame) -> None:
    """A new version; it counts once its names are whole."""
    found = versions(spark, path)
    at = f"{path}/version={found[-1] + 1 if found else 0}"
    pairs.write.mode("overwrite").parquet(f"{at}/pairs")
    names.write.mode("overwrite").parquet(f"{at}/names")


def is_valid(names: DataFrame, docs: DataFrame) -> bool:
    """Whether a version's documents are these, by id and content."""
    now = fingerprints(docs)
    return names.exceptAll(now).isEmpty() and now.exceptAll(names).isEmpty()


def upkeep(docs: DataFrame, path: str, measure: Measure) -> DataFrame:
    """(a_id, b_id, ...) with a_id < b_id of all pairs of docs (id, doc): the cached ones and measure's of the rest.

    measure turns pairs (a_id, a, b_id, b) into rows of a_id, b_id and what is kept of them. A version that is valid is
    returned as it is. Ids are unique and not null.
    """
    spark = docs.sparkSession
    had = read(spark, path)
    if had is not None and is_valid(had[1], docs):
        return had[0]
    marks = fingerprints(docs)
    a, b = docs.select(F.col("id").alias("a_id"), F.col("doc").alias("a")), docs.select(F.col("id").alias("b_id"), F.col("doc").alias("b"))
    if had is None:
        pairs = measure(a.join(b, F.col("a_id") < F.col("b_id")))
    else:
        same = had[1].join(marks, ["id", "mark"]).select("id")
        kept = had[0]
        for end in ("a_id", "b_id"):
            kept = kept.join(same.select(F.col("id").alias(end)), end, "left_semi")
        new = docs.join(same, "id", "left_anti")
        left, right = new.select(F.col("id").alias("a_id"), F.col("doc").alias("a")), new.select(F.col("id").alias("b_id"), F.col("doc").alias("b"))
        old = docs.join(same, "id", "left_semi")
        smaller = old.select(F.col("id").alias("a_id"), F.col("doc").alias("a")).join(right, F.col("a_id") < F.col("b_id"))
        larger = left.join(b, F.col("a_id") < F.col("b_id")).select("a_id", "a", "b_id", "b")
        pairs = kept.unionByName(measure(larger.unionByName(smaller.select("a_id", "a", "b_id", "b"))))
    write(spark, path, pairs, marks)
    return read(spark, path)[0]
