"""New documents joined into a table of pairs as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ted import Leaf, distance


def keep_pairs(arrivals: DataFrame, known: Callable[[], DataFrame], leaves: tuple[Leaf, ...], out: str, checkpoint: str) -> StreamingQuery:
    """For each batch of (id, doc): its distances to all known documents and among its own, each pair once with a_id < b_id.

    A document of the batch that known() has as well counts as the batch's, so it does not matter whether known() has
    it yet. Each batch has one folder, which a retry replaces.
    """

    def append(batch: DataFrame, number: int) -> None:
        new = batch.select("id", "doc")
        old = known().select("id", "doc").join(new.select("id"), "id", "left_anti")
        there = old.select("id", "doc", F.lit(True).alias("old")).unionByName(new.withColumn("old", F.lit(False)))
        x, y = there.select(F.col("id").alias("x_id"), F.col("doc").alias("x"), "old"), new.select(F.col("id").alias("y_id"), F.col("doc").alias("y"))
        pairs = x.join(y, (F.col("x_id") < F.col("y_id")) | (F.col("old") & (F.col("x_id") > F.col("y_id"))))
        ends = [F.when(F.col("x_id") < F.col("y_id"), F.col(f"{s}{c}")).otherwise(F.col(f"{t}{c}")).alias(n) for s, t, k in ("xya", "yxb") for c, n in (("_id", f"{k}_id"), ("", k))]
        pairs.select(ends).select("a_id", "b_id", distance(leaves).alias("d")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arrivals.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
