"""Connected components by label propagation with pointer jumping, each round a table in the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (a, b): the smallest id reachable. Ids without an edge have no row.

    Each round takes the smallest label among neighbours (an aggregate, combined before the shuffle) and then that
    label's own label, so chains halve and stars end in two rounds. Both sides of each join are plain scans,
    which lets adaptive execution split a hub's partition.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).filter("u <> v")
    both = materialize(both, "links")
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, both.v == labels.id).groupBy("u").agg(F.min("component").alias("m"))
        lower = materialize(labels.join(near, labels.id == near.u, "left").select("id", F.least("component", F.coalesce("m", "component")).alias("component")), "labels")
        to = lower.select(F.col("id").alias("at"), F.col("component").alias("up"))
        new = materialize(lower.join(to, lower.component == to["at"]).select("id", F.least("component", "up").alias("component")), "labels")
        old = labels.select("id", F.col("component").alias("was"))
        if new.join(old, "id").filter("component <> was").isEmpty():
            return new
        labels = new
