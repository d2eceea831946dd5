"""Agglomerative clustering as Spark rounds: reciprocal nearest neighbours merge together, round by round.

Average, complete and single linkage never bring two clusters nearer to each other by merging others, so all pairs that
are each other's nearest may merge at once and give the tree that merging one pair at a time gives (up to ties, which
go to smaller ids). Distances stay a table of pairs throughout: a round relabels both ends and aggregates; no task or
driver holds the matrix. Pairs that are missing count as infinitely far, so there may be several trees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import saved
from .graph import components


def _joined(method: str) -> Column:
    """Of the distances d between the parts of two clusters, with w pairs of documents behind each."""
    return {"average": lambda: F.sum(F.col("d") * F.col("w")) / F.sum("w"), "complete": lambda: F.max("d"), "single": lambda: F.min("d")}[method]()


def numbered(rows: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """Rows with their place in an order, from 0: sorted by ranges, counted a range; order must tell all rows apart."""
    dealt = saved(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = dealt.groupBy("__range").agg(F.count("*").alias("n")).withColumn("__before", F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)))  # a row a range
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    out = dealt.withColumn("__own", own).join(before.select("__range", "__before"), "__range")
    return out.withColumn(name, (F.coalesce("__before", F.lit(0)) + F.col("__own") - 1).cast("bigint")).drop("__range", "__before", "__own")


def merges(pairs: DataFrame, method: str = "average") -> DataFrame:
    """(node, left, right, height, size) of each merge of (a_id, b_id, dist). Leaves are named by their id, merges m<round>:<smallest id>."""
    ends = (F.least("a_id", "b_id").alias("x"), F.greatest("a_id", "b_id").alias("y"))
    d = saved(pairs.filter("a_id <> b_id").groupBy(*ends).agg(F.min("dist").cast("double").alias("d")).withColumn("w", F.lit(1.0)), "distances")
    clusters = pairs.select(F.col("a_id").alias("c")).unionByName(pairs.select(F.col("b_id").alias("c"))).distinct().select("c", F.lit(1).cast("bigint").alias("size"), F.col("c").cast("string").alias("node"))
    clusters, done, r = saved(clusters, "clusters"), None, 0
    while not d.isEmpty():
        both = d.select("x", "y", "d").unionByName(d.select(F.col("y").alias("x"), F.col("x").alias("y"), "d"))
        near = saved(both.groupBy("x").agg(F.min(F.struct("d", "y")).alias("s")).select("x", "s.y", "s.d"), "nearest")
        back = near.select(F.col("x").alias("y"), F.col("y").alias("x"))
        met = near.join(back, ["x", "y"]).filter("x < y")
        one, two = (clusters.select(F.col("c").alias(k), F.col("size").alias(f"size_{k}"), F.col("node").alias(f"node_{k}")) for k in "xy")
        step = met.join(one, "x").join(two, "y").select("x", "y", F.concat(F.lit(f"m{r}:"), "x").alias("node"), F.col("node_x").alias("left"), F.col("node_y").alias("right"), F.col("d").alias("height"), (F.col("size_x") + F.col("size_y")).alias("size"))
        step = saved(step, "merges")
        done = step if done is None else done.unionByName(step)
        grown = step.select(F.col("x").alias("c"), F.col("size").alias("new_size"), F.col("node").alias("new_node"))
        gone = step.select(F.col("y").alias("c"))
        clusters = saved(clusters.join(gone, "c", "left_anti").join(grown, "c", "left").select("c", F.coalesce("new_size", "size").alias("size"), F.coalesce("new_node", "node").alias("node")), "clusters")
        into = step.select(F.col("y").alias("old"), F.col("x").alias("new"))
        for k in "xy":
            d = d.join(into.select(F.col("old").alias(k), F.col("new").alias(f"new_{k}")), k, "left").withColumn(k, F.coalesce(f"new_{k}", k)).drop(f"new_{k}")
        d = d.filter("x <> y").groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(_joined(method).alias("d"), F.sum("w").alias("w"))
        d, r = saved(d, "distances"), r + 1
    if done is None:
        empty = clusters.select("node", F.col("node").alias("left"), F.col("node").alias("right"), F.lit(0.0).alias("height"), "size")
        return empty.limit(0)
    return done.select("node", "left", "right", "height", "size")


def linkage(pairs: DataFrame, method: str = "average") -> DataFrame:
    """(step, left, right, height, size): merges from the lowest up; documents are numbered by id, merges go on from there."""
    steps = saved(numbered(merges(pairs, method), "height", "size", "node", name="step"), "steps")
    ids = pairs.select(F.col("a_id").alias("id")).unionByName(pairs.select(F.col("b_id").alias("id"))).distinct()
    leaves = saved(numbered(ids, "id"), "leaves")
    n = leaves.count()
    names = leaves.select(F.col("id").cast("string").alias("node"), F.col("place").alias("number")).unionByName(steps.select("node", (F.col("step") + n).alias("number")))
    one, two = (names.select(F.col("node").alias(k), F.col("number").alias(f"n_{k}")) for k in ("left", "right"))
    out = steps.join(one, "left").join(two, "right")
    return out.select("step", F.least("n_left", "n_right").alias("left"), F.greatest("n_left", "n_right").alias("right"), "height", "size")


def _ids(pairs: DataFrame) -> DataFrame:
    return saved(pairs.select(F.col("a_id").alias("id")).unionByName(pairs.select(F.col("b_id").alias("id"))).distinct(), "ids")


def _clusters(ids: DataFrame, kept: DataFrame) -> DataFrame:
    """(k, id, cluster), named by smallest member, of ids (k, id) under the merges kept (k, node, left, right): all k in one graph."""
    at_k = lambda c: F.concat_ws("/", "k", c)
    edges = kept.select(at_k("node").alias("a"), at_k("left").alias("b")).unionByName(kept.select(at_k("node").alias("a"), at_k("right").alias("b")))
    at = components(edges).select(F.col("id").alias("node"), "component")
    rows = ids.withColumn("node", at_k(F.col("id").cast("string"))).join(at, "node", "left").select("k", "id", F.coalesce("component", "node").alias("component"))
    least = rows.groupBy("component").agg(F.min("id").alias("cluster"))
    return rows.join(least, "component").select("k", "id", "cluster")


def cut(pairs: DataFrame, method: str = "average", threshold: float | None = None, k: int | None = None) -> DataFrame:
    """(id, cluster), named by smallest member: merges below a height, or as many as leave k clusters."""
    ids = _ids(pairs)
    steps = numbered(merges(pairs, method), "height", "size", "node", name="step")
    kept = saved(steps.filter(F.col("step") < ids.count() - k) if k else steps.filter(F.col("height") < threshold), "kept")
    return _clusters(ids.withColumn("k", F.lit(0)), kept.withColumn("k", F.lit(0))).drop("k")


def cuts(pairs: DataFrame, ks: list[int], method: str = "average") -> DataFrame:
    """(k, id, cluster) of several numbers of clusters, all cut from one tree. A k beyond the number of documents is left out."""
    ids = _ids(pairs)
    n = ids.count()
    steps = saved(numbered(merges(pairs, method), "height", "size", "node", name="step"), "steps")
    asked = F.explode(F.array(*[F.lit(k) for k in sorted(set(ks)) if 0 < k <= n]).cast("array<int>")).alias("k")
    kept = saved(steps.select("*", asked).filter(F.col("step") < n - F.col("k")), "kept")
    return saved(_clusters(ids.select("*", asked), kept), "cuts")


def dendrogram(pairs: DataFrame, method: str = "average") -> DataFrame:
    """(node, parent, height, size, first): every node of the tree with its merge height and the place of its leftmost leaf.

    The child with the smaller number in the linkage stands left. Places are sums of the sizes to the left on the way up,
    found by pointer jumping: each round doubles how far a node has looked up.
    """
    m = saved(numbered(merges(pairs, method), "height", "size", "node", name="step"), "steps")
    ids = pairs.select(F.col("a_id").alias("id")).unionByName(pairs.select(F.col("b_id").alias("id"))).distinct()
    leaves = numbered(ids, "id").select(F.col("id").cast("string").alias("node"), F.lit(0.0).alias("height"), F.lit(1).cast("bigint").alias("size"), F.lit(0).alias("tier"), F.col("place").alias("number"))
    nodes = saved(leaves.unionByName(m.select("node", "height", "size", F.lit(1).alias("tier"), F.col("step").alias("number"))), "nodes")
    rank = F.struct("tier", "number")
    kids = m.select(F.col("node").alias("parent"), F.explode(F.array("left", "right")).alias("node")).join(nodes.select("node", "size", rank.alias("rank")), "node")
    other = kids.select("parent", F.col("node").alias("other"), F.col("size").alias("other_size"), F.col("rank").alias("other_rank"))
    kids = kids.join(other, "parent").filter("node <> other").select("node", "parent", F.when(F.col("other_rank") < F.col("rank"), F.col("other_size")).otherwise(0).alias("shift"))
    roots = saved(numbered(nodes.join(kids, "node", "left_anti").select("node", "size"), "node", name="nth"), "roots")
    before = roots.withColumn("shift", F.coalesce(F.sum("size").over(Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # trees, of which there is one unless pairs are missing
    jumps = saved(kids.select("node", F.col("parent").alias("up"), "shift").unionByName(before.select("node", F.lit(None).cast("string").alias("up"), "shift")), "jumps")
    while not jumps.filter("up is not null").isEmpty():
        above = jumps.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("shift").alias("more"))
        jumps = saved(jumps.join(above, "up", "left").select("node", F.col("next").alias("up"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")), "jumps")
    return nodes.join(jumps.select("node", F.col("shift").alias("first")), "node").join(kids.select("node", "parent"), "node", "left").select("node", "parent", "height", "size", F.col("first").cast("bigint").alias("first"))


def leaf_order(tree: DataFrame) -> DataFrame:
    """(id, place) of a dendrogram's leaves from left to right."""
    return tree.filter("node not like 'm%'").select(F.col("node").cast("bigint").alias("id"), F.col("first").alias("place"))
