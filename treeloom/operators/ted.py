"""Tree edit distance of documents of one shape, and similarities made from distances.

Where all trees have the same labels in the same order the best mapping is the identity: inner nodes cost nothing and
each leaf pair its weight times its sharpened cost. So the distance is one Column, with no dynamic programming.
Trees of different shapes go through operators.weighted, HTML tags at unit costs through operators.trees.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import costs


@dataclass(frozen=True)
class Leaf:
    section: str
    label: str
    kind: str
    weight: float = 1.0
    depth: int = 2


@dataclass(frozen=True)
class CostConfig:
    sharpness: int = 3
    depth_factor: bool = False
    excluded: frozenset[str] = frozenset()

    def kept(self, leaves: tuple[Leaf, ...]) -> list[Leaf]:
        """Leaves without those whose label or section is excluded; all of them if nothing would be left."""
        return [x for x in leaves if x.label not in self.excluded and x.section not in self.excluded] or list(leaves)


def leaf_cost(leaf: Leaf, a: Column, b: Column, cfg: CostConfig = CostConfig()) -> Column:
    """Weighted cost of one leaf pair. A half, the cost of a missing number, is a fixed point of sharpening."""
    cost = costs.sharpen(costs.LEAF_COST[leaf.kind](a, b), cfg.sharpness) * leaf.weight
    return cost * costs.depth_factor(F.lit(float(leaf.depth))) if cfg.depth_factor else cost


def distance(leaves: tuple[Leaf, ...], left: str = "a", right: str = "b", cfg: CostConfig = CostConfig()) -> Column:
    """Distance of two struct columns of leaves."""
    return reduce(lambda x, y: x + y, [leaf_cost(x, F.col(left)[x.label], F.col(right)[x.label], cfg) for x in cfg.kept(leaves)])


def node_count(leaves: list[Leaf]) -> int:
    """Nodes of a tree of these leaves: root, sections, leaves."""
    return 1 + len({x.section for x in leaves}) + len(leaves)


def similarity(d: Column, size_a: Column, size_b: Column, method: str = "exp_size", bound: Column | None = None) -> Column:
    """exp_size, norm (by the cost of deleting one tree and inserting the other), exp or inv."""
    small, large = F.least(size_a, size_b), F.greatest(size_a, size_b)
    if method == "exp_size":
        return F.least(F.exp(-d / large), small / large)
    if method == "norm":
        return F.when(bound == 0, F.lit(1.0)).otherwise(F.least(F.greatest(1.0 - d / bound, F.lit(0.0)), small / large))
    if method == "exp":
        return F.exp(-d)
    if method == "inv":
        return 1.0 / (d + F.lit(1.0))
    raise ValueError(f"method {method} is none of exp_size, norm, exp, inv")


def section_weights(has_data: DataFrame, documents: int) -> DataFrame:
    """From rows (id, section) with data: each section's ln(N / df), and 1 + that over the largest."""
    ic = has_data.groupBy("section").agg(F.countDistinct("id").alias("df")).withColumn("ic", F.ln(F.lit(float(documents)) / F.col("df")))
    largest = ic.agg(F.max("ic").alias("largest"))
    return ic.crossJoin(F.broadcast(largest)).select("section", "df", "ic", F.when(F.col("largest") <= 0, F.lit(1.0)).otherwise(1.0 + F.col("ic") / F.col("largest")).alias("weight"))
