"""Queries of trees of different shapes: each customer's orders, one section for each status that occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pairs as P
from ..operators import ted
from ..operators import weighted as W
from . import sqltext as q
from .profiles import table

QUERIES, SQL = {}, {}

#: leaf, kind, weight; labels carry their section's name, so a leaf of one section never turns into one of another
LEAVES = (("n", "num", 1.0), ("total", "num", 2.5), ("urgency", "list", 1.5))
SECTION, ROOT = 0.3, 0.1


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def customer_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, tree of every customer with orders."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").cast("double").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.array_sort(F.collect_set("o_orderpriority")).alias("urgency"))
    sections = orders.groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("o_orderstatus", "n", "total", "urgency"))).alias("s"))

    def nodes(s, i):
        first, rows = i * (len(LEAVES) + 1), []
        for k, (label, kind, weight) in enumerate(LEAVES):
            node = W.leaf(label, kind, s[label], weight, 2, first + k)
            rows.append(node.withField("label", F.concat(s["o_orderstatus"], F.lit("_" + label))))
        return F.array(*rows, W.container(s["o_orderstatus"], SECTION, 1, first))

    tree = F.concat(F.flatten(F.transform("s", nodes)), F.array(W.container(F.lit("orders"), ROOT, 0, F.lit(0))))
    return sections.select("id", tree.alias("tree"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.adjacent(customer_trees(spark, sf_dir), "id", "tree")


_SECTION_WEIGHT = SECTION + sum(w for _, _, w in LEAVES)
_COSTS = {"n": f"{q.sharpen(q.num_cost('a.n', 'b.n'))}", "total": f"2.5 * {q.sharpen(q.num_cost('a.total', 'b.total'))}", "urgency": f"1.5 * {q.sharpen(q.list_cost('a.urgency', 'b.urgency'))}"}
_CTE = "WITH s AS (SELECT o_custkey id, o_orderstatus st, count(*)::DOUBLE n, round(sum(o_totalprice), 2) total, list(DISTINCT o_orderpriority) urgency FROM orders GROUP BY 1, 2), ids AS (SELECT DISTINCT id FROM s), p AS (SELECT a.id a_id, b.id b_id FROM ids a JOIN ids b ON b.id = a.id + 1), "
_BOTH = "x AS (SELECT p.a_id, p.b_id, t.st, a.id IS NOT NULL in_a, b.id IS NOT NULL in_b, " + ", ".join(f"{c} AS c_{k}" for k, c in _COSTS.items()) + " FROM p CROSS JOIN (SELECT DISTINCT st FROM s) t LEFT JOIN s a ON a.id = p.a_id AND a.st = t.st LEFT JOIN s b ON b.id = p.b_id AND b.st = t.st WHERE a.id IS NOT NULL OR b.id IS NOT NULL) "
_SUM = f"SELECT a_id, b_id, sum(CASE WHEN in_a AND in_b THEN c_n + c_total + c_urgency ELSE {_SECTION_WEIGHT}::DOUBLE END) d, 4 * count_if(in_a) + 1 na, 4 * count_if(in_b) + 1 nb, {2 * ROOT} + {_SECTION_WEIGHT} * (count_if(in_a) + count_if(in_b)) bound FROM x GROUP BY 1, 2"


@query(f"{_CTE} {_BOTH} SELECT a_id, b_id, round(d, 6) AS distance, na AS size_a, nb AS size_b, round(bound, 6) AS bound, round(least(exp(-d / greatest(na, nb)), least(na, nb)::DOUBLE / greatest(na, nb)), 6) AS exp_size, round(least(greatest(1 - d / bound, 0), least(na, nb)::DOUBLE / greatest(na, nb)), 6) AS norm FROM ({_SUM})")
def weighted_ted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted distance, bound and similarities of the order trees of each customer and the next."""
    d = W.distances(_pairs(spark, sf_dir))
    similar = [F.round(ted.similarity(F.col("distance"), F.col("size_a"), F.col("size_b"), m, F.col("bound")), 6).alias(m) for m in ("exp_size", "norm")]
    return d.select("a_id", "b_id", F.round("distance", 6).alias("distance"), "size_a", "size_b", F.round("bound", 6).alias("bound"), *similar)


_LEAF_ROWS = " UNION ALL ".join(f"SELECT a_id, b_id, in_a, in_b, st || '_{k}' AS label, {w}::DOUBLE w, c_{k} AS c FROM x" for k, _, w in LEAVES)


@query(f"{_CTE} {_BOTH}, l AS ({_LEAF_ROWS} UNION ALL SELECT a_id, b_id, in_a, in_b, st, {SECTION}::DOUBLE, 0::DOUBLE FROM x UNION ALL SELECT DISTINCT a_id, b_id, true, true, 'orders', {ROOT}::DOUBLE, 0::DOUBLE FROM x) SELECT a_id, b_id, CASE WHEN NOT in_b THEN 'delete' WHEN NOT in_a THEN 'insert' WHEN c > 0 THEN 'update' ELSE 'match' END AS op, label, round(CASE WHEN in_a AND in_b THEN c ELSE w END, 6) AS cost FROM l")
def weighted_ted_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each node of the two trees becomes, with its cost."""
    return W.scripts(_pairs(spark, sf_dir)).select("a_id", "b_id", "op", "label", F.round("cost", 6).alias("cost"))
