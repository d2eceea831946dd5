"""Nation profiles: one document a nation, with leaves of every kind, made from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ted import Leaf
from . import sqltext as q

LEAVES = (
    Leaf("general", "name", "str", 0.8),
    Leaf("general", "region", "str", 1.5),
    Leaf("general", "phrase", "str", 1.0),
    Leaf("population", "customers", "num", 2.5),
    Leaf("population", "orders", "num", 1.5),
    Leaf("economy", "avg_balance", "num", 2.0),
    Leaf("economy", "revenue", "num", 3.0),
    Leaf("economy", "suppliers", "num", 1.0),
    Leaf("economy", "supplier_debt", "num", 0.5),
    Leaf("mix", "segments", "dist", 1.5),
    Leaf("mix", "priorities", "dist", 1.5),
    Leaf("mix", "statuses", "list", 0.5),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shares(rows: DataFrame, key: str, name: str) -> DataFrame:
    n = rows.groupBy("id", F.col(key).alias("k")).agg(F.count("*").alias("n"))
    share = n.withColumn("v", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("id")))
    return share.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(name), F.min(F.struct((-F.col("n")).alias("m"), "k"))["k"].alias(f"top_{name}"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, doc): doc is a struct of the leaves. Orders reach their nation through customer, aggregated before the join."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("id"), "c_acctbal", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").join(customer.select("c_custkey", "id"), F.col("o_custkey") == F.col("c_custkey"))
    c = customer.groupBy("id").agg(F.count("*").alias("customers"), F.avg("c_acctbal").alias("avg_balance"))
    o = orders.groupBy("id").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("revenue"), F.array_sort(F.collect_set("o_orderstatus")).alias("statuses"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("bigint").alias("id")).agg(F.count("*").alias("suppliers"), F.avg(F.when(F.col("s_acctbal") < 0, F.col("s_acctbal"))).alias("supplier_debt"))
    seg, pri = _shares(customer, "c_mktsegment", "segments"), _shares(orders.select("id", "o_orderpriority"), "o_orderpriority", "priorities")
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("region"))
    for part in (c, o, s, seg, pri):
        n = n.join(part, "id", "left")
    n = n.withColumn("phrase", F.concat_ws(" ", "region", "top_segments", "top_priorities"))
    return n.select("id", F.struct(*[x.label for x in LEAVES]).alias("doc"))


CTE = """WITH c AS (SELECT c_nationkey::BIGINT id, count(*) customers, avg(c_acctbal) avg_balance FROM customer GROUP BY 1),
oc AS (SELECT c_nationkey::BIGINT id, orders.* FROM orders JOIN customer ON o_custkey = c_custkey),
o AS (SELECT id, count(*) orders, sum(o_totalprice) revenue, list_sort(list(DISTINCT o_orderstatus)) statuses FROM oc GROUP BY 1),
s AS (SELECT s_nationkey::BIGINT id, count(*) suppliers, avg(CASE WHEN s_acctbal < 0 THEN s_acctbal END) supplier_debt FROM supplier GROUP BY 1),
segments AS (SELECT c_nationkey::BIGINT id, c_mktsegment k, count(*) n, 100::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY c_nationkey) v FROM customer GROUP BY c_nationkey, c_mktsegment),
priorities AS (SELECT id, o_orderpriority k, count(*) n, 100::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY id) v FROM oc GROUP BY id, o_orderpriority),
ts AS (SELECT id, first(k ORDER BY n DESC, k) k FROM segments GROUP BY 1), tp AS (SELECT id, first(k ORDER BY n DESC, k) k FROM priorities GROUP BY 1),
p AS (SELECT n_nationkey::BIGINT id, n_name AS "name", r_name region, concat_ws(' ', r_name, ts.k, tp.k) phrase, customers, orders, avg_balance, revenue, suppliers, supplier_debt, statuses
 FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN c ON c.id = n_nationkey LEFT JOIN o ON o.id = n_nationkey LEFT JOIN s ON s.id = n_nationkey LEFT JOIN ts ON ts.id = n_nationkey LEFT JOIN tp ON tp.id = n_nationkey),
pairs AS (SELECT a.id a_id, b.id b_id FROM p a JOIN p b ON a.id < b.id)"""
for _d in ("segments", "priorities"):
    CTE += f""",
{_d}_d AS (SELECT a_id, b_id, least(sum(abs(coalesce(x.v, 0) - coalesce(y.v, 0))) / 200, 1::DOUBLE) d FROM pairs CROSS JOIN (SELECT DISTINCT k FROM {_d}) ks
 LEFT JOIN {_d} x ON x.id = a_id AND x.k = ks.k LEFT JOIN {_d} y ON y.id = b_id AND y.k = ks.k GROUP BY 1, 2)"""


def cost_sql(leaf: Leaf, degree: int = 3) -> str:
    if leaf.kind == "dist":
        return f"{leaf.weight} * {q.sharpen(f'{leaf.label}_d.d', degree)}"
    cost = {"num": q.num_cost, "str": q.str_cost, "list": q.list_cost}[leaf.kind]
    return f"{leaf.weight} * {q.sharpen('(' + cost(f'a.{leaf.label}', f'b.{leaf.label}') + ')', degree)}"


def ted_cte(leaves=LEAVES, degree: int = 3) -> str:
    """All of the above and t(a_id, b_id, d)."""
    total = "\n + ".join(cost_sql(x, degree) for x in leaves)
    return CTE + f""",
t AS (SELECT pairs.a_id, pairs.b_id, {total} d FROM pairs JOIN p a ON a.id = pairs.a_id JOIN p b ON b.id = pairs.b_id
 JOIN segments_d ON segments_d.a_id = pairs.a_id AND segments_d.b_id = pairs.b_id JOIN priorities_d ON priorities_d.a_id = pairs.a_id AND priorities_d.b_id = pairs.b_id)"""


def matrix_cte() -> str:
    """Also m(a_id, b_id, sim, dist), both directions, rounded so that both engines compare alike."""
    nodes = 1 + len({x.section for x in LEAVES}) + len(LEAVES)
    return ted_cte() + f""",
h AS (SELECT a_id, b_id, round(exp(-d / {nodes}), 6) sim FROM t),
m AS (SELECT a_id, b_id, sim, round(1 - sim, 6) dist FROM h UNION ALL SELECT b_id, a_id, sim, round(1 - sim, 6) FROM h),
assigned AS (SELECT n_nationkey::BIGINT id, n_regionkey::BIGINT cluster FROM nation)"""
