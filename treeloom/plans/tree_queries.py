"""Queries of costs, distances and similarities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import costs
from ..operators import pairs as P
from ..operators import ted
from . import profiles as N
from . import sqltext as q
from .profiles import LEAVES, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return P.adjacent(part.select("p_partkey", F.struct(*[c for c in part.columns if c != "p_partkey"]).alias("doc")), "p_partkey", "doc")


_PARTS = "FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"


@query(f"SELECT a.p_partkey a_id, round({q.num_cost('a.p_retailprice', 'b.p_retailprice')}, 6) price_cost, round({q.num_cost('a.p_size - 25', 'b.p_size - 25')}, 6) size_cost, round({q.num_cost('nullif(a.p_size, 1)', 'b.p_size')}, 6) missing_cost {_PARTS}")
def leaf_numeric_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = costs.numeric_cost
    a, b = F.col("a"), F.col("b")
    return _parts(spark, sf_dir).select("a_id", F.round(c(a["p_retailprice"], b["p_retailprice"]), 6).alias("price_cost"), F.round(c(a["p_size"] - 25, b["p_size"] - 25), 6).alias("size_cost"), F.round(c(F.nullif(a["p_size"], F.lit(1)), b["p_size"]), 6).alias("missing_cost"))


@query(f"SELECT a.p_partkey a_id, round({q.str_cost('a.p_name', 'b.p_name')}, 6) name_cost, round({q.str_cost('a.p_type', 'b.p_type')}, 6) type_cost {_PARTS}")
def leaf_string_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("a_id", *[F.round(costs.string_cost(F.col("a")[f"p_{c}"], F.col("b")[f"p_{c}"]), 6).alias(f"{c}_cost") for c in ("name", "type")])


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    share = n.groupBy("user_id").agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", F.col("n").cast("double"))))).alias("m"))
    return share.select("user_id", F.struct(F.map_keys("m").alias("kinds"), F.transform_values("m", lambda k, v: 100.0 * v / F.col("total")).alias("mix")).alias("doc"))


_USERS = "WITH n AS (SELECT user_id, event_type k, count(*) n FROM events GROUP BY 1, 2), u AS (SELECT user_id, list(k ORDER BY k) kinds, sum(n) total FROM n GROUP BY 1), pairs AS (SELECT a.user_id a_id, b.user_id b_id, a.kinds ka, b.kinds kb, a.total ta, b.total tb FROM u a JOIN u b ON b.user_id = a.user_id + 1)"


@query(f"{_USERS} SELECT a_id, round({q.list_cost('ka', 'kb')}, 6) list_cost FROM pairs")
def leaf_list_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.adjacent(_users(spark, sf_dir), "user_id", "doc").select("a_id", F.round(costs.list_cost(F.col("a.kinds"), F.col("b.kinds")), 6).alias("list_cost"))


@query(f"{_USERS} SELECT a_id, round(least(sum(abs(coalesce(100::DOUBLE * x.n / ta, 0) - coalesce(100::DOUBLE * y.n / tb, 0))) / 200, 1), 6) dist_cost FROM pairs CROSS JOIN (SELECT DISTINCT k FROM n) ks LEFT JOIN n x ON x.user_id = a_id AND x.k = ks.k LEFT JOIN n y ON y.user_id = b_id AND y.k = ks.k GROUP BY a_id")
def leaf_distribution_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.adjacent(_users(spark, sf_dir), "user_id", "doc").select("a_id", F.round(costs.distribution_cost(F.col("a.mix"), F.col("b.mix")), 6).alias("dist_cost"))


_X = "(l_discount * 10)"


@query(f"SELECT l_orderkey, l_linenumber, round({q.sharpen(_X, 1)}, 6) s1, round({q.sharpen(_X, 3)}, 6) s3, round({q.sharpen(_X, 5)}, 6) s5, round(1 / (1 + l_linenumber::DOUBLE), 6) depth_factor FROM lineitem")
def sharpen_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_discount") * 10
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(costs.sharpen(x, d), 6).alias(f"s{d}") for d in (1, 3, 5)], F.round(costs.depth_factor(F.col("l_linenumber")), 6).alias("depth_factor"))


@query("WITH e AS (SELECT event_id, event_type t, CAST(value AS DECIMAL(18,2)) v FROM events), p AS (SELECT a.event_id a_id, a.t ta, b.t tb, a.v::DOUBLE va, b.v::DOUBLE vb FROM e a JOIN e b ON b.event_id = a.event_id + 1) SELECT a_id, CASE WHEN ta = tb THEN 0::DOUBLE ELSE 1::DOUBLE END label_cost, round(CASE WHEN va = vb THEN 0 ELSE least(abs(va - vb) / greatest(abs(va), abs(vb), 2.220446049250313e-16), 1) END, 6) number_cost, round(greatest(abs(va / 1000 - vb / 1000) - 0.02::DOUBLE, 0) * 3, 6) value_cost FROM p")
def leaf_relabel_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.struct("event_type", F.col("value").cast("decimal(18,2)").alias("v")).alias("doc"))
    a, b = F.col("a"), F.col("b")
    x, y = a["v"].cast("double") / 1000, b["v"].cast("double") / 1000
    return P.adjacent(e, "event_id", "doc").select("a_id", costs.relabel_cost(a["event_type"], b["event_type"]).alias("label_cost"), F.round(costs.relabel_cost(a["v"].cast("string"), b["v"].cast("string")), 6).alias("number_cost"), F.round(costs.value_cost(x, y), 6).alias("value_cost"))


_LONG = "greatest(length(a.p_name), length(b.p_name))"
_LEV = f"(CASE WHEN {_LONG} = 0 THEN 1 ELSE 1 - levenshtein(a.p_name, b.p_name)::DOUBLE / {_LONG} END)"
_THR = f"(1 - greatest(1, {_LONG} // 3)::DOUBLE / greatest({_LONG}, 1))"


@query(f"SELECT a.p_partkey a_id, levenshtein(a.p_name, b.p_name)::BIGINT distance, round({_LEV}, 6) likeness, round({_THR}, 6) threshold, {_LEV} >= {_THR} same_label {_PARTS}")
def part_name_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a.p_name"), F.col("b.p_name")
    s, t = costs.levenshtein_similarity(a, b), costs.label_threshold(a, b)
    return _parts(spark, sf_dir).select("a_id", F.levenshtein(a, b).cast("bigint").alias("distance"), F.round(s, 6).alias("likeness"), F.round(t, 6).alias("threshold"), (s >= t).alias("same_label"))


def _ted(spark: SparkSession, sf_dir: str, cfg: ted.CostConfig = ted.CostConfig()) -> DataFrame:
    pairs = P.triangular(N.nations(spark, sf_dir), "id", "doc")
    return pairs.select("a_id", "b_id", ted.distance(LEAVES, cfg=cfg).alias("d"))


SIZE = ted.node_count(list(LEAVES))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a_id, b_id, sim, dist) of all nations, both directions, rounded."""
    half = _ted(spark, sf_dir).select("a_id", "b_id", F.round(ted.similarity(F.col("d"), F.lit(SIZE), F.lit(SIZE)), 6).alias("sim"))
    both = half.unionByName(half.select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"), "sim"))
    return both.withColumn("dist", F.round(1 - F.col("sim"), 6))


@query(N.ted_cte() + f" SELECT a_id, b_id, round(d, 6) ted, round(exp(-d / {SIZE}), 6) sim FROM t")
def nation_ted_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    return _ted(spark, sf_dir).select("a_id", "b_id", F.round(d, 6).alias("ted"), F.round(ted.similarity(d, F.lit(SIZE), F.lit(SIZE)), 6).alias("sim"))


_BOUND = 2 * sum(x.weight for x in LEAVES)


@query(N.ted_cte() + f" SELECT a_id, b_id, round(exp(-d / {SIZE}), 6) exp_size, round(greatest(1 - d / {_BOUND}, 0), 6) norm, round(exp(-d), 6) \"exp\", round(1 / (1 + d), 6) inv FROM t")
def nation_sim_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.lit(SIZE)
    return _ted(spark, sf_dir).select("a_id", "b_id", *[F.round(ted.similarity(F.col("d"), n, n, m, F.lit(_BOUND)), 6).alias(m) for m in ("exp_size", "norm", "exp", "inv")])


@query(N.matrix_cte() + " SELECT a_id, b_id, sim, \"rank\" FROM (SELECT a_id, b_id, sim, row_number() OVER (PARTITION BY a_id ORDER BY sim DESC, b_id)::INT AS \"rank\" FROM m) WHERE \"rank\" <= 5")
def nation_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.top_k(matrix(spark, sf_dir), "sim", 5).select("a_id", "b_id", "sim", "rank")


@query(N.matrix_cte() + " SELECT b_id, sim, row_number() OVER (ORDER BY sim DESC, b_id)::INT AS \"rank\" FROM m WHERE a_id = 6")
def nation_one_vs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = P.against(N.nations(spark, sf_dir), "id", "doc", F.col("id") == 6)
    low, high = F.when(F.col("a_id") < F.col("b_id"), F.col("a")).otherwise(F.col("b")), F.when(F.col("a_id") < F.col("b_id"), F.col("b")).otherwise(F.col("a"))
    scored = one.select("a_id", "b_id", low.alias("a"), high.alias("b")).select("a_id", "b_id", F.round(ted.similarity(ted.distance(LEAVES), F.lit(SIZE), F.lit(SIZE)), 6).alias("sim"))
    return P.top_k(scored, "sim", 1 << 30).select("b_id", "sim", "rank")


_PRUNED = [x for x in LEAVES if x.section != "mix" and x.label != "revenue"]


@query(N.ted_cte(_PRUNED, 5) + f" SELECT a_id, b_id, round(d, 6) ted, round(exp(-d / {ted.node_count(_PRUNED)}), 6) sim FROM t")
def nation_label_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = ted.CostConfig(sharpness=5, excluded=frozenset({"mix", "revenue"}))
    n, d = F.lit(ted.node_count(cfg.kept(LEAVES))), F.col("d")
    return _ted(spark, sf_dir, cfg).select("a_id", "b_id", F.round(d, 6).alias("ted"), F.round(ted.similarity(d, n, n), 6).alias("sim"))


@query("""WITH d AS (SELECT o_custkey id, 'orders' AS section FROM orders UNION SELECT o_custkey, 'urgent' FROM orders WHERE o_orderpriority LIKE '1%' UNION SELECT o_custkey, 'open' FROM orders WHERE o_orderstatus = 'O' UNION SELECT c_custkey, 'base' FROM customer),
 i AS (SELECT section, count(DISTINCT id) df, ln((SELECT count(*) FROM customer)::DOUBLE / count(DISTINCT id)) ic FROM d GROUP BY 1)
 SELECT section, df, round(ic, 6) ic, round(CASE WHEN max(ic) OVER () <= 0 THEN 1 ELSE 1 + ic / max(ic) OVER () END, 6) weight FROM i""")
def section_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    name = lambda f, s: f.select(F.col("o_custkey").alias("id"), F.lit(s).alias("section"))
    rows = name(o, "orders").unionByName(name(o.filter("o_orderpriority like '1%'"), "urgent")).unionByName(name(o.filter("o_orderstatus = 'O'"), "open")).unionByName(c.select(F.col("c_custkey").alias("id"), F.lit("base").alias("section")))
    out = ted.section_weights(rows, c.count())
    return out.select("section", "df", F.round("ic", 6).alias("ic"), F.round("weight", 6).alias("weight"))


_TOK = q.jaccard(q.toks("a.phrase"), q.toks("b.phrase"))


@query(N.ted_cte() + f" SELECT t.a_id, t.b_id, round(0.5 * round(exp(-d / {SIZE}), 4) + 0.5 * round({_TOK}, 4), 6) score FROM t JOIN p a ON a.id = t.a_id JOIN p b ON b.id = t.b_id")
def nation_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = P.triangular(N.nations(spark, sf_dir), "id", "doc")
    s = F.round(ted.similarity(ted.distance(LEAVES), F.lit(SIZE), F.lit(SIZE)), 4)
    j = F.round(costs.jaccard(costs.tokens(F.col("a.phrase")), costs.tokens(F.col("b.phrase"))), 4)
    return pairs.select("a_id", "b_id", F.round(s * 0.5 + j * 0.5, 6).alias("score"))


@query(N.CTE + " SELECT a_id, b_id, " + ", ".join(f"round({N.cost_sql(x, 1)}, 6) AS {x.label}" for x in LEAVES) + " FROM pairs JOIN p a ON a.id = a_id JOIN p b ON b.id = b_id JOIN segments_d USING (a_id, b_id) JOIN priorities_d USING (a_id, b_id)")
def nation_field_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = P.triangular(N.nations(spark, sf_dir), "id", "doc")
    cfg = ted.CostConfig(sharpness=1)
    return pairs.select("a_id", "b_id", *[F.round(ted.leaf_cost(x, F.col("a")[x.label], F.col("b")[x.label], cfg), 6).alias(x.label) for x in LEAVES])
