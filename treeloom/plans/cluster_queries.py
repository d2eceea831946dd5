"""Queries of diffs, clusterings and their evaluation, over the nation matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cluster as C
from ..operators import diff as D
from ..operators import embedding as M
from ..operators import evaluate as E
from ..operators import linkage as L
from ..operators import trees as T
from ..sources.scratch import saved
from . import profiles as N
from .profiles import table
from .tree_queries import matrix as _matrix

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance matrix as a table: the clusterings read it several times."""
    return saved(_matrix(spark, sf_dir), "matrix")


def _leaf_rows(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    """Orders as documents of leaf rows; pair k compares order k with the next one."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"), F.max("l_linenumber").alias("m"))
    o = table(spark, sf_dir, "orders")
    head = o.select((F.col("o_orderkey") - shift).alias("pair"), F.explode(F.map_from_arrays(F.array(F.lit("head/priority"), F.lit("head/status")), F.array("o_orderpriority", "o_orderstatus"))).alias("path", "value"))
    lines = li.select((F.col("l_orderkey") - shift).alias("pair"), F.concat(F.lit("lines/"), "l_returnflag").alias("path"), F.concat_ws("x", "n", "m").alias("value"))
    rows = head.unionByName(lines).select("pair", "path", F.split_part("path", F.lit("/"), F.lit(1)).alias("section"), "value")
    return rows.join(o.select((F.col("o_orderkey") - 1 + shift).alias("pair")), "pair", "left_semi")


def _rows_sql(shift: int) -> str:
    return f"""SELECT pair, path, split_part(path, '/', 1) section, value FROM (
 SELECT o_orderkey - {shift} pair, 'head/priority' path, o_orderpriority value FROM orders UNION ALL SELECT o_orderkey - {shift}, 'head/status', o_orderstatus FROM orders
 UNION ALL SELECT l_orderkey - {shift}, 'lines/' || l_returnflag, count(*) || 'x' || max(l_linenumber) FROM lineitem GROUP BY l_orderkey, l_returnflag) WHERE pair IN (SELECT o_orderkey - {1 - shift} FROM orders)"""


_OPS = f"""WITH s AS ({_rows_sql(0)}), t AS ({_rows_sql(1)}),
 j AS (SELECT coalesce(s.pair, t.pair) pair, coalesce(s.path, t.path) path, coalesce(s.section, t.section) section, s.value old_value, t.value new_value,
  CASE WHEN t.path IS NULL THEN 'delete' WHEN s.path IS NULL THEN 'insert' WHEN s.value IS DISTINCT FROM t.value THEN 'update' END op FROM s FULL JOIN t ON s.pair = t.pair AND s.path = t.path),
 r AS (SELECT *, CASE WHEN op = 'delete' THEN row_number() OVER (PARTITION BY pair, op ORDER BY path DESC) END place FROM j WHERE op IS NOT NULL),
 ops AS (SELECT pair, row_number() OVER (PARTITION BY pair ORDER BY CASE op WHEN 'update' THEN 0 WHEN 'delete' THEN 1 ELSE 2 END, place, path) seq, op, path, section, old_value, new_value FROM r)"""


def _script(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s, t = _leaf_rows(spark, sf_dir, 0), _leaf_rows(spark, sf_dir, 1)
    return s, t, D.script(s, t)


@query(_OPS + " SELECT * FROM ops")
def diff_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _script(spark, sf_dir)[2]


@query(_OPS + " SELECT section, count(*) n_ops, count_if(op = 'update')::BIGINT n_update, count_if(op = 'delete')::BIGINT n_delete, count_if(op = 'insert')::BIGINT n_insert FROM ops GROUP BY 1")
def diff_section_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.section_summary(_script(spark, sf_dir)[2])


@query(_OPS + " SELECT pair, true AS \"equal\", true AS inverse_equal FROM s UNION SELECT pair, true, true FROM t")
def patch_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t, ops = _script(spark, sf_dir)
    there = D.verify(D.apply_script(s, ops), t)
    back = D.verify(D.apply_script(t, D.invert(ops)), s).withColumnRenamed("equal", "inverse_equal")
    return there.join(back, "pair", "full_outer")


@query(_OPS + " SELECT pair, max(seq) OVER (PARTITION BY pair) + 1 - seq AS seq, CASE op WHEN 'insert' THEN 'delete' WHEN 'delete' THEN 'insert' ELSE op END op, path, section, new_value old_value, old_value new_value FROM ops")
def script_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.invert(_script(spark, sf_dir)[2])


@query(_OPS + ", n AS (SELECT pair, count(*) leaves FROM s GROUP BY 1) SELECT pair, 0::BIGINT seq, leaves FROM n UNION ALL SELECT pair, seq, (leaves + sum(CASE op WHEN 'insert' THEN 1 WHEN 'delete' THEN -1 ELSE 0 END) OVER (PARTITION BY pair ORDER BY seq))::BIGINT FROM ops JOIN n USING (pair)")
def patch_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _, ops = _script(spark, sf_dir)
    return D.steps(s, ops)


@query("SELECT event_id, '$.' || k AS path, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_node_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.json_leaves(table(spark, sf_dir, "events"), "event_id", "props")


@query("WITH t AS (SELECT page_id, regexp_extract_all(html, '<[a-z0-9]+') o, regexp_extract_all(html, '</[a-z0-9]+') c FROM pages) SELECT page_id, len(o) AS opens, len(c) AS closes, len(list_distinct(o)) AS labels FROM t")
def tree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.tag_stats(table(spark, sf_dir, "pages"), "page_id", "html")


@query()
def html_tree_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.adjacent_page_distance(table(spark, sf_dir, "pages"))


# ---- clusterings

EPS = 0.11
_M = N.matrix_cte()


@query(_M + f" SELECT a_id, b_id, dist FROM m WHERE dist <= {EPS}")
def eps_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.eps_graph(matrix(spark, sf_dir), EPS).select("a_id", "b_id", "dist")


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"))


_RECURSIVE = _M.replace("WITH c AS", "WITH RECURSIVE c AS", 1)


@query(_RECURSIVE + f""", e AS (SELECT a_id, b_id FROM m WHERE dist <= {EPS}), core AS (SELECT a_id id FROM e GROUP BY 1 HAVING count(*) + 1 >= 3),
 reach AS (SELECT id, id r FROM core UNION SELECT reach.id, b_id FROM reach JOIN e ON a_id = r WHERE b_id IN (SELECT id FROM core)), comp AS (SELECT id, min(r) c FROM reach GROUP BY 1),
 border AS (SELECT a_id, min(c) c FROM e JOIN comp ON b_id = id GROUP BY 1)
 SELECT p.id, coalesce(comp.c, border.c, -1) AS "cluster" FROM p LEFT JOIN comp ON comp.id = p.id LEFT JOIN border ON border.a_id = p.id""")
def dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dbscan(_ids(spark, sf_dir), matrix(spark, sf_dir), EPS, 3)


@query(_M + " SELECT round(e * 0.01::DOUBLE, 2) eps, count(*) links, count(DISTINCT a_id) linked FROM m JOIN range(6, 22) g(e) ON dist <= round(e * 0.01::DOUBLE, 2) GROUP BY 1")
def eps_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.range(6, 22).select(F.round(F.col("id") * 0.01, 2).alias("eps"))
    return matrix(spark, sf_dir).join(F.broadcast(grid), F.col("dist") <= F.col("eps")).groupBy("eps").agg(F.count("*").alias("links"), F.countDistinct("a_id").alias("linked"))


@query(_RECURSIVE + f""", e AS (SELECT a_id, b_id FROM m WHERE dist < {EPS}), reach AS (SELECT id, id r FROM p UNION SELECT reach.id, b_id FROM reach JOIN e ON a_id = r) SELECT id, min(r) AS "cluster" FROM reach GROUP BY 1""")
def single_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.single_linkage(_ids(spark, sf_dir), matrix(spark, sf_dir), EPS)


def _step_sql(k: int) -> str:
    """Assignment to the medoids md<k>, and the next medoids."""
    return f""", as{k} AS (SELECT p.id, coalesce((SELECT md{k}.id FROM md{k} WHERE md{k}.id = p.id), arg_min(b_id, (dist, b_id))) medoid FROM p JOIN m ON a_id = p.id JOIN md{k} ON md{k}.id = b_id GROUP BY p.id),
 md{k + 1} AS (SELECT first(id ORDER BY total, id) id FROM (SELECT x.id, x.medoid, round(sum(CASE WHEN y.medoid = x.medoid THEN dist ELSE 0 END), 9) total FROM as{k} x JOIN m ON a_id = x.id JOIN as{k} y ON y.id = b_id GROUP BY 1, 2) GROUP BY medoid)"""


@query(_M + ", md0 AS (SELECT unnest([0, 8, 16])::BIGINT id)" + _step_sql(0) + _step_sql(1) + _step_sql(2) + " SELECT id, medoid FROM as2")
def kmedoids_fixed_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.kmedoids_from(matrix(spark, sf_dir), spark.createDataFrame([(0,), (8,), (16,)], "id bigint"), 2)


@query()
def kmedoids_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.kmedoids_seeded(matrix(spark, sf_dir), 4)


@query()
def average_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.linkage(matrix(spark, sf_dir), "average")


@query()
def complete_linkage_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.cut(matrix(spark, sf_dir), "complete", k=5)


@query()
def dendrogram_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the average-linkage tree: parent, height, size, place of its leftmost leaf."""
    return L.dendrogram(matrix(spark, sf_dir)).withColumn("height", F.round("height", 6))


@query()
def spectral_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.spectral(matrix(spark, sf_dir), 4)


@query()
def mds_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.landmark_scaling(matrix(spark, sf_dir))


@query()
def kmeans_on_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.kmeans_on_scaling(matrix(spark, sf_dir), 4)


# ---- evaluation, with regions as clusters


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_regionkey").cast("bigint").alias("cluster"))


_L = _M + ", l AS (SELECT a_id, b_id, dist, x.cluster ca, y.cluster cb FROM m JOIN assigned x ON x.id = a_id JOIN assigned y ON y.id = b_id), med AS (SELECT ca c, first(a_id ORDER BY t, a_id) AS \"mid\" FROM (SELECT ca, a_id, round(sum(CASE WHEN ca = cb THEN dist ELSE 0 END), 9) t FROM l GROUP BY 1, 2) GROUP BY 1)"


@query(_L + ", g AS (SELECT a_id, ca, cb, avg(dist) d FROM l GROUP BY 1, 2, 3), w AS (SELECT a_id id, max(CASE WHEN ca = cb THEN d END) own, min(CASE WHEN ca <> cb THEN d END) other FROM g GROUP BY 1) SELECT id, round(CASE WHEN own IS NULL THEN 0 ELSE (other - own) / greatest(own, other) END, 6) silhouette FROM w")
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.silhouette(matrix(spark, sf_dir), _assigned(spark, sf_dir)).select("id", F.round("silhouette", 6).alias("silhouette"))


@query(_L + ", sc AS (SELECT c, \"mid\", avg(coalesce(dist, 0)) s FROM assigned JOIN med ON c = cluster LEFT JOIN m ON a_id = id AND b_id = \"mid\" GROUP BY 1, 2) SELECT round(avg(r), 6) davies_bouldin FROM (SELECT x.c, max((x.s + y.s) / dist) r FROM sc x JOIN sc y ON x.c <> y.c JOIN m ON a_id = x.\"mid\" AND b_id = y.\"mid\" WHERE dist > 0 GROUP BY 1)")
def davies_bouldin_medoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.davies_bouldin_medoid(matrix(spark, sf_dir), _assigned(spark, sf_dir)).select(F.round("davies_bouldin", 6).alias("davies_bouldin"))


@query("""WITH p AS (SELECT c_custkey id, c_nationkey k, c_acctbal / 1000 x, c_custkey::DOUBLE / 1000 y FROM customer), g AS (SELECT avg(x) gx, avg(y) gy, count(*) t FROM p), c AS (SELECT k, count(*) n, avg(x) cx, avg(y) cy FROM p GROUP BY 1),
 s AS (SELECT k, n, cx, cy, avg(sqrt(pow(x - cx, 2) + pow(y - cy, 2))) s, sum(pow(x - cx, 2) + pow(y - cy, 2)) w FROM p JOIN c USING (k) GROUP BY 1, 2, 3, 4),
 db AS (SELECT avg(r) v FROM (SELECT a.k, max((a.s + b.s) / sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2))) r FROM s a JOIN s b ON a.k <> b.k GROUP BY 1))
 SELECT round((SELECT v FROM db), 4) davies_bouldin, round((sum(n * (pow(cx - gx, 2) + pow(cy - gy, 2))) / (count(*) - 1)) / (sum(w) / (max(t) - count(*))), 4) calinski_harabasz FROM s, g""")
def euclidean_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("cluster"), (F.col("c_acctbal") / 1000).alias("x"), (F.col("c_custkey").cast("double") / 1000).alias("y"))
    return E.euclidean_scores(p).select(F.round("davies_bouldin", 4).alias("davies_bouldin"), F.round("calinski_harabasz", 4).alias("calinski_harabasz"))


@query(_L + ", w AS (SELECT ca, avg(dist) a, max(dist) d FROM l WHERE ca = cb GROUP BY 1) SELECT cluster AS \"cluster\", count(*) AS \"size\", round(coalesce(max(a), 0), 6) mean_dist, coalesce(max(d), 0) diameter, max(\"mid\") medoid, string_agg(id::VARCHAR, ',' ORDER BY id) members FROM assigned LEFT JOIN w ON ca = cluster LEFT JOIN med ON c = cluster GROUP BY 1")
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.summary(matrix(spark, sf_dir), _assigned(spark, sf_dir)).withColumn("mean_dist", F.round("mean_dist", 6))


@query("""WITH j AS (SELECT lang c, quality k, count(*) n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER (PARTITION BY c) nc, sum(n) OVER (PARTITION BY k) nk FROM j), t AS (SELECT sum(n)::DOUBLE t FROM j),
 x AS (SELECT c, max(n) top, sum(-n * log2(n::DOUBLE / nc)) h FROM w GROUP BY 1), y AS (SELECT k, nk, max(2::DOUBLE * n / (nc + nk)) best FROM w GROUP BY 1, 2)
 SELECT round((SELECT sum(top) FROM x) / t, 6) purity, round((SELECT sum(h) FROM x) / t, 6) entropy, round((SELECT sum(best * nk) FROM y) / t, 6) f_value FROM t""")
def external_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("cluster"))
    r = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("class"))
    return E.external(d, r).select(*[F.round(c, 6).alias(c) for c in ("purity", "entropy", "f_value")])


@query(_M + ", h2 AS (SELECT DISTINCT dist FROM m), g AS (SELECT dist, lead(dist) OVER (ORDER BY dist) - dist gap FROM h2) SELECT round(max(gap), 6) gap, round(arg_max(dist + gap / 2, (gap, -dist)), 6) middle FROM g")
def merge_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = matrix(spark, sf_dir).select("dist").distinct().withColumn("gap", F.lead("dist").over(Window.orderBy("dist")) - F.col("dist"))
    return g.filter("gap is not null").agg(F.round(F.max("gap"), 6).alias("gap"), F.round(F.max_by(F.col("dist") + F.col("gap") / 2, F.struct("gap", -F.col("dist"))), 6).alias("middle"))


@query(_M + " SELECT a_id, b_id, round(100 * sim)::BIGINT AS percent, x.cluster <> coalesce(lag(x.cluster) OVER (PARTITION BY b_id ORDER BY x.cluster, a_id), x.cluster) AS boundary FROM m JOIN assigned x ON x.id = a_id")
def matrix_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matrix(spark, sf_dir).join(_assigned(spark, sf_dir).withColumnRenamed("id", "a_id"), "a_id")
    before = F.lag("cluster").over(Window.partitionBy("b_id").orderBy("cluster", "a_id"))
    return rows.select("a_id", "b_id", F.round(100 * F.col("sim")).cast("bigint").alias("percent"), (F.col("cluster") != F.coalesce(before, F.col("cluster"))).alias("boundary"))
