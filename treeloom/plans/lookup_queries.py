"""Queries of matrix cuts, rankings, key-wise measures and skeletons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lookups as L
from ..operators import pairs as P
from ..operators import weighted as W
from . import cluster_queries, tree_queries, weighted_queries
from .profiles import table

QUERIES, SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


_TED = tree_queries.SQL["nation_ted_matrix"]
_WIDE = f"WITH m AS ({_TED}), w AS (SELECT a_id, b_id, ted, sim FROM m UNION ALL SELECT b_id, a_id, ted, sim FROM m)"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), "n_regionkey")


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as a user spells them: other case, blanks around; one that does not exist."""
    spelt = F.concat(F.lit("  "), F.lower("name"), F.lit(" "))
    return _names(spark, sf_dir).filter("n_regionkey < 2").select(spelt.alias("name")).unionByName(spark.range(1).select(F.lit("Nowhere").alias("name")))


@query(f"WITH m AS ({_TED}), k AS (SELECT n_nationkey id FROM nation WHERE n_regionkey < 2) SELECT a_id, b_id, ted, sim FROM m WHERE a_id IN (SELECT id FROM k) AND b_id IN (SELECT id FROM k)")
def matrix_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the matrix that belongs to the wanted names."""
    return L.sliced(tree_queries.nation_ted_matrix(spark, sf_dir), _names(spark, sf_dir), _wanted(spark, sf_dir)).select("a_id", "b_id", "ted", "sim")


@query("SELECT 'Nowhere' AS name")
def unknown_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.unknown(_names(spark, sf_dir), _wanted(spark, sf_dir)).select("name")


@query(f"WITH m AS ({_TED}) SELECT a_id, b_id, round(CASE WHEN max(ted) OVER () > 0 THEN ted / max(ted) OVER () ELSE ted END, 6) scaled FROM m")
def matrix_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.scaled_by_largest(tree_queries.nation_ted_matrix(spark, sf_dir), "ted")
    return rows.select("a_id", "b_id", F.round("ted", 6).alias("scaled"))


@query(f"{_WIDE} SELECT a_id, arg_max(b_id, (sim, -b_id)) closest, arg_min(b_id, (sim, b_id)) farthest, round(avg(sim), 5) mean FROM w GROUP BY 1")
def ranked_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closest and farthest other nation, and the mean similarity."""
    pairs = tree_queries.nation_ted_matrix(spark, sf_dir).select("a_id", "b_id", "sim")
    both = pairs.unionByName(pairs.select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"), "sim"))
    return L.extremes(both, "sim").select("a_id", "closest", "farthest", F.round("mean", 5).alias("mean"))


@query("SELECT coalesce(r_name, 'Other') region_name, count(*) nations FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON r_regionkey = n_regionkey GROUP BY 1")
def region_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations a region; those of no known region are Other."""
    known = table(spark, sf_dir, "region").filter("r_regionkey < 3").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return _names(spark, sf_dir).join(known, "n_regionkey", "left").groupBy(F.coalesce("r_name", F.lit("Other")).alias("region_name")).agg(F.count("*").alias("nations"))


@query(f"SELECT count(*) n, count(DISTINCT CASE WHEN c >= 0 THEN c END) clusters, count_if(c < 0)::BIGINT outliers, greatest(2, least(10, count(*) - 1)) k FROM (SELECT id, \"cluster\" c FROM ({cluster_queries.SQL['dbscan']}))")
def clustering_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.cluster_counts(cluster_queries.dbscan(spark, sf_dir), "cluster")
    return rows.select("n", "clusters", "outliers", L.clamped_k(F.lit(10).cast("long"), F.col("n")).alias("k"))


_TREES = f"{weighted_queries._CTE} {weighted_queries._BOTH}"


@query(f"{_TREES} SELECT a_id, b_id, round(1 / (1 + d), 6) norm1, round(greatest(0, 1 - d / (na + nb)), 6) norm2, round(greatest(0, 1 - d / greatest(na, nb)), 6) norm3 FROM ({weighted_queries._SUM})")
def ted_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three ways to make a similarity of a distance and two sizes."""
    d, a, b = F.col("distance"), F.col("size_a"), F.col("size_b")
    forms = (1 / (1 + d), F.greatest(F.lit(0.0), 1 - d / (a + b)), F.greatest(F.lit(0.0), 1 - d / F.greatest(a, b)))
    return W.distances(weighted_queries._pairs(spark, sf_dir)).select("a_id", "b_id", *[F.round(f, 6).alias(f"norm{i}") for i, f in enumerate(forms, 1)])


KEYS = ("p_name", "p_brand", "p_type")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts beside the next; brand 13 counts as missing."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.struct("p_name", F.nullif("p_brand", F.lit("Brand#13")).alias("p_brand"), "p_type").alias("doc"))
    return P.adjacent(part, "p_partkey", "doc")


_BRAND = "(SELECT p_partkey, p_name, nullif(p_brand, 'Brand#13') p_brand, p_type FROM part)"
_KEYS = "WITH r AS (" + " UNION ALL ".join(f"SELECT a.p_partkey a_id, b.p_partkey b_id, '{k}' k, a.{k} x, b.{k} y FROM {_BRAND} a JOIN {_BRAND} b ON b.p_partkey = a.p_partkey + 1" for k in KEYS) + ")"
_X, _Y = (f"list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'))" for c in "xy")


@query(f"{_KEYS}, t AS (SELECT a_id, b_id, k, {_X} x, {_Y} y FROM r), c AS (SELECT a_id, b_id, k, len(x) n, len(y) m, len(list_intersect(x, y)) s FROM t) SELECT a_id, b_id, k AS \"key\", n a_count, m b_count, s shared_count, round(CASE WHEN n + m - s = 0 THEN 1 ELSE s::DOUBLE / (n + m - s) END, 4) jaccard FROM c")
def part_key_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.key_overlap(_parts(spark, sf_dir), KEYS, "[a-z0-9]+")


_OPS = f"{_KEYS}, o AS (SELECT *, CASE WHEN x IS NULL THEN 'insert' WHEN y IS NULL THEN 'delete' WHEN x = y THEN 'match' ELSE 'update' END op FROM r WHERE x IS NOT NULL OR y IS NOT NULL)"


@query(f"{_OPS} SELECT a_id, b_id, k AS path, op, left(coalesce(x, ''), CASE op WHEN 'match' THEN 80 ELSE 120 END) from_val, left(coalesce(y, ''), CASE op WHEN 'match' THEN 80 ELSE 120 END) to_val, CASE WHEN op IN ('insert', 'delete') THEN 'structural' ELSE 'semantic' END AS dimension FROM o")
def part_value_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.value_ops(_parts(spark, sf_dir), KEYS)


@query(f"{_OPS} SELECT a_id, b_id, count_if(op = 'match')::BIGINT same, count_if(op = 'update')::BIGINT differ, count_if(op = 'delete')::BIGINT only_a, count_if(op = 'insert')::BIGINT only_b FROM o GROUP BY 1, 2")
def part_op_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.op_counters(L.value_ops(_parts(spark, sf_dir), KEYS))


@query("WITH t AS (SELECT p_partkey, list_concat(string_split(p_name, ' '), [p_name, p_type, lower(p_type), p_brand]) l FROM part), f AS (SELECT p_partkey, list_filter(l, lambda x: len(list_filter(l, lambda y: lower(y) <> lower(x) AND contains(lower(y), lower(x)))) = 0) l FROM t) SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS kept FROM f")
def contained_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.concat(F.split("p_name", " "), F.array("p_name", "p_type", F.lower("p_type"), "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", items.alias("l")).select("p_partkey", F.array_join(L.without_contained(F.col("l")), "|").alias("kept"))


def _skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.filter(F.split("url", "/"), lambda x: x != "")
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), L.chain_skeleton(steps).alias("skeleton"))


_SKELETON = "s AS (SELECT page_id id, list_filter(string_split(url, '/'), lambda x: x <> '') st FROM pages), k AS (SELECT id, list_concat(list_transform(st, lambda x: '<' || x || '>'), list_transform(list_reverse(st), lambda x: '</' || x || '>')) sk FROM s)"


@query(f"WITH {_SKELETON} SELECT id, array_to_string(sk, '') AS skeleton FROM k")
def url_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _skeletons(spark, sf_dir).select("id", F.array_join("skeleton", "").alias("skeleton"))


@query(f"""WITH {_SKELETON}, p AS (SELECT a.id a_id, b.id b_id, a.sk a, b.sk b, list_concat(a.sk, b.sk) l, greatest(len(a.sk), len(b.sk)) n FROM k a JOIN k b ON b.id = a.id + 1),
 q AS (SELECT *, list_filter(list_filter(l, lambda x: NOT starts_with(x, '</')), lambda x: true) o FROM p), d AS (SELECT a_id, b_id, a, b, n, list_filter(o, lambda x, i: list_position(o, x) = i) o FROM q),
 v AS (SELECT a_id, b_id, n, o, unnest(['a', 'b']) side, unnest([a, b]) t FROM d), e AS (SELECT a_id, b_id, side, n, o, unnest(t) tag, unnest(range(len(t))) i FROM v),
 g AS (SELECT a_id, b_id, side, n, i, CASE WHEN starts_with(tag, '</') THEN -list_position(o, '<' || tag[3:]) ELSE list_position(o, tag) END x FROM e),
 h AS (SELECT a_id, b_id, side, n, f, sqrt(pow(sum(x * cos(2 * pi() * f * i / n)), 2) + pow(sum(x * sin(2 * pi() * f * i / n)), 2)) / n amp FROM (SELECT *, unnest(range(n)) f FROM g) GROUP BY 1, 2, 3, 4, 5),
 z AS (SELECT a_id, b_id, f, sum(CASE side WHEN 'a' THEN amp END) a, sum(CASE side WHEN 'b' THEN amp END) b FROM h GROUP BY 1, 2, 3)
 SELECT a_id, b_id, round(CASE WHEN sqrt(sum(a * a)) * sqrt(sum(b * b)) > 0 THEN greatest(0, least(1, sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))))) ELSE 0 END, 5) similarity FROM z GROUP BY 1, 2""")
def url_spectral_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectral likeness of the step chains of each page's address and the next's."""
    return L.spectral_likeness(P.adjacent(_skeletons(spark, sf_dir), "id", "skeleton")).select("a_id", "b_id", F.round("similarity", 5).alias("similarity"))
