"""Queries of features, token sets, text parsing, lookups and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import features as M
from .profiles import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


WORD = r"[a-z0-9À-ÿ]+"
_SQLWORD = r"[a-z0-9\x{c0}-\x{ff}]+"
_TF = f"WITH w AS (SELECT doc_id id, unnest(regexp_extract_all(lower(text), '{_SQLWORD}')) f FROM documents), tf AS (SELECT id, f, count(*) tf FROM w GROUP BY 1, 2), tot AS (SELECT id, count(*) n, sum(tf)::BIGINT s, sum(tf * tf)::BIGINT q FROM tf GROUP BY 1)"
_PAIRS = (
    _TF
    + """, pr AS (SELECT a.doc_id a_id, b.doc_id b_id FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
 sh AS (SELECT a_id, b_id, count(*) common, sum(least(x.tf, y.tf)) low, sum(x.tf * y.tf) dot, sum(abs(x.tf - y.tf)) gap, sum(x.tf + y.tf) met FROM pr JOIN tf x ON x.id = a_id JOIN tf y ON y.id = b_id AND y.f = x.f GROUP BY 1, 2),
 z AS (SELECT pr.a_id, pr.b_id, coalesce(x.n, 0)::DOUBLE na, coalesce(x.s, 0)::DOUBLE sa, coalesce(x.q, 0)::DOUBLE qa, coalesce(y.n, 0)::DOUBLE nb, coalesce(y.s, 0)::DOUBLE sb, coalesce(y.q, 0)::DOUBLE qb,
  coalesce(common, 0)::DOUBLE common, coalesce(low, 0)::DOUBLE low, coalesce(dot, 0)::DOUBLE dot, coalesce(gap, 0)::DOUBLE gap, coalesce(met, 0)::DOUBLE met
  FROM pr LEFT JOIN tot x ON x.id = pr.a_id LEFT JOIN tot y ON y.id = pr.b_id LEFT JOIN sh ON sh.a_id = pr.a_id AND sh.b_id = pr.b_id)"""
)


def _tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("f"))
    return M.counts(words, "doc_id", "f")


def _shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ids = docs.select("doc_id")
    if ids.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return M.shared_words(docs.select(F.col("doc_id").alias("id"), F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)).alias("words")))
    # words of rows of one id count together
    pairs = ids.select(F.col("doc_id").alias("a_id")).join(ids.select(F.col("doc_id").alias("b_id")), F.col("b_id") == F.col("a_id") + 1)
    return M.shared(_tf(spark, sf_dir), pairs)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("a_id", "b_id", *[F.round(c, 6).alias(c) for c in df.columns if c not in ("a_id", "b_id")])


def _safe(top: str, bottom: str, empty: int) -> str:
    return f"round(CASE WHEN {bottom} = 0 THEN {empty} ELSE {top} / {bottom} END, 6)"


@query(f"{_PAIRS} SELECT a_id, b_id, {_safe('common', 'greatest(na, nb)', 1)} set_intersection, {_safe('common', '(na + nb - common)', 1)} set_jaccard, {_safe('2 * common', '(na + nb)', 1)} set_dice FROM z")
def doc_set_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.set_measures(_shared(spark, sf_dir)))


@query(f"{_PAIRS} SELECT a_id, b_id, {_safe('low', 'greatest(sa, sb)', 1)} multi_intersection, {_safe('low', '(sa + sb - low)', 1)} multi_jaccard, {_safe('2 * low', '(sa + sb)', 1)} multi_dice FROM z")
def doc_multiset_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.multiset_measures(_shared(spark, sf_dir)))


_DIMS = "(na + nb - common)"
_VAR = f"((qa - sa * sa / {_DIMS}) * (qb - sb * sb / {_DIMS}))"


@query(f"{_PAIRS} SELECT a_id, b_id, {_safe('dot', 'sqrt(qa * qb)', 0)} cosine, round(CASE WHEN {_DIMS} = 0 OR {_VAR} <= 1e-12 THEN 0 ELSE greatest(0, (dot - sa * sb / {_DIMS}) / sqrt({_VAR})) END, 6) pearson, round(1 / (1 + sqrt(qa + qb - 2 * dot)), 6) euclidean, round(1 / (1 + gap + (sa + sb - met)), 6) manhattan, {_safe('dot', '(qa + qb - dot)', 1)} tanimoto, {_safe('2 * dot', '(qa + qb)', 1)} vector_dice FROM z")
def doc_vector_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.vector_measures(_shared(spark, sf_dir)))


@query(f"{_PAIRS} SELECT a_id, b_id, common::BIGINT shared, (na - common)::BIGINT only_a, (nb - common)::BIGINT only_b, {_safe('common', '(na + nb - common)', 1)} jaccard FROM z")
def doc_token_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _shared(spark, sf_dir)
    c = F.col
    union = c("n_a") + c("n_b") - c("common")
    return s.select("a_id", "b_id", c("common").alias("shared"), (c("n_a") - c("common")).alias("only_a"), (c("n_b") - c("common")).alias("only_b"), F.round(F.when(union == 0, F.lit(1.0)).otherwise(c("common") / union), 6).alias("jaccard"))


@query(f"{_TF} SELECT id, count(*) features, round(sum(tf::DOUBLE / mx), 4) tf_max, round(sum(ln(1 + tf)), 4) tf_log, max(tf) tf_raw FROM (SELECT *, max(tf) OVER (PARTITION BY id) mx FROM tf) GROUP BY 1")
def doc_tf_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = M.tf_variants(_tf(spark, sf_dir))
    return v.groupBy("id").agg(F.count("*").alias("features"), F.round(F.sum("tf_max"), 4).alias("tf_max"), F.round(F.sum("tf_log"), 4).alias("tf_log"), F.max("tf_raw").cast("bigint").alias("tf_raw"))


@query("WITH s AS (SELECT page_id id, list_filter(string_split(url, '/'), lambda x: x <> '') st FROM pages), r AS (SELECT id, st, unnest(range(len(st)))::INT AS \"depth\" FROM s) SELECT id, \"depth\", st[\"depth\" + 1] AS label, CASE WHEN \"depth\" > 0 THEN st[\"depth\"] || '>' || st[\"depth\" + 1] END AS edge, array_to_string(st[1:\"depth\" + 1], '/') AS path, row_number() OVER (PARTITION BY id, st[\"depth\" + 1] ORDER BY \"depth\") AS nth FROM r")
def url_path_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.path_features(table(spark, sf_dir, "pages"), "page_id", "url")


@query("WITH s AS (SELECT conv_id id, turn t, length(text)::DOUBLE x, count(*) OVER (PARTITION BY conv_id) n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS i FROM conversations), k AS (SELECT a.id, b.i k, a.x, a.i, a.n FROM s a JOIN s b ON a.id = b.id) SELECT id, k, round(sqrt(pow(sum(x * cos(2 * pi() * k * i / n)), 2) + pow(sum(x * sin(2 * pi() * k * i / n)), 2)) / max(n), 4) amplitude FROM k GROUP BY id, k")
def dft_amplitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text")) - 1
    signal = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), i.alias("t"), F.length("text").cast("double").alias("x"))
    return M.amplitudes(signal).select("id", F.col("k").cast("bigint").alias("k"), F.round("amplitude", 4).alias("amplitude"))


# ---- text and numbers


@query("""WITH t AS (SELECT o_orderkey, '$' || o_orderkey || ',250.25 ' || CASE o_orderstatus WHEN 'F' THEN 'million' WHEN 'O' THEN 'trillion' ELSE 'billion' END || ' (' || (o_custkey % 90 + 1) || 'th) in ' || strftime(o_orderdate, '%Y') s FROM orders)
 SELECT o_orderkey, try_cast(regexp_extract(replace(s, ',', ''), '([0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE) first_number,
 round(try_cast(regexp_extract(replace(s, ',', ''), '([0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE) * CASE WHEN s LIKE '%trillion%' THEN 1000 ELSE 1 END / CASE WHEN s LIKE '%million%' THEN 1000 ELSE 1 END, 3) billions,
 try_cast(regexp_extract(s, '\\(([0-9]+)(?:st|nd|rd|th)\\)', 1) AS BIGINT) world_rank, try_cast(regexp_extract(s, ' in ([0-9]{4})$', 1) AS INT) AS "year" FROM t""")
def text_number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    unit = F.when(F.col("o_orderstatus") == "F", "million").when(F.col("o_orderstatus") == "O", "trillion").otherwise("billion")
    s = F.concat(F.lit("$"), F.col("o_orderkey"), F.lit(",250.25 "), unit, F.lit(" ("), F.col("o_custkey") % 90 + 1, F.lit("th) in "), F.date_format("o_orderdate", "yyyy"))
    t = o.select("o_orderkey", s.alias("s"))
    return t.select("o_orderkey", X.first_number(F.col("s")).alias("first_number"), X.billions(F.col("s")).alias("billions"), X.world_rank(F.col("s")).alias("world_rank"), X.year_of(F.regexp_extract("s", " in .*$", 0)).alias("year"))


@query("""SELECT p_partkey, lower(regexp_replace(regexp_replace(trim(p_name || ' / ' || p_type), '[-\\s/]+', '_', 'g'), '[^0-9A-Za-z_]', '', 'g')) snake, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') loose, 'UTC' || CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END || lpad((p_size % 13)::VARCHAR, 2, '0') || ':30' AS "offset", regexp_replace(regexp_replace(p_name, '[^0-9A-Za-z]+', '_', 'g'), '^_+|_+$', '', 'g') slug FROM part""")
def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = F.concat(F.lit("UTC"), F.when(F.col("p_size") % 2 == 0, "+").otherwise("-"), F.col("p_size") % 13, F.lit(":30 (XX); summer"))
    return table(spark, sf_dir, "part").select("p_partkey", X.snake_case(F.concat_ws(" / ", "p_name", "p_type")).alias("snake"), X.loose_key(F.col("p_name")).alias("loose"), X.utc_offset(zone).alias("offset"), X.slug(F.col("p_name")).alias("slug"))


_ABS = "abs(o_totalprice * 1000)"


@query(f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'N/A' WHEN {_ABS} >= 1e9 THEN 'B' WHEN {_ABS} >= 1e6 THEN 'M' WHEN {_ABS} >= 1e3 THEN 'K' ELSE '' END AS suffix FROM orders")
def metric_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") * 1000)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.regexp_replace(X.metric_text(v), "^[0-9.-]+", "").alias("suffix"))


# ---- lookups, merges, windows


@query("SELECT s_suppkey, coalesce(n_name, 'Other') region_name FROM supplier LEFT JOIN (SELECT regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') k, n_name FROM nation WHERE n_regionkey <> 1) ON k = regexp_replace(lower((SELECT n_name FROM nation WHERE n_nationkey = s_nationkey) || ' !'), '[^a-z0-9]', '', 'g')")
def loose_name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    named = table(spark, sf_dir, "supplier").join(nation.select(F.col("n_nationkey").alias("s_nationkey"), F.concat("n_name", F.lit(" !")).alias("spelt")), "s_nationkey", "left")
    known = nation.filter("n_regionkey <> 1").select(X.loose_key(F.col("n_name")).alias("k"), "n_name")
    return named.join(known, X.loose_key(F.col("spelt")) == F.col("k"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("Other")).alias("region_name"))


@query("SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event, count(*) AS n FROM events GROUP BY 1, 2")
def first_and_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", order).alias("first_event"), F.max_by("event_id", order).alias("last_event"), F.count("*").alias("n"))


@query("SELECT l_orderkey, coalesce(round(max(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 4), round(sum(l_quantity), 4)) bucket, sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END)::BIGINT others FROM lineitem GROUP BY 1")
def bucket_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    explicit = F.max(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.coalesce(F.round(explicit, 4), F.round(F.sum("l_quantity"), 4)).alias("bucket"), F.count_if(F.col("l_returnflag") != "R").alias("others"))


@query("SELECT c_nationkey::BIGINT nation, count(*) n, first(c_mktsegment ORDER BY k DESC, c_mktsegment) top_segment FROM (SELECT c_nationkey, c_mktsegment, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) k FROM customer) GROUP BY 1")
def flat_export_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("bigint").alias("nation"), "c_mktsegment").agg(F.count("*").alias("k"))
    return n.groupBy("nation").agg(F.sum("k").alias("n"), F.min(F.struct((-F.col("k")).alias("m"), "c_mktsegment"))["c_mktsegment"].alias("top_segment"))


_MID = "(rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1 + count(*) OVER (PARTITION BY p_brand ORDER BY p_retailprice))"


@query(f"SELECT p_partkey, round(CASE WHEN count(*) OVER (PARTITION BY p_brand) <= 1 THEN 0 ELSE least(greatest({_MID} / 2.0::DOUBLE / (count(*) OVER (PARTITION BY p_brand) - 1), 0), 1) END, 6) midrank FROM part")
def quantile_midrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, run = Window.partitionBy("p_brand"), Window.partitionBy("p_brand").orderBy("p_retailprice")
    n = F.count("*").over(own)
    mid = (F.rank().over(run) - 1 + F.count("*").over(run.rangeBetween(Window.unboundedPreceding, Window.currentRow))) / 2.0 / (n - 1)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.when(n <= 1, F.lit(0.0)).otherwise(F.least(F.greatest(mid, F.lit(0.0)), F.lit(1.0))), 6).alias("midrank"))


@query("WITH b AS (SELECT c_nationkey k, min(c_acctbal) lo, max(c_acctbal) hi FROM customer GROUP BY 1) SELECT c_custkey, round(CASE WHEN hi = lo THEN 0 ELSE (c_acctbal - lo) / (hi - lo) END, 6) linear, round(CASE WHEN hi = lo THEN 0 ELSE ln(1 + c_acctbal - lo) / ln(1 + hi - lo) END, 6) logarithmic FROM customer JOIN b ON k = c_nationkey")
def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    b = c.groupBy("c_nationkey").agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    flat, gap = F.col("hi") == F.col("lo"), F.col("c_acctbal") - F.col("lo")
    return c.join(F.broadcast(b), "c_nationkey").select("c_custkey", F.round(F.when(flat, F.lit(0.0)).otherwise(gap / (F.col("hi") - F.col("lo"))), 6).alias("linear"), F.round(F.when(flat, F.lit(0.0)).otherwise(F.log1p(gap) / F.log1p(F.col("hi") - F.col("lo"))), 6).alias("logarithmic"))


@query("SELECT page_id, label, value, round(value / max(value) OVER (PARTITION BY page_id), 6) share FROM (SELECT page_id, label, count(*)::DOUBLE AS value FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z0-9]+)', 1)) AS label FROM pages) GROUP BY 1, 2)")
def distribution_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z0-9]+)"), F.lit(1))).alias("label"))
    n = tags.groupBy("page_id", "label").agg(F.count("*").cast("double").alias("value"))
    return n.select("page_id", "label", "value", F.round(F.col("value") / F.max("value").over(Window.partitionBy("page_id")), 6).alias("share"))
