"""Queries of nested documents: each order as JSON of a shape of its own, each customer's orders, and pages as trees."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare as C
from ..operators import nested as N
from ..operators import nested_diff as D
from ..operators import pairs as P
from ..operators import recursive as R
from ..operators import suggest, ted
from ..operators import weighted as W
from ..sources import matrix_cache
from ..sources.scratch import saved, scratch_dir
from . import profiles
from .profiles import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, json): head, total if it is large, and lines: by return flag, or just their number where there is one line."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_quantity").repartition("l_orderkey")  # both groupings and the join go by it
    flags = lines.groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"), F.max("l_linenumber").alias("top"), F.sum("l_quantity").alias("quantity"))
    part = F.struct(F.col("n").cast("double").alias("n"), F.col("top").cast("double").alias("top"), F.when(F.col("quantity") > 50, F.col("quantity")).alias("quantity"))
    lines = flags.groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("n").alias("lines"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("l_returnflag", part.alias("part"))))).alias("by_flag"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("id"))
    head = F.to_json(F.struct(F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).alias("head"), F.when(F.col("o_totalprice") > 200000, F.col("o_totalprice")).alias("total")))
    several = F.concat(F.lit(',"lines":'), F.to_json("by_flag"), F.lit("}"))
    one = F.lit(',"lines":1.0}')
    return o.select("id", F.concat(F.substring(head, 1, F.length(head) - 1), F.when(F.col("lines") == 1, one).otherwise(several)).alias("json"))


_NODES = """f AS (SELECT l_orderkey id, l_returnflag flag, count(*) n, max(l_linenumber) top, sum(l_quantity) q FROM lineitem GROUP BY 1, 2),
l AS (SELECT id, sum(n) lines FROM f GROUP BY 1),
d AS (SELECT o_orderkey id, o_orderpriority p, o_orderstatus s, CASE WHEN o_totalprice > 200000 THEN o_totalprice END total, lines FROM orders JOIN l ON l.id = o_orderkey),
g AS (SELECT f.*, row_number() OVER (PARTITION BY id ORDER BY flag) - 1 place, '{"n": ' || n::DOUBLE || ', "top": ' || top::DOUBLE || CASE WHEN q > 50 THEN ', "quantity": ' || q ELSE '' END || '}' v FROM f JOIN d USING (id) WHERE lines > 1),
ln AS (SELECT id, '{' || string_agg('"' || flag || '": ' || v, ', ' ORDER BY flag) || '}' v FROM g GROUP BY 1),
n AS (
 SELECT id, []::VARCHAR[] path, []::INTEGER[] trail, 'dict' kind, '{"head": {"priority": "' || p || '", "status": "' || s || '"}' || coalesce(', "total": ' || total, '') || ', "lines": ' || coalesce(ln.v, '1.0') || '}' AS value FROM d LEFT JOIN ln USING (id)
 UNION ALL SELECT id, ['head'], [0], 'dict', '{"priority": "' || p || '", "status": "' || s || '"}' FROM d
 UNION ALL SELECT id, ['head', 'priority'], [0, 0], 'str', '"' || p || '"' FROM d
 UNION ALL SELECT id, ['head', 'status'], [0, 1], 'str', '"' || s || '"' FROM d
 UNION ALL SELECT id, ['total'], [1], 'num', total::VARCHAR FROM d WHERE total IS NOT NULL
 UNION ALL SELECT id, ['lines'], [CASE WHEN total IS NULL THEN 1 ELSE 2 END], CASE WHEN lines = 1 THEN 'num' ELSE 'dict' END, coalesce(ln.v, '1.0') FROM d LEFT JOIN ln USING (id)
 UNION ALL SELECT id, ['lines', flag], [CASE WHEN total IS NULL THEN 1 ELSE 2 END, place], 'dict', v FROM g JOIN d USING (id)
 UNION ALL SELECT id, ['lines', flag, k], [CASE WHEN total IS NULL THEN 1 ELSE 2 END, place, nth], 'num', CASE k WHEN 'n' THEN n::DOUBLE WHEN 'top' THEN top::DOUBLE ELSE q END::VARCHAR FROM g JOIN d USING (id) CROSS JOIN (VALUES ('n', 0), ('top', 1), ('quantity', 2)) ks(k, nth) WHERE k <> 'quantity' OR q > 50)"""


@query(f"WITH {_NODES} SELECT id AS pair, array_to_string(path, '/') path, array_to_string(trail, '/') trail, kind, value FROM n")
def nested_node_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the orders' documents: path, child places, kind, value."""
    rows = D.node_rows(order_documents(spark, sf_dir), "id", "json")
    return rows.select("pair", F.array_join("path", "/").alias("path"), F.array_join(F.transform("trail", lambda x: x.cast("string")), "/").alias("trail"), "kind", "value")


#: Paths are at most three steps deep here, so the walk's key is written out step by step.
_DIFF = f"""WITH {_NODES}, ids AS (SELECT a.id FROM d a JOIN d b ON b.id = a.id + 1),
s AS (SELECT n.* FROM n JOIN ids USING (id)), t AS (SELECT n.id - 1 id, path, trail, kind, value FROM n JOIN ids ON ids.id = n.id - 1),
j AS (SELECT coalesce(s.id, t.id) pair, coalesce(s.path, t.path) path, s.kind old_type, t.kind new_type, s.value old_value, t.value new_value, s.trail ot, t.trail nt FROM s FULL JOIN t ON s.id = t.id AND s.path = t.path),
o AS (SELECT j.*, CASE WHEN new_type IS NULL THEN 'delete' WHEN old_type IS NULL THEN 'insert' ELSE 'update' END op FROM j WHERE (old_type IS NOT NULL AND new_type IS NOT NULL AND (old_type <> new_type OR (old_type <> 'dict' AND old_value <> new_value)))
 OR ((old_type IS NULL OR new_type IS NULL) AND EXISTS (SELECT 1 FROM j p WHERE p.pair = j.pair AND p.path = j.path[:-2] AND p.old_type = 'dict' AND p.new_type = 'dict'))),
a AS (SELECT o.*, p.nt above FROM o LEFT JOIN j p ON p.pair = o.pair AND p.path = o.path[:-2]),
k AS (SELECT *, CASE op WHEN 'update' THEN list_transform(nt, lambda x: [0, x]) WHEN 'delete' THEN list_append(list_transform(above, lambda x: [0, x]), [1, -ot[-1]]) ELSE list_append(list_transform(above, lambda x: [0, x]), [2, nt[-1]]) END ord FROM a),
ops AS (SELECT pair, row_number() OVER (PARTITION BY pair ORDER BY ord) seq, op, path, CASE WHEN op = 'insert' THEN nt[-1] END AS "index", coalesce(path[-1], 'root') AS label, old_type, new_type, old_value, new_value FROM k)"""


@query(f"{_DIFF} SELECT pair, seq, op, array_to_string(path, '/') AS path, \"index\", label, old_type, new_type, old_value, new_value FROM ops")
def nested_diff_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The script from each order's document to the next one's, with child places and changes of kind."""
    return D.scripts(_order_pairs(spark, sf_dir)).withColumn("path", F.array_join("path", "/"))


@query(f"{_DIFF} SELECT coalesce(path[1], 'root') section, count(*) n_ops, count_if(op = 'update')::BIGINT n_update, count_if(op = 'delete')::BIGINT n_delete, count_if(op = 'insert')::BIGINT n_insert FROM ops GROUP BY 1")
def nested_diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.summary(D.scripts(_order_pairs(spark, sf_dir), columns=("pair", "op", "path")))


@query(f"WITH {_NODES} SELECT a.id AS pair, true AS \"equal\", true AS same_order, true AS inverse_equal FROM d a JOIN d b ON b.id = a.id + 1")
def nested_patch_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered replay of each script gives the next document, and of its inverse the first one."""
    return D.replays(_order_pairs(spark, sf_dir))


_INVERSE = _DIFF.replace("ops AS (", "there AS (", 1) + """, m AS (SELECT pair, max(seq) last FROM there GROUP BY 1), ops AS (SELECT pair, last + 1 - seq seq, CASE op WHEN 'insert' THEN 'delete' WHEN 'delete' THEN 'insert' ELSE op END op, path, label, new_type old_type, old_type new_type, new_value old_value, old_value new_value FROM there JOIN m USING (pair))"""


@query(f"{_INVERSE} SELECT pair, seq, op, array_to_string(path, '/') AS path, NULL::INTEGER AS \"index\", label, old_type, new_type, old_value, new_value FROM ops")
def nested_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.scripts(_order_pairs(spark, sf_dir), inverse=True).withColumn("path", F.array_join("path", "/"))


@query(f"""{_DIFF} SELECT pair, string_agg(CASE op WHEN 'insert' THEN 'insert root' || p || ' = ' || new_value WHEN 'delete' THEN 'delete root' || p ELSE 'update root' || p || ': ' || old_value || ' -> ' || new_value END, chr(10) ORDER BY seq) AS text FROM (SELECT *, list_aggregate(list_transform(path, lambda x: '/' || x), 'string_agg', '') p FROM ops) GROUP BY 1""")
def nested_script_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.script_texts(_order_pairs(spark, sf_dir))


_FLAT = _NODES + ", z AS (SELECT a.id AS pair, y.value FROM d a JOIN n y ON y.id = a.id + 1 AND len(y.path) = 0)"


@query(f"{_DIFF}, e AS (SELECT ids.id pair, count(ops.pair) last FROM ids LEFT JOIN ops ON ops.pair = ids.id GROUP BY 1) SELECT e.pair, last AS seq, value AS json FROM e JOIN (SELECT id, value FROM t WHERE len(path) = 0) x ON x.id = e.pair UNION ALL SELECT e.pair, 0, value FROM e JOIN s ON s.id = e.pair AND len(path) = 0 WHERE last > 0")
def nested_patch_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last snapshot of each replay: the document and the next one, key order included."""
    return D.replay_ends(_order_pairs(spark, sf_dir))


_FEATURES = f"""WITH {_NODES}, x AS (SELECT id, 'root' || coalesce(list_aggregate(list_transform(path, lambda x: '/' || x), 'string_agg', ''), '') p, coalesce(path[-1], 'root') label, CASE WHEN len(path) = 1 THEN 'root' ELSE path[-2] END up, path, kind FROM n),
r AS (SELECT 'tag' kind, label feature FROM x UNION ALL SELECT 'edge', up || '/' || label FROM x WHERE len(path) > 0 UNION ALL SELECT 'path_all', p FROM x UNION ALL SELECT 'path_root', p FROM x WHERE kind <> 'dict'
 UNION ALL SELECT 'path_xpath', array_to_string(list_transform(path, lambda s: s || '[1]'), '/') FROM x WHERE len(path) > 0)"""


@query(f"{_FEATURES} SELECT kind, feature, count(*) n FROM r GROUP BY ALL")
def tree_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each tag, edge, path and indexed path occurs in the orders' document trees."""
    return C.feature_counts(order_documents(spark, sf_dir), "json", N.read_texts("json"))


@query()
def page_tree_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the pages' tag trees."""
    return C.feature_counts(table(spark, sf_dir, "pages"), "html", N.read_texts("markup"))


@query(f"WITH {_NODES}, m AS (SELECT id, count(*) nodes, max(len(path)) height, count_if(kind <> 'dict') leaves FROM n GROUP BY 1) SELECT id, nodes, height::BIGINT height, leaves FROM m")
def nested_tree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, height and leaves of each order's tree."""
    tree = N.trees(order_documents(spark, sf_dir), "id", "json")
    return tree.select("id", F.size("tree").cast("long").alias("nodes"), F.array_max(F.transform("tree", lambda n: n["depth"])).cast("long").alias("height"), F.size(F.filter("tree", lambda n: n["kind"] != "dict")).cast("long").alias("leaves"))


@query(f"WITH {_NODES} SELECT id, value AS text FROM n WHERE len(path) = 0")
def tree_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's document, to a tree and back."""
    return N.rendered(N.trees(order_documents(spark, sf_dir), "id", "json"))


@query(f"""WITH {_NODES}, li AS (SELECT id, path, trail, kind, CASE WHEN kind = 'dict' THEN repeat('  ', len(path) - 1) || path[-1] || ':' ELSE repeat('  ', len(path) - 1) || path[-1] || ': ' || trim(value, '"') END line FROM n WHERE len(path) > 0) SELECT id, string_agg(line, chr(10) ORDER BY trail) AS text FROM li GROUP BY 1""")
def tree_to_infobox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's document as indented text."""
    return N.rendered(N.trees(order_documents(spark, sf_dir), "id", "json"), "infobox")


def _page_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.adjacent(N.trees(table(spark, sf_dir, "pages"), "page_id", "html", "markup"), "id", "tree")


WEIGHTS = {"lines": 0.3, "head": 0.3, "root": 0.1, "total": 2.5, "n": 1.5, "top": 0.5, "quantity": 2.0}


def _order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of texts: they become trees where pairs are measured, as a text is a tenth of its tree."""
    return P.adjacent(order_documents(spark, sf_dir), "id", "json")


@query()
def nested_weighted_ted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted distance of adjacent orders' documents; labels repeat below each return flag."""
    return W.distances(_order_pairs(spark, sf_dir), read=N.read_texts("json", WEIGHTS))


@query()
def recursive_ted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both settings of the recursive distance, over adjacent orders' documents."""
    d = R.distances(_order_pairs(spark, sf_dir), R.LATER, N.read_texts("items"), {"early": R.EARLY})
    return d.select("a_id", "b_id", "distance", "similarity", "size_a", "size_b", "early_distance", "early_similarity")


@query()
def recursive_script_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recursive script's operations by top-level section, over all adjacent orders."""
    ops = R.scripts(_order_pairs(spark, sf_dir), read=N.read_texts("items"), nodes=False)
    return ops.groupBy("section", "op").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 3).alias("cost"))


@query(f"WITH {_NODES} SELECT a.id AS a_id, a.id + 1 AS b_id, true AS \"equal\", true AS exact FROM d a JOIN d b ON b.id = a.id + 1")
def recursive_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay by patch ids of each complete script: the patched tree is the next document's."""
    return R.round_trips(_order_pairs(spark, sf_dir), read=N.read_texts("items")).select("a_id", "b_id", "equal", "exact")


@query()
def page_tree_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By sequences, by child lists and by forests: distances of each page's tags and the next one's."""
    return C.tree_distances(P.adjacent(table(spark, sf_dir, "pages"), "page_id", "html"), N.read_texts("markup"))


@query()
def compare_all_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty methods over each order's document and the next one's."""
    return C.compare_all(_order_pairs(spark, sf_dir), read=N.read_texts("json")).select("a_id", "b_id", "method", F.round("similarity", 6).alias("similarity"))


@query()
def label_edit_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit script of the preorder tags of each page and the next."""
    return C.label_scripts(_page_pairs(spark, sf_dir))


@query()
def tree_inclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages contain the tag tree of which page's article, in order, anywhere."""
    pages = saved(N.trees(table(spark, sf_dir, "pages"), "page_id", "html", "markup"), "pages")
    found = C.inclusions(C.subtrees(pages, "article"), pages)
    return found.select("pattern_id", "id", F.size("nodes").cast("long").alias("places"))


@query()
def name_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark that come closest to each of them written without its second letter."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), "[^\\p{L}]+")).alias("key")).filter("length(key) > 3").distinct()
    words = saved(words, "words")
    asked = words.select(F.concat(F.substring("key", 1, 1), F.substring("key", 3, 1000)).alias("key"))
    return suggest.close_names(asked, words).withColumn("ratio", F.round("ratio", 6))


@query(profiles.matrix_cte() + " SELECT a_id, b_id, dist FROM m WHERE a_id < b_id")
def matrix_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations' matrix out of a cache that first held the nations of all regions but one."""
    docs = saved(profiles.nations(spark, sf_dir), "nations")
    size = ted.node_count(list(profiles.LEAVES))

    def measure(pairs: DataFrame) -> DataFrame:
        like = F.round(ted.similarity(ted.distance(profiles.LEAVES), F.lit(size), F.lit(size)), 6)
        return pairs.select("a_id", "b_id", F.round(1 - like, 6).alias("dist"))

    path = f"{scratch_dir(spark)}/treeloom-matrix-{uuid.uuid4().hex}"
    matrix_cache.upkeep(docs.filter("doc.region <> 'ASIA'"), path, measure)
    return matrix_cache.upkeep(docs, path, measure)
