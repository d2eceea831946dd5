"""Queries of scraped fields: keys, compositions and infoboxes written out of the tables, then cleaned; numeric fields, filters by label, and the sweep over numbers of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import schema as S
from ..functions import sections as C
from ..operators import evaluate as E
from ..operators import fields as D
from ..operators import linkage as L
from ..operators import pairs as P
from .cluster_queries import matrix
from .nested_queries import order_documents
from .profiles import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# Texts are written by expressions that both dialects read.
_KEY = "CASE p_partkey % 7 WHEN 0 THEN 'Religion (' || p_size || ')' WHEN 1 THEN 'GDP  ( PPP )' WHEN 2 THEN ' Recognised regional  languages' WHEN 3 THEN 'demonyms' WHEN 4 THEN p_type WHEN 5 THEN 'Countries (non-' || p_brand || ')' ELSE 'Gini (' || p_brand || ')' END"


@query(f"""SELECT canonical, count(*) n FROM (SELECT CASE WHEN low ~ 'religion *\\([^)]*\\)' THEN 'Religion' WHEN low = 'gdp ( ppp )' THEN 'GDP (PPP)' WHEN low = 'recognised regional languages' THEN 'Official regional languages'
 WHEN low = 'demonyms' THEN 'Demonyms' WHEN starts_with(low, 'countries (non') THEN 'Countries (non-sovereign parts)' WHEN starts_with(low, 'gini (') THEN 'Gini' ELSE k END canonical
 FROM (SELECT k, lower(k) low FROM (SELECT trim(regexp_replace({_KEY}, ' +', ' ', 'g')) k FROM part))) GROUP BY 1""")
def canonical_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "part").select(S.canonical_key(F.expr(_KEY)).alias("canonical"))
    return keys.groupBy("canonical").agg(F.count("*").alias("n"))


_SPOKEN = "CASE WHEN p_size % 2 = 0 THEN replace(p_name, ' ', ' and ') || ', ' || p_type || ' (official) / National' ELSE p_type || ' ' || p_size || '.5% of all; and ' || p_brand || ' (' || p_size || ') 3%, ' || p_name END"


@query("""WITH i AS (SELECT p_partkey, unnest(list_concat(string_split(p_name, ' '), [p_type])) label FROM part WHERE p_size % 2 = 0)
 SELECT DISTINCT p_partkey, label, 'present' AS share FROM i WHERE lower(label) <> 'national' AND NOT EXISTS (SELECT 1 FROM i o WHERE o.p_partkey = i.p_partkey AND lower(o.label) <> lower(i.label) AND contains(lower(o.label), lower(i.label)))
 UNION ALL SELECT p_partkey, p_type, p_size || '.5%' FROM part WHERE p_size % 2 = 1 UNION ALL SELECT p_partkey, p_brand, regexp_extract(p_brand, '[0-9]+') || '.0%' FROM part WHERE p_size % 2 = 1""")
def language_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a part with shares, the first number after the label counts, remarks in parentheses too."""
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(S.language_composition(F.expr(_SPOKEN))).alias("label", "share"))


_FAITHS = "'Roman Catholic ' || (o_orderkey % 50) || '%, Sunni ' || (o_custkey % 30) || '.5%; Lutheran protestants ' || (o_custkey % 7) || '% / Irreligion, Buddhist negligible' || CASE WHEN o_orderkey % 3 = 0 THEN ', other ' || (o_custkey % 5) || '%' ELSE '' END"


@query("""SELECT o_orderkey, bucket, round(n, 6) share FROM (SELECT o_orderkey, 'Christianity' bucket, (o_orderkey % 50 + o_custkey % 7)::DOUBLE n FROM orders UNION ALL SELECT o_orderkey, 'Islam', o_custkey % 30 + 0.5 FROM orders
 UNION ALL SELECT o_orderkey, 'Other', CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 5 ELSE 0 END FROM orders)""")
def religion_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(S.religion_composition(F.expr(_FAITHS))).alias("bucket", "text"))
    return pairs.select("o_orderkey", "bucket", F.round(S.share(F.col("text")), 6).alias("share"))


_HOUSES = "CASE c_custkey % 4 WHEN 0 THEN 'Congress:  Senate of ' || c_mktsegment || ' and House of Representatives' WHEN 1 THEN 'National Council and Council of States' WHEN 2 THEN c_mktsegment || ' Assembly' ELSE 'the Bundestag' END"


@query("""WITH t AS (SELECT c_custkey, c_custkey % 4 v, c_mktsegment m FROM customer)
 SELECT c_custkey, 'Legislature' AS chamber, CASE v WHEN 0 THEN 'Congress: Senate of ' || m || ' and House of Representatives' WHEN 1 THEN 'National Council and Council of States' WHEN 2 THEN m || ' Assembly' ELSE 'the Bundestag' END AS name FROM t
 UNION ALL SELECT c_custkey, 'Lower house', CASE v WHEN 0 THEN 'Congress: Senate of ' || m || ' and House of Representatives' WHEN 1 THEN 'National Council' ELSE 'the Bundestag' END FROM t WHERE v <> 2
 UNION ALL SELECT c_custkey, 'Upper house', CASE v WHEN 0 THEN 'Senate' ELSE 'National Council and Council of States' END FROM t WHERE v < 2""")
def legislature_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(S.legislature_roles(F.expr(_HOUSES))).alias("chamber", "name"))


def infoboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, json): a scraped infobox a customer."""
    k = "c_custkey"
    parts = {
        "Area": {"Total": f"({k} % 900 + 1) || ',' || lpad(cast({k} % 1000 as string), 3, '0') || '.5 km2 (' || ({k} % 190 + 1) || 'th)'", "Water (%)": f"CASE WHEN {k} % 3 = 0 THEN 'Negligible' ELSE ({k} % 70) || '.25' END"},
        "Population": {"2019 census": f"{k} || ' (2nd)'", "2022 estimate": f"CASE WHEN {k} % 2 = 0 THEN {k} || ' – ' || ({k} + 3) || ' million' ELSE ({k} + 7) || ',000 (12th)' END", "Density": f"({k} % 500) || '.5/km2'"},
        "Time": {"Time zone": f"'UTC+' || ({k} % 12) || ':30 ( X )'", "Summer ( DST )": "'not observed'"},
        "Codes": {"Calling code": f"CASE WHEN {k} % 5 = 0 THEN 'none' ELSE '+' || ({k} % 900) || ' or more' END", "Internet TLD": f"'see .x' || ({k} % 26)"},
        "History": {"Founded": f"'in ' || (1000 + {k} % 900)", "Declared": "'spring'"},
        "Government": {"Government": "'Republic'", "President": "c_name", "Declared": "'4 July 1776'", "Lower house": "c_mktsegment"},
    }
    section = lambda fields: F.struct(*[F.expr(e).alias(n) for n, e in fields.items()])
    product = section({"Total": f"'$1.' || ({k} % 10) || ' trillion (5th)'", "Per capita": f"'$12,' || lpad(cast({k} % 1000 as string), 3, '0') || ' (9th)'", "Details": "'2023 estimate'"})
    rescue = section({"Prime minister": "c_mktsegment", "Vice president": "'since 1990'"})
    economy = F.struct(product.alias("GDP ( PPP )"), F.expr(f"'0.' || ({k} % 900 + 100) || ' very high (' || ({k} % 190 + 1) || 'th)'").alias("HDI (2022)"), F.lit("30.1 low").alias("Gini (2010)"), F.expr(f"({k} % 60) || '.5 medium'").alias("Gini (2018)"), F.lit("Pound ( Sterling ) ( GBP )").alias("Currency"), rescue.alias("Significant language"))
    faith = section({"Islam": f"({k} % 90) || '.5%'", "Other": "'few'"})
    general = F.struct(F.expr("c_name || ' 34°31′N 69°11′E'").alias("Capital and largest city"), F.array(F.col("c_mktsegment"), F.lit("x")).alias("Demonyms"), F.lit("old").alias("Religion (2001)"), faith.alias("Religion (2020)"), F.col("c_mktsegment").alias("National language"))
    box = F.struct(*[section(f).alias(n) for n, f in parts.items()], economy.alias("Economy"), general.alias("General"))
    return table(spark, sf_dir, "customer").select(F.col(k).alias("id"), F.to_json(box).alias("json"))


@query("""SELECT id, (id % 900 + 1) * 1000 + id % 1000 + 0.5::DOUBLE AS total_km2, id % 190 + 1 AS area_rank, CASE WHEN id % 3 = 0 THEN 0 ELSE id % 70 + 0.25::DOUBLE END AS water_pct,
 CASE WHEN id % 2 = 0 THEN id * 1000000 + 1500000 ELSE (id + 7) * 1000 END AS people, 2022 AS people_year, id % 500 + 0.5::DOUBLE AS density, 'UTC+' || lpad((id % 12)::VARCHAR, 2, '0') || ':30' AS zone, NULL::VARCHAR AS summer,
 CASE WHEN id % 5 = 0 THEN 'none' ELSE '+' || id % 900 END AS calling_code, '.x' || id % 26 AS internet_tld,
 1000.0::DOUBLE + 100 * (id % 10) AS ppp_billion, 12000 + id % 1000 AS ppp_per_capita, NULL::DOUBLE AS nominal_billion, round((id % 900 + 100) / 1000.0, 6) AS hdi, 'very high' AS hdi_category, id % 190 + 1 AS hdi_rank, id % 60 + 0.5::DOUBLE AS gini, 2018 AS gini_year, 'GBP' AS currency,
 name AS capital, name AS largest_city, seg AS demonym, seg AS official_language, id % 90 + 0.5::DOUBLE AS islam, 2020 AS religion_year, 'Republic' AS government, seg AS lower_house,
 'president=' || name || ';prime_minister=' || seg AS leaders, 'Declared=4 July 1776;Founded=in ' || (1000 + id % 900) AS history FROM (SELECT c_custkey id, c_name AS name, c_mktsegment seg FROM customer)""")
def clean_infoboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every section of every infobox, cleaned, as flat columns."""
    box = F.from_json("json", "map<string,map<string,string>>")
    c = infoboxes(spark, sf_dir).select("id", C.clean_infobox(box).alias("c"))
    listed = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    fields = {
        "total_km2": "area.total_km2", "area_rank": "area.rank", "water_pct": "area.water_pct", "people": "population.total", "people_year": "population.year", "density": "population.density_per_km2",
        "zone": "time.timezone_utc", "summer": "time.timezone_dst", "calling_code": "codes.calling_code", "internet_tld": "codes.internet_tld",
        "ppp_billion": "economy.gdp_ppp.total_billion_usd", "ppp_per_capita": "economy.gdp_ppp.per_capita_usd", "nominal_billion": "economy.gdp_nominal.total_billion_usd",
        "hdi": "economy.hdi.value", "hdi_category": "economy.hdi.category", "hdi_rank": "economy.hdi.rank", "gini": "economy.gini.value", "gini_year": "economy.gini.year", "currency": "economy.currency_code",
        "capital": "general.capital", "largest_city": "general.largest_city", "demonym": "general.demonym", "official_language": "general.official_language", "religion_year": "general.religion.year",
        "government": "government.type", "lower_house": "government.lower_house",
    }
    plain = [F.col(f"c.{path}").alias(name) for name, path in fields.items()]
    return c.select("id", *plain, F.col("c.general.religion.groups")["Islam"].alias("islam"), listed(F.col("c.government.leaders")).alias("leaders"), listed(F.col("c.history")).alias("history"))


@query("""SELECT field, count(*) n, min(v) lo, max(v) hi FROM (SELECT c_custkey id, unnest([{'field': 'density', 'v': c_custkey % 500 + 0.5::DOUBLE}, {'field': 'population', 'v': c_custkey::DOUBLE},
 {'field': 'population', 'v': CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 1000000.0::DOUBLE ELSE (c_custkey + 7) * 1000.0::DOUBLE END}, {'field': 'percentage', 'v': CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 70 + 0.25::DOUBLE END},
 {'field': 'hdi', 'v': (c_custkey % 900 + 100) / 1000.0::DOUBLE}, {'field': 'gini', 'v': 30.1::DOUBLE}, {'field': 'gini', 'v': c_custkey % 60 + 0.5::DOUBLE}], recursive := true) FROM customer) GROUP BY 1""")
def numeric_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric fields of all infoboxes, found by their path under canonical keys."""
    leaves = D.canonical_paths(D.json_leaves(infoboxes(spark, sf_dir), "id", "json"))
    return D.field_stats(D.with_fields(leaves))


@query("""SELECT c_custkey id, round(CASE WHEN total <= 1 THEN 0 ELSE least(greatest((below + upto) / 2.0 / (total - 1), 0), 1) END, 12) norm FROM (SELECT c_custkey, rank() OVER (ORDER BY v) - 1 below, count(*) OVER (ORDER BY v) upto, count(*) OVER () total FROM (SELECT c_custkey, c_custkey % 500 + 0.5 v FROM customer))""")
def ranked_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Densities of the infoboxes by mid-rank over all documents, out of their texts."""
    rows = D.normalised(D.canonical_paths(D.json_leaves(infoboxes(spark, sf_dir), "id", "json")))
    return rows.filter("field = 'density'").select("id", F.round(F.col("norm").cast("double"), 12).alias("norm"))


@query()
def normalised_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaf of every order document, numbers normalised, texts in comparable form."""
    return D.normalised(D.json_leaves(order_documents(spark, sf_dir), "id", "json"))


@query("""SELECT id, 'density' AS field, round(CASE WHEN lo = hi THEN 0 ELSE (ln(1 + v) - ln(1 + lo)) / (ln(1 + hi) - ln(1 + lo)) END, 9) scaled FROM (SELECT c_custkey id, v, min(v) OVER () lo, max(v) OVER () hi FROM (SELECT c_custkey, c_custkey % 500 + 0.5::DOUBLE v FROM customer))
 UNION ALL SELECT c_custkey, 'hdi', round((c_custkey % 900 + 100) / 1000.0::DOUBLE, 9) FROM customer""")
def log_scaled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.log_scaled(D.canonical_paths(D.json_leaves(infoboxes(spark, sf_dir), "id", "json")))
    return rows.filter("field in ('density', 'hdi')").select("id", "field", F.round("scaled", 9).alias("scaled"))


@query("SELECT c_custkey id, 'Population' AS section, 3::BIGINT AS n FROM customer UNION ALL SELECT c_custkey, 'Area', 1 FROM customer UNION ALL SELECT c_custkey, 'Economy', 8 FROM customer UNION ALL SELECT c_custkey, 'General', 7 FROM customer UNION ALL SELECT c_custkey, 'Time', 2 FROM customer UNION ALL SELECT c_custkey, 'History', 2 FROM customer")
def pruned_infoboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves that stay of each infobox by section, without two labels and two labels of another schema's sections."""
    off = D.excluded_labels({"Area": {"Total": True, "Water (%)": False}, "Economy": {"Currency": False, "GDP ( PPP )": True}})
    leaves = D.pruned(D.json_leaves(infoboxes(spark, sf_dir), "id", "json"), off)
    kept = D.pruned_sections(leaves, ["government", "codes", "weather"], {"government": "Government", "codes": "Codes"})
    return kept.groupBy("id", F.col("path")[0].alias("section")).agg(F.count("*").alias("n"))


@query("""SELECT a.c_custkey a_id, b.c_custkey b_id, category, metric FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1, (VALUES ('Area', 'Total'), ('Time', 'Time zone'), ('Codes', 'Internet TLD')) x(category, metric)""")
def common_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each infobox and the next one, the chosen metrics that both have."""
    boxes = infoboxes(spark, sf_dir)
    tree = D.with_metrics(D.metric_tree(D.json_leaves(boxes, "id", "json")), ["Total", "Time zone", "Internet TLD"])
    return D.common_metrics(P.adjacent(boxes, "id", "json"), tree)


@query()
def k_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of clusters of the average-linkage tree of the nations, with their scores."""
    m = matrix(spark, sf_dir)
    return E.k_sweep(m, L.cuts(m, list(range(2, 11)))).withColumn("silhouette", F.round("silhouette", 6)).withColumn("intra", F.round("intra", 6))


@query()
def best_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matrix(spark, sf_dir)
    return E.best_k(E.k_sweep(m, L.cuts(m, list(range(2, 11))))).withColumn("silhouette", F.round("silhouette", 6))
