"""Readers and writers of documents, labels and matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_D, _L, _I, _S = T.DoubleType(), T.LongType(), T.IntegerType(), T.StringType()


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


_GDP = _struct(per_capita_usd=_L, total_billion_usd=_D, year=_I)
_SHARES = _struct(groups=T.MapType(_S, T.VariantType()), year=_I)
#: The canonical document; shares are variants, as single entries may be objects.
CANONICAL = _struct(
    country=_S,
    area=_struct(rank=_L, total_km2=_D, water_pct=_D),
    codes=_struct(calling_code=_S, internet_tld=_S, iso_3166_code=_S),
    economy=_struct(currency_code=_S, gdp_nominal=_GDP, gdp_ppp=_GDP, gini=_struct(category=_S, value=_D, year=_I), hdi=_struct(category=_S, rank=_I, value=_D, year=_I)),
    general=_struct(capital=_S, demonym=_S, largest_city=_S, official_language=_S, ethnic_groups=_SHARES, religion=_SHARES),
    government=_struct(type=_S, legislature=_S, lower_house=_S, upper_house=_S, leaders=T.MapType(_S, _S)),
    history=T.MapType(_S, _S),
    population=_struct(density_per_km2=_D, total=_L, year=_I),
    time=_struct(timezone_dst=_S, timezone_utc=_S),
)


def read_directory(spark: SparkSession, path: str, schema: T.StructType = CANONICAL, name: str = "country") -> DataFrame:
    """One document a file; unreadable files are left out; without a name the file's stem is it. Byte-order marks are fine."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    stem = F.regexp_replace(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1), "_", " ")
    return rows.withColumn(name, F.coalesce(F.col(name), stem))


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """(file): names of the files that read_directory leaves out."""
    rows = spark.read.text(path, wholetext=True)
    return rows.filter(F.try_parse_json(F.ltrim(F.translate("value", BYTE_ORDER_MARK, ""))).isNull()).select(F.col("_metadata.file_name").alias("file"))


#: The mark that some editors put in front of a file.
BYTE_ORDER_MARK = "\ufeff"


def read_any(spark: SparkSession, path: str, key: str = "countries", name: str = "country", box: str = "infobox") -> DataFrame:
    """(name, json) of documents however they are kept: {key: [documents]}, a list, a single one, one a file or one a line.

    The name leaves the document; where there is none it is the file's stem. What stands in an infobox takes its
    document's place. Items that are no objects are left out, and unreadable texts.
    """
    texts = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    whole = F.try_parse_json(F.translate("value", BYTE_ORDER_MARK, ""))
    lines = F.filter(F.transform(F.split("value", "\n"), lambda x: F.try_parse_json(x)), lambda v: v.isNotNull())
    listed = lambda v, at: F.try_variant_get(v, at, "array<variant>")
    docs = texts.withColumn("v", whole).select("file", F.coalesce(listed("v", f"$.{key}"), listed("v", "$"), F.when(F.col("v").isNotNull(), F.array("v")), lines).alias("docs"))
    rows = docs.select("file", F.explode("docs").alias("d")).filter(F.schema_of_variant("d").startswith("OBJECT"))
    inner = F.coalesce(F.try_variant_get("d", f"$.{box}", "variant"), F.col("d"))
    fields = F.try_variant_get(inner, "$", "map<string,variant>")
    stem = F.regexp_replace(F.regexp_extract(F.col("file"), r"^(.*)\.json$", 1), "_", " ")
    named = F.coalesce(F.try_variant_get("d", f"$.{name}", "string"), stem)
    return rows.select(named.alias(name), F.to_json(F.map_filter(fields, lambda k, v: k != name)).alias("json"))


def write_json(rows: DataFrame, path: str, name: str, json_col: str) -> None:
    """JSON lines, the documents' own fields behind their name; read_any gives them back."""
    fields = F.try_variant_get(F.try_parse_json(json_col), "$", "map<string,variant>")
    first = F.to_json(F.struct(F.col(name).alias(name)))
    rest = F.to_json(fields)
    line = F.when(rest == "{}", first).otherwise(F.concat(F.substring(first, 1, F.length(first) - 1), F.lit(","), F.substring(rest, 2, 1 << 30)))
    rows.select(line.alias("value")).write.text(path)


def write_texts(rows: DataFrame, path: str, name: str, text: str) -> None:
    """A folder a name (name=...), with the text in it."""
    rows.select(F.col(text).alias("value"), F.col(name).alias("name")).write.partitionBy("name").text(path)


def write_clusters(labels: DataFrame, settings: dict, path: str) -> None:
    """labels: a table of (id, cluster), noise -1; report: the settings, and counts of documents, clusters and noise."""
    labels.select("id", "cluster").write.option("header", True).csv(f"{path}/labels")
    counts = [F.count("*").alias("documents"), F.countDistinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("clusters"), F.count_if(F.col("cluster") == -1).alias("noise")]
    labels.agg(*counts).select(*[F.lit(v).alias(k) for k, v in settings.items()], "documents", "clusters", "noise").write.json(f"{path}/report")


def write_patches(source: DataFrame, target: DataFrame, path: str) -> None:
    """source, target and patched documents (pair, json) and the edit script between them, as JSON lines."""
    from ..operators import nested_diff as D

    ops = D.script(D.node_rows(source, "pair", "json"), D.node_rows(target, "pair", "json"))
    for name, rows in (("source", source), ("target", target), ("edit_script", ops), ("patched", D.apply_script(source, "pair", "json", ops))):
        rows.write.json(f"{path}/{name}")


def read_wrapped(spark: SparkSession, path: str, schema: T.StructType = CANONICAL, key: str = "countries") -> DataFrame:
    """A file of {key: [documents]}; items that are no objects are left out."""
    rows = spark.read.schema(_struct(**{key: T.ArrayType(schema)})).option("multiLine", True).json(path)
    return rows.select(F.explode(key).alias("doc")).filter("doc is not null").select("doc.*")


def last_of_each(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Of rows of the same name the last wins."""
    return rows.groupBy(name).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(name, label) of lines cut once at a tab or else a comma; blank lines and # comments are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> '' and line not like '#%'")
    parts = F.when(F.contains("line", F.lit("\t")), F.split("line", "\t", 2)).otherwise(F.split("line", ",", 2))
    return lines.select(F.trim(F.get(parts, 0)).alias("name"), F.trim(F.get(parts, 1)).alias("label")).filter("label is not null")


def shares(groups: F.Column) -> F.Column:
    """Percentages of a map of variants; entries that are no numbers are dropped."""
    return F.map_filter(F.transform_values(groups, lambda k, v: F.try_variant_get(v, "$", "double")), lambda k, v: v.isNotNull())


def leaves(docs: DataFrame) -> DataFrame:
    """country and doc: a struct of the leaves that are compared, missing numbers as NULL and missing texts empty."""
    text = lambda c: F.coalesce(F.regexp_replace(F.col(c), r"^\s+|\s+$", ""), F.lit(""))
    return docs.select(
        "country",
        F.struct(
            F.col("area.total_km2"), F.col("area.water_pct"), F.col("area.rank"),
            text("codes.calling_code").alias("calling_code"), text("codes.internet_tld").alias("internet_tld"), text("codes.iso_3166_code").alias("iso_3166_code"),
            text("economy.currency_code").alias("currency_code"),
            F.col("economy.gdp_ppp.total_billion_usd").alias("ppp_total"), F.col("economy.gdp_ppp.per_capita_usd").alias("ppp_per_capita"),
            F.col("economy.gdp_nominal.total_billion_usd").alias("nominal_total"), F.col("economy.gdp_nominal.per_capita_usd").alias("nominal_per_capita"),
            F.col("economy.gini.value").alias("gini"), F.col("economy.hdi.value").alias("hdi"),
            text("general.capital").alias("capital"), text("general.demonym").alias("demonym"), text("general.official_language").alias("official_language"),
            shares(F.col("general.religion.groups")).alias("religion"), shares(F.col("general.ethnic_groups.groups")).alias("ethnic_groups"),
            text("government.type").alias("type"), text("government.legislature").alias("legislature"), text("government.lower_house").alias("lower_house"), text("government.upper_house").alias("upper_house"),
            F.coalesce(F.array_join(F.array_sort(F.map_keys("history")), " | "), F.lit("")).alias("history"),
            F.col("population.total").alias("population"), F.col("population.density_per_km2").alias("density"),
            text("time.timezone_utc").alias("timezone_utc"), text("time.timezone_dst").alias("timezone_dst"),
        ).alias("doc"),
    )


def write_flat(docs: DataFrame, path: str) -> None:
    """A flat table of scalars, with the largest share of religions."""
    top = F.element_at(F.array_sort(F.transform(F.map_entries(shares(F.col("general.religion.groups"))), lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("key")))), 1)["key"]
    docs.select("country", "area.total_km2", "area.water_pct", "population.total", "population.density_per_km2", F.col("economy.hdi.value").alias("hdi"), F.col("economy.gini.value").alias("gini"), top.alias("top_religion")).write.option("header", True).csv(path)


def write_matrix(pairs: DataFrame, path: str, value: str = "dist") -> None:
    """A square table, six decimals, one row and one column a name. Only for collections small enough to be columns."""
    wide = pairs.groupBy("a_id").pivot("b_id").agg(F.first(F.format_string("%.6f", value)))
    wide.orderBy("a_id").write.option("header", True).csv(path)
