"""Documents of any JSON as rows of leaves: numeric fields by path, their statistics, normalised values, filters by label.

Leaves are (id, path, value); elements of an array have the path step item. Empty objects and arrays have no leaves.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import schema as S
from ..functions.text import compare_text
from ..sources.scratch import saved

# Fields whose values are spread over orders of magnitude.
RANKED = ("gdp_total", "gdp_per_capita", "population", "area_total", "area_land", "area_water", "density")
LOGARITHMIC = ("gdp_total", "gdp_per_capita", "population", "area_total", "density")


def json_leaves(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, path, value) of JSON texts of any depth. Null or unreadable texts have no leaves; null values are the text null."""
    from .nested import json_text, read_json

    def walk(value, path: list[str]) -> Iterator[tuple[list[str], str]]:
        if isinstance(value, dict):
            for k, v in value.items():
                yield from walk(v, [*path, k])
        elif isinstance(value, list):
            for v in value:
                yield from walk(v, [*path, "item"])
        else:
            yield path, value if isinstance(value, str) else json_text(value)

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, p, v) for i, t in zip(b["id"], b["text"], strict=True) if (doc := read_json(t)) is not None for p, v in walk(doc, [])]
            yield pd.DataFrame(rows, columns=["id", "path", "value"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(leaves, f"id {kind}, path array<string>, value string")


def canonical_paths(leaves: DataFrame) -> DataFrame:
    return leaves.withColumn("path", F.transform("path", S.canonical_key))


def with_fields(leaves: DataFrame, by_words: bool = False) -> DataFrame:
    """Leaves with field and number, null where they are no numbers."""
    rule = S.numeric_field_by_words if by_words else S.numeric_field
    return leaves.withColumn("__info", rule(F.col("path"), F.col("value"))).select("*", F.col("__info.field").alias("field"), F.col("__info.number").alias("number")).drop("__info")


def field_stats(rows: DataFrame) -> DataFrame:
    """(field, n, lo, hi) over all documents."""
    return rows.filter("field is not null").groupBy("field").agg(F.count("*").alias("n"), F.min("number").alias("lo"), F.max("number").alias("hi"))


def mid_ranks(rows: DataFrame) -> DataFrame:
    """(field, number, below, upto, total) of each distinct number of a field: how many rows are smaller, and not greater.

    Numbers are counted first, then sorted by ranges that may part a field, so no task holds a field as a whole.
    """
    counts = rows.groupBy("field", "number").agg(F.count("*").alias("n"))
    dealt = saved(counts.repartitionByRange("field", "number").withColumn("range", F.spark_partition_id()), "numbers")
    ranges = dealt.groupBy("field", "range").agg(F.sum("n").alias("here"))
    by_range = Window.partitionBy("field").orderBy("range")  # a row a range
    ranges = ranges.select("field", "range", (F.sum("here").over(by_range) - F.col("here")).alias("before"), F.sum("here").over(Window.partitionBy("field")).alias("total"))
    run = F.sum("n").over(Window.partitionBy("field", "range").orderBy("number").rowsBetween(Window.unboundedPreceding, 0))
    upto = F.col("before") + F.col("run")
    return dealt.withColumn("run", run).join(ranges, ["field", "range"]).select("field", "number", (upto - F.col("n")).alias("below"), upto.alias("upto"), "total")


def _clamped(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def normalised(leaves: DataFrame) -> DataFrame:
    """(id, path, kind, raw, norm, field, number): numbers in 0 to 1, texts in comparable form.

    Indices and percentages by their scale, wide fields by mid-rank over all documents, others between least and
    greatest; a field of one value gives 0.
    """
    rows = saved(with_fields(leaves), "fields")
    wide = F.col("field").isin(*RANKED) | F.col("field").startswith("auto::")
    ranks = mid_ranks(rows.filter(wide).select("field", "number"))
    ranked = rows.filter(wide).join(ranks, ["field", "number"])
    by_rank = F.when(F.col("total") <= 1, F.lit(0.0)).otherwise(_clamped((F.col("below") + F.col("upto")) / 2.0 / (F.col("total") - 1)))
    scale = F.when(F.col("field") == "hdi", F.lit(1.0)).when(F.col("field").isin("gini", "percentage"), F.lit(100.0))
    plain = rows.filter(F.col("field").isNotNull() & ~wide)
    done = [ranked.withColumn("x", by_rank), plain.withColumn("x", _clamped(F.col("number") / scale))]
    out = ("id", "path", F.lit("numeric").alias("kind"), F.col("value").alias("raw"), F.format_string("%.12f", "x").alias("norm"), "field", "number")
    texts = rows.filter("field is null").select("id", "path", F.lit("text").alias("kind"), F.col("value").alias("raw"), compare_text(F.col("value")).alias("norm"), "field", "number")
    return done[0].select(*out).unionByName(done[1].select(*out)).unionByName(texts)


def log_scaled(leaves: DataFrame) -> DataFrame:
    """(id, path, field, number, scaled) by the earlier rules: wide fields between the logarithms of their ends, negative numbers as 0."""
    rows = saved(with_fields(leaves, by_words=True).filter("field is not null"), "fields")
    log = lambda c: F.log1p(F.greatest(F.col(c), F.lit(0.0)))
    gap = F.when(log("lo") == log("hi"), F.lit(0.0)).otherwise((log("number") - log("lo")) / (log("hi") - log("lo")))
    scaled = F.when(F.col("field").isin(*LOGARITHMIC), gap).otherwise(_clamped(F.col("number") / F.when(F.col("field") == "hdi", F.lit(1.0)).otherwise(F.lit(100.0))))
    return rows.join(F.broadcast(field_stats(rows)), "field").select("id", "path", "field", "number", scaled.alias("scaled"))  # eight fields at most


# filters by label and metric


def pruned(leaves: DataFrame, labels: list[str]) -> DataFrame:
    """Leaves with none of the labels anywhere on their path, inside arrays too."""
    return leaves.filter(~F.arrays_overlap("path", F.array(*[F.lit(x) for x in labels]).cast("array<string>")))


def pruned_sections(leaves: DataFrame, labels: list[str], key_of: Mapping[str, str]) -> DataFrame:
    """Labels of one schema drop the top-level keys that they stand for in another; labels that stand for none do nothing."""
    keys = [key_of[x] for x in labels if x in key_of]
    return leaves.filter(~F.element_at("path", 1).isin(*keys)) if keys else leaves


def excluded_labels(chosen: Mapping[str, Mapping[str, bool]]) -> list[str]:
    """Labels to drop: a section's own name where all of its fields are off, else the fields that are."""
    out: list[str] = []
    for section, fields in chosen.items():
        off = [f for f, on in fields.items() if not on]
        out += [section] if fields and len(off) == len(fields) else off
    return out


def metric_tree(leaves: DataFrame) -> DataFrame:
    """(id, category, metric, value, place): leaves two steps deep in order of category and metric; a null value is 0."""
    rows = leaves.filter(F.size("path") == 2).select("id", F.col("path")[0].alias("category"), F.col("path")[1].alias("metric"), F.when(F.col("value") == "null", F.lit("0")).otherwise(F.coalesce("value", F.lit("0"))).alias("value"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("category", "metric", "value")))  # a document a group


def with_metrics(tree: DataFrame, metrics: list[str]) -> DataFrame:
    """The metrics chosen; categories left without any go with their rows. None chosen: all."""
    return tree.filter(F.col("metric").isin(*metrics)) if metrics else tree


def common_metrics(pairs: DataFrame, tree: DataFrame) -> DataFrame:
    """(a_id, b_id, category, metric) that both documents of a pair have."""
    fields = tree.select("id", "category", "metric").distinct()
    a, b = fields.withColumnRenamed("id", "a_id"), fields.withColumnRenamed("id", "b_id")
    return pairs.select("a_id", "b_id").join(a, "a_id").join(b, ["b_id", "category", "metric"]).select("a_id", "b_id", "category", "metric")
