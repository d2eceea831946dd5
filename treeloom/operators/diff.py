"""Structural diff of documents as leaf rows, edit scripts, and their replay.

Leaf rows are (pair, path, section, value). A script is rows (pair, seq, op, path, section, old_value, new_value): updates,
then deletions from the last path back, then insertions in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = {"update": 0, "delete": 1, "insert": 2}


def aligned(source: DataFrame, target: DataFrame) -> DataFrame:
    """Paths of both sides, with both values."""
    s = source.select("pair", "path", "section", F.col("value").alias("old_value"), F.lit(True).alias("in_old"))
    t = target.select("pair", "path", F.col("section").alias("new_section"), F.col("value").alias("new_value"), F.lit(True).alias("in_new"))
    return s.join(t, ["pair", "path"], "full_outer").withColumn("section", F.coalesce("section", "new_section")).drop("new_section")


def script(source: DataFrame, target: DataFrame) -> DataFrame:
    rows = aligned(source, target)
    op = F.when(F.col("in_new").isNull(), "delete").when(F.col("in_old").isNull(), "insert").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "update")
    rows = rows.withColumn("op", op).filter("op is not null")
    back = Window.partitionBy("pair", "op").orderBy(F.desc("path"))
    rows = rows.withColumn("place", F.when(F.col("op") == "delete", F.row_number().over(back)))
    rank = F.when(F.col("op") == "update", 0).when(F.col("op") == "delete", 1).otherwise(2)
    order = Window.partitionBy("pair").orderBy(rank, "place", "path")
    return rows.select("pair", F.row_number().over(order).cast("bigint").alias("seq"), "op", "path", "section", "old_value", "new_value")


def apply_script(source: DataFrame, ops: DataFrame) -> DataFrame:
    """Leaf rows after all operations."""
    o = ops.select("pair", "path", "op", F.col("section").alias("op_section"), "new_value")
    rows = source.join(o, ["pair", "path"], "full_outer").filter("op is null or op <> 'delete'")
    return rows.select("pair", "path", F.coalesce("section", "op_section").alias("section"), F.when(F.col("op").isNotNull(), F.col("new_value")).otherwise(F.col("value")).alias("value"))


def invert(ops: DataFrame) -> DataFrame:
    """The script back: reversed, insertions and deletions exchanged, values swapped."""
    last = F.max("seq").over(Window.partitionBy("pair"))
    other = F.when(F.col("op") == "insert", "delete").when(F.col("op") == "delete", "insert").otherwise(F.col("op"))
    return ops.select("pair", (last + 1 - F.col("seq")).alias("seq"), other.alias("op"), "path", "section", F.col("new_value").alias("old_value"), F.col("old_value").alias("new_value"))


def verify(patched: DataFrame, expected: DataFrame) -> DataFrame:
    """(pair, equal): whether the patched rows are those expected."""
    rows = aligned(patched, expected)
    off = F.col("in_old").isNull() | F.col("in_new").isNull() | ~F.col("old_value").eqNullSafe(F.col("new_value"))
    return rows.groupBy("pair").agg((F.count_if(off) == 0).alias("equal"))


def section_summary(ops: DataFrame) -> DataFrame:
    kinds = [F.count_if(F.col("op") == k).alias(f"n_{k}") for k in ORDER]
    return ops.groupBy("section").agg(F.count("*").alias("n_ops"), *kinds)


def steps(source: DataFrame, ops: DataFrame) -> DataFrame:
    """How many leaves stand after each step, from step 0, the source: running sums, not replays."""
    start = source.groupBy("pair").agg(F.count("*").alias("leaves"))
    change = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
    run = ops.select("pair", "seq", F.sum(change).over(Window.partitionBy("pair").orderBy("seq")).alias("more"))
    every = start.select("pair", F.lit(0).cast("bigint").alias("seq"), "leaves").unionByName(run.join(start, "pair").select("pair", "seq", (F.col("leaves") + F.col("more")).alias("leaves")))
    return every


def script_text(ops: DataFrame) -> DataFrame:
    """One line an operation, in order."""
    line = F.concat_ws(" ", F.rpad("op", 6, " "), "path", F.coalesce("old_value", F.lit("-")), F.lit("->"), F.coalesce("new_value", F.lit("-")))
    return ops.groupBy("pair").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda r: r["line"]), "\n").alias("script"))
