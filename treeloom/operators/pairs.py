"""Pairs of documents: a matrix over a bounded collection, one against all, adjacent rows, rankings."""

from __future__ import annotations

import gc
import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def triangular(docs: DataFrame, id_col: str, doc_col: str) -> DataFrame:
    """(a_id, a, b_id, b) with a_id < b_id. All pairs: for collections whose matrix is wanted as a whole."""
    a = docs.select(F.col(id_col).alias("a_id"), F.col(doc_col).alias("a"))
    b = docs.select(F.col(id_col).alias("b_id"), F.col(doc_col).alias("b"))
    return a.join(b, F.col("a_id") < F.col("b_id"))


def adjacent(docs: DataFrame, id_col: str, doc_col: str) -> DataFrame:
    """(a_id, a, b_id, b) of each row and the one whose id is one more: an equi-join, linear in the table.

    A row whose successor's id is missing makes no pair: gaps in the ids cut the chain.
    """
    a = docs.select(F.col(id_col).alias("a_id"), F.col(doc_col).alias("a"))
    b = docs.select(F.col(id_col).alias("b_id"), F.col(doc_col).alias("b"))
    return a.join(b, F.col("b_id") == F.col("a_id") + 1)


def against(docs: DataFrame, id_col: str, doc_col: str, source: Column) -> DataFrame:
    """Each other row against the rows for which source holds."""
    a = docs.filter(source).select(F.col(id_col).alias("a_id"), F.col(doc_col).alias("a"))
    b = docs.select(F.col(id_col).alias("b_id"), F.col(doc_col).alias("b"))
    return a.join(b, F.col("a_id") != F.col("b_id"))


def spread(pairs: DataFrame) -> DataFrame:
    """The same rows dealt evenly by a hash of their ids: for kernels whose cost is in no proportion to a row's bytes, which adaptive execution coalesces by."""
    spark = pairs.sparkSession
    n = 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return pairs.repartition(n, "a_id", "b_id")


def by_shape(pairs: DataFrame) -> DataFrame:
    """The same rows, those with trees (or JSON texts) of like shapes in few partitions, for kernels that take them together.

    Each two shapes go to an eighth of the partitions at most, by their ids, so that no shape fills a task alone. What
    shapes are alike is a guess here (texts without their values), which decides nothing but the partition.
    """
    spark = pairs.sparkSession
    n = 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def alike(side: str) -> Column:
        if isinstance(pairs.schema[side].dataType, T.StringType):
            return F.regexp_replace(F.col(side), r': ?(?:"[^"]*"|[-+.0-9Ee]+)', ":")
        return F.transform(side, lambda x: F.struct(x["label"], x["left"]))

    return pairs.repartition(n, F.xxhash64(alike("a"), alike("b")), F.pmod(F.xxhash64("a_id", "b_id"), F.lit(max(2, n // 8))))


def batched(rows: DataFrame, run: Callable[[pa.Table], pa.Table | dict], form: str, most_rows: int = 1 << 15, most_bytes: int = 1 << 24) -> DataFrame:
    """run over tables of many rows of a partition (not over whole partitions), for kernels that gain by what rows have in common. form: DDL of what it gives."""
    schema = to_arrow_schema(T.StructType.fromDDL(form))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                # a batch with long values is cut, so that what is held stays bounded
                step = max(1, min(most_rows, batch.num_rows * most_bytes // max(batch.nbytes, 1)))
                cuts = [batch.slice(at, step) for at in range(0, batch.num_rows, step)]
            else:
                cuts = [None] if batch is None else []
            for cut in cuts:
                full = cut is None or sum(b.num_rows for b in held) + cut.num_rows > most_rows or sum(b.nbytes for b in held) + cut.nbytes > most_bytes
                if held and full:
                    gc.disable()  # so many small objects at a time cost more to look through than to make
                    try:
                        made = run(pa.Table.from_batches(held).combine_chunks())
                    finally:
                        gc.enable()
                    held = []
                    yield from (pa.table(made, schema=schema) if isinstance(made, dict) else made.cast(schema)).to_batches(max_chunksize=10000)
                    del made
                    gc.collect()
                if cut is not None:
                    held.append(cut)

    return rows.mapInArrow(parts, form)


def column(table: pa.Table, name: str) -> pa.Array:
    """A column of a table as one array."""
    c = table.column(name)
    return c.chunk(0) if c.num_chunks == 1 else c.combine_chunks()


def mirrored(pairs: DataFrame, value: str, diagonal: DataFrame, on_diagonal: float) -> DataFrame:
    """Symmetric long form: both directions of each pair, and the diagonal."""
    there = pairs.select("a_id", "b_id", value)
    back = pairs.select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"), value)
    return there.unionByName(back).unionByName(diagonal.select(F.col("id").alias("a_id"), F.col("id").alias("b_id"), F.lit(on_diagonal).alias(value)))


def top_k(matrix: DataFrame, value: str, k: int) -> DataFrame:
    """The k best others of each row; ties go by name."""
    w = Window.partitionBy("a_id").orderBy(F.col(value).desc(), F.col("b_id"))
    return matrix.filter("a_id <> b_id").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
