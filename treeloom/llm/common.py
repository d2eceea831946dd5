"""Helpers that the training-data operators share: scratch space, tables, words."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are maximal runs of anything but ASCII white space, which is what bytes.split() separates.
WORD_SEPARATORS = r"[\x20\x09-\x0D]+"


#: Rows that go to a Python worker at a time. Texts are long, so Spark's default of 10,000 would take tens of MB a batch.
BATCH, BATCH_ROWS, BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000", "10000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Sets the session's batch size, unless somebody chose one."""
    if spark.conf.get(BATCH, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH, BATCH_ROWS)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a local one only where none is set (tests, local mode)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Spark's own switch for removing a finished query's shuffle files; nothing reads them again once its rows are a table.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared scratch folder and reads it back: cuts lineage, survives lost executors, frees its shuffles."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{scratch_dir(spark)}/treeloom-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: F.Column | str) -> F.Column:
    """The fold that labels are never learned from: crc32 of the id's text, modulo 4, is 2."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(rows: DataFrame, key: str, id_col: str, per_class: int, seed: int = 7) -> DataFrame:
    """About per_class rows of each value of key, chosen by a hash of the id: no window, so no hot task."""
    counts = {r[0]: r[1] for r in rows.groupBy(key).count().collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(key) == F.lit(value), F.lit(min(1.0, per_class / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.filter(draw < share)


def text_words(text: str | None) -> list[bytes]:
    """Words of a text as bytes, A-Z lower-cased; bytes.lower() leaves all other letters alone."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def groups_for(n_rows: int, per_group: int) -> int:
    return max(1, math.ceil(n_rows / per_group))


LONG, STR, DBL, INT, BIN = T.LongType(), T.StringType(), T.DoubleType(), T.IntegerType(), T.BinaryType()


def struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])
