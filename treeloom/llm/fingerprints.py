"""Document fingerprints: bottom-k sketches of word shingle hashes. DataFrame functions only.

A fingerprint is the sorted list of the k smallest different 64-bit hashes of a text's shingles: runs of `words`
words, A-Z lower-cased; a shorter text is one shingle, a text without words has none. Sketches of parts merge into
that of the whole, and estimate resemblance, containment and the number of different shingles.

Null text counts as empty. Two empty sketches resemble each other wholly, an empty and another one not at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SEPARATORS, shuffle_partitions

K = 64


def sketch(text: Column, k: int = K, words: int = 5) -> Column:
    """Array of the k smallest shingle hashes."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hashed = F.transform(F.filter(F.split(lowered, WORD_SEPARATORS), lambda w: w != ""), lambda w: F.xxhash64(w))
    starts = lambda h: F.sequence(F.lit(0), F.greatest(F.size(h) - words, F.lit(0)))
    # the words' hashes are combined in turn, each over the one before: order counts
    shingle = lambda h, i: reduce(lambda a, j: F.xxhash64(a, F.get(h, i + j)), range(1, words), F.get(h, i))
    # F.transform over one array keeps the list of word hashes evaluated once
    all_of = F.flatten(F.transform(F.array(hashed), lambda h: F.when(F.size(h) > 0, F.transform(starts(h), lambda i: shingle(h, i))).otherwise(F.array().cast("array<bigint>"))))
    return F.slice(F.sort_array(F.array_distinct(all_of)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the merged sketch's hashes that both have: an unbiased estimate of the Jaccard likeness."""
    both = merge(a, b, k)
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below k; else (k - 1) over the share of the hash range up to the k-th hash."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    j, n = resemblance(a, b, k), distinct_shingles(a, k)
    both = j / (1 + j) * (n + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / n))


def to_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, words: int = 5) -> DataFrame:
    """doc_id, sketch, distinct_shingles of every row."""
    return docs.select(F.col(id_col).alias("doc_id"), sketch(F.coalesce(F.col(text_col), F.lit("")), k, words).alias("sketch")).withColumn("distinct_shingles", distinct_shingles(F.col("sketch"), k))


def with_next(rows: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Adds next_<column> of the row that follows in descending order of the id (after the last: the first).

    Rows are cut into ranges of ids at approximate percentiles; each range also gets a copy of the row that
    follows its last one, so no window crosses ranges. Only the cuts and one id per range reach the driver.
    Equal ids follow each other in order of the other columns; null ids come last.
    """
    spark = rows.sparkSession
    n = 4 * shuffle_partitions(spark)
    key = F.col(id_col)
    cuts = rows.select(F.percentile_approx(key, [(i + 1) / n for i in range(n - 1)], 10_000)).head()[0] or []
    cuts = sorted(set(cuts))
    bucket = F.when(key.isNull(), F.lit(-1)).otherwise(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c < key)))
    tops = {r[0]: r[1] for r in rows.select(bucket.alias("b"), key.alias("k")).groupBy("b").agg(F.max("k")).collect()}
    order = sorted(tops, reverse=True)
    before = {tops[b]: order[i - 1] for i, b in enumerate(order)}  # the range that b's first row also closes
    lead = F.lit(None).cast("int")
    for i in range(0, len(order), 64):  # nested: a flat chain of a thousand tests would be slow
        part = [b for b in order[i : i + 64] if tops[b] is not None]
        if part:
            test = F.lit(None).cast("int")
            for b in part:
                test = F.when(key == tops[b], F.lit(before[tops[b]])).otherwise(test)
            lead = F.when(key.between(min(tops[b] for b in part), max(tops[b] for b in part)), test).otherwise(lead)
    if None in before:
        lead = F.when(key.isNull(), F.lit(before[None])).otherwise(lead)
    from pyspark.sql import Window

    home = rows.withColumn("__own", bucket)
    dealt = home.withColumn("__seats", F.when(lead.isNull(), F.array(F.struct(F.col("__own").alias("b"), F.lit(False).alias("guest")))).otherwise(F.array(F.struct(F.col("__own").alias("b"), F.lit(False).alias("guest")), F.struct(lead.alias("b"), F.lit(True).alias("guest")))))
    seated = dealt.withColumn("__seat", F.explode("__seats")).drop("__seats", "__own")
    w = Window.partitionBy(F.col("__seat.b")).orderBy(F.col("__seat.guest"), key.desc_nulls_last(), *[F.col(c) for c in rows.columns if c != id_col and c in ("text",)])
    return seated.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns]).filter(~F.col("__seat.guest")).drop("__seat")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, words: int = 5) -> DataFrame:
    """Fingerprints of each text and of its second half replaced by the start of the next document, and their likenesses."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("sketch", sketch(F.col("text"), k, words)), "doc_id", ["text", "sketch"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "sketch", "next_sketch", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.array(sketch(F.col("edited"), k, words)).alias("__e"))
    rows = rows.select("*", F.explode("__e").alias("edited_sketch")).drop("__e")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", to_text(F.col("sketch")).alias("fingerprint"), to_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("distinct_shingles"),
    )
