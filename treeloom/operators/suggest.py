"""Nearest-name suggestions: names that resemble an unknown one by the share of letters in common blocks.

The ratio of two names is twice the letters of their matching blocks over both lengths. Blocks match no more letters
than the names share, counted with repeats; so a ratio of at least the cutoff asks for a known overlap of the letters
(the second `a` of a name being a letter of its own), and each name is looked up by so few of its rarest letters that
it still meets every partner there. What it meets is counted, and only then compared block by block.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def letters(key: str) -> Column:
    """Each letter of a key with its number among equal ones."""
    single = F.filter(F.split(key, ""), lambda c: c != "")
    return F.transform(single, lambda c, i: F.concat(c, F.size(F.filter(F.slice(single, F.lit(1), i + 1), lambda x: x == c)).cast("string")))


def _indexed(keys: DataFrame, cutoff: float) -> DataFrame:
    """(key, n, letter, at) of the rarest letters that a key is looked up by, by their counts over all keys."""
    rows = keys.select("key", F.length("key").alias("n"), F.explode(letters("key")).alias("letter"))
    often = rows.groupBy("letter").agg(F.count("*").alias("times"))
    placed = rows.join(often, "letter").withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy("times", "letter")))
    # the shortest partner is cutoff / (2 - cutoff) of the name's length; with it the fewest letters are shared
    fewest = F.ceil(F.col("n") * F.lit(cutoff) / F.lit(2 - cutoff) - F.lit(1e-9))
    return placed.filter(F.col("at") <= F.col("n") - fewest + 1).select("key", "n", "letter")


def close_names(names: DataFrame, known: DataFrame, k: int = 5, cutoff: float = 0.6) -> DataFrame:
    """(key, rank, match, ratio): for each key of names the k best keys of known with at least the ratio; ties go to the later key in order.

    names and known are (key); nulls and repeats are left out, and so are keys that are known.
    """
    asked = names.filter("key is not null and key <> ''").distinct().join(known, "key", "left_anti")
    there = known.filter("key is not null and key <> ''").distinct()
    both = asked.unionByName(there).distinct()
    index = _indexed(both, cutoff)
    x = index.join(asked, "key", "left_semi")
    y = index.join(there, "key", "left_semi").select(F.col("key").alias("match"), F.col("n").alias("m"), "letter")
    long_enough = 2 * F.least("n", "m") >= F.lit(cutoff) * (F.col("n") + F.col("m")) - F.lit(1e-9)
    met = x.join(y, "letter").filter(long_enough).select("key", "match").distinct()

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        out, matcher, last = [], difflib.SequenceMatcher(), None
        for name, other in zip(a, b, strict=True):
            if name != last:
                matcher.set_seq2(name)
                last = name
            matcher.set_seq1(other)
            out.append(matcher.ratio() if matcher.quick_ratio() >= cutoff else 0.0)
        return pd.Series(out, dtype=float)

    found = met.withColumn("ratio", ratio("key", "match")).filter(F.col("ratio") >= cutoff)
    best = Window.partitionBy("key").orderBy(F.desc("ratio"), F.desc("match"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("key", "rank", "match", "ratio")
