"""Sums over shared words without a row a word, against those of joins."""

from pyspark.sql import functions as F

from treeloom.operators import features as M


def test_shared_words_are_those_of_joins(spark):
    docs = [(0, ["a", "b", "a"]), (1, ["a", "c"]), (2, []), (3, None), (4, ["x"] * 50 + ["y", "a"]), (5, ["x", "y", "y", ""]), (7, ["x"]), (8, ["ß", "x"])]
    rows = spark.createDataFrame(docs, "id long, words array<string>")
    pairs = spark.createDataFrame([(i, i + 1) for i in (0, 1, 2, 3, 4, 7)], "a_id long, b_id long")
    want = M.shared(M.counts(rows.select("id", F.explode("words").alias("w")), "id", "w"), pairs)
    got = M.shared_words(rows)
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(tuple, want.select(*got.columns).collect())) == sorted(map(tuple, got.collect()))
    none = M.shared_words(rows.filter("id > 100"))
    assert none.count() == 0
