"""Lookups, key-wise measures and skeletons on small hand-made rows."""

from pyspark.sql import functions as F

from treeloom.operators import lookups as L


def test_slice_and_unknown_names(spark):
    names = spark.createDataFrame([(1, "A b"), (2, " C"), (3, None)], "id long, name string")
    wanted = spark.createDataFrame([("a B ",), ("c",), ("d",)], "name string")
    matrix = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.1), (2, 3, 0.2)], "a_id long, b_id long, v double")
    assert [tuple(r) for r in L.sliced(matrix, names, wanted).select("a_id", "b_id", "v").collect()] == [(1, 2, 0.5)]
    assert [r.name for r in L.unknown(names, wanted).collect()] == ["d"]


def test_scaling_of_a_matrix_of_zeros(spark):
    zeros = spark.createDataFrame([(1, 2, 0.0)], "a_id long, b_id long, v double")
    assert L.scaled_by_largest(zeros, "v").head().v == 0.0
    assert L.scaled_by_largest(zeros.filter("false"), "v").count() == 0


def test_counts_and_clamp(spark):
    rows = spark.createDataFrame([(1, 0), (2, 0), (3, 4), (4, -1)], "id long, cluster int")
    assert tuple(L.cluster_counts(rows, "cluster").head()) == (4, 2, 1)
    clamped = spark.range(1).select(*[L.clamped_k(F.lit(k), F.lit(n)) for k, n in ((1, 9), (5, 9), (20, 9), (3, 2))]).head()
    assert tuple(clamped) == (2, 5, 8, 2)


def test_value_ops_of_missing_keys(spark):
    pairs = spark.createDataFrame([(1, ("x" * 200, None, "q", None), 2, (None, "y", "q", None))], "a_id long, a struct<k:string,l:string,m:string,n:string>, b_id long, b struct<k:string,l:string,m:string,n:string>")
    ops = {r.path: (r.op, len(r.from_val), len(r.to_val), r.dimension) for r in L.value_ops(pairs, ["k", "l", "m", "n"]).collect()}
    assert ops == {"k": ("delete", 120, 0, "structural"), "l": ("insert", 0, 1, "structural"), "m": ("match", 1, 1, "semantic")}


def test_contained_items_and_likeness_bounds(spark):
    got = spark.range(1).select(L.without_contained(F.array(*map(F.lit, ["Ab", "xaBc", "q", "Q", "q"]))).alias("l")).head().l
    assert got == ["xaBc", "q", "Q"]
    rows = [(1, ["<a>", "<b>", "</b>", "</a>"], 2, ["<a>", "<b>", "</b>", "</a>"]), (2, ["<a>", "</a>"], 3, []), (4, [], 5, [])]
    like = {r.a_id: r.similarity for r in L.spectral_likeness(spark.createDataFrame(rows, "a_id long, a array<string>, b_id long, b array<string>")).collect()}
    assert abs(like[1] - 1) < 1e-9 and like[2] == like[4] == 0
