"""Leaf costs against values worked out by hand from their definitions."""

import math

import pytest
from pyspark.sql import functions as F

from treeloom.functions import costs


def value(spark, column):
    return spark.range(1).select(column.alias("v")).head().v


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [(1.0, 2.0, math.log(2) / math.log(100)), (1.0, 10.0, 0.5), (1.0, 100.0, 1.0), (1.0, 1000.0, 1.0), (None, 5.0, 0.5), (None, None, 0.5), (0.0, 4.0, 1.0), (0.0, 0.0, 0.0), (-2.0, 2.0, 1.0)],
)
def test_numeric(spark, a, b, expected):
    assert value(spark, costs.numeric_cost(F.lit(a).cast("double"), F.lit(b).cast("double"))) == pytest.approx(expected)


@pytest.mark.parametrize(("a", "b", "expected"), [("Federal republic", "Federal presidential republic", 1 / 3), ("", "x", 1.0), ("", "", 0.0), (None, None, 0.0), ("ß", "é", 0.0)])
def test_string(spark, a, b, expected):
    assert value(spark, costs.string_cost(F.lit(a).cast("string"), F.lit(b).cast("string"))) == pytest.approx(expected)


@pytest.mark.parametrize(("a", "b", "expected"), [({"A": 50.0, "B": 50.0}, {"A": 100.0}, 0.5), ({}, {"A": 1.0}, 1.0), ({}, {}, 0.0)])
def test_distribution(spark, a, b, expected):
    row = spark.createDataFrame([(a, b)], "a map<string,double>, b map<string,double>")
    assert row.select(costs.distribution_cost(F.col("a"), F.col("b")).alias("v")).head().v == pytest.approx(expected)


@pytest.mark.parametrize(("degree", "expected"), [(1, 0.25), (3, 0.15625), (5, 0.103515625)])
def test_sharpen(spark, degree, expected):
    assert value(spark, costs.sharpen(F.lit(0.25), degree)) == pytest.approx(expected)
    with pytest.raises(ValueError):
        costs.sharpen(F.lit(0.1), 2)


def test_similarity_methods(spark):
    from treeloom.operators.ted import similarity

    n = F.lit(37)
    assert value(spark, similarity(F.lit(10.0), n, n)) == pytest.approx(0.763173, abs=1e-6)
    assert value(spark, similarity(F.lit(10.0), n, n, "inv")) == pytest.approx(1 / 11)
    assert value(spark, similarity(F.lit(10.0), n, n, "exp")) == pytest.approx(math.exp(-10))


def test_text_numbers(spark):
    from treeloom.functions import text as X

    assert value(spark, X.billions(F.lit("$4.504 trillion (10th)"))) == 4504.0
    assert value(spark, X.billions(F.lit("$850 million"))) == 0.85
    assert value(spark, X.world_rank(F.lit("632,702 km2 (42nd)"))) == 42
    assert value(spark, X.first_number(F.lit("632,702.3 km2"))) == 632702.3
    assert value(spark, X.digits_only(F.lit("$65,626 (25th)"))) == 65626
    assert value(spark, X.snake_case(F.lit("Vice-President"))) == "vice_president"
    assert value(spark, X.utc_offset(F.lit("UTC+5:30 (IST)"))) == "UTC+05:30"
    assert value(spark, X.utc_offset(F.lit("UTC"))) == "UTC+00:00"
    assert value(spark, X.percent(F.lit("-42%"))) == 42.0
