"""Grid cells against split lists and Spark's own bucketizer."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import Bucketizer, OneHotEncoder
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortkit import operators as op
from tests.plans import ran


def _points(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x float")


def _cells(df, step):
    rows = op.grid_buckets(df, {"x": "cell"}, step).orderBy("i").collect()
    return [r.cell for r in rows]


def test_small_cells(spark):
    assert _cells(_points(spark, [0.0, 0.4, 1.0, 2.5, None]), 1.0) == [0, 0, 1, 2, None]
    assert _cells(_points(spark, [0.0, 1.0, 2.0]), 1.0) == [0, 1, 1]


def test_equal_points_share_one_cell(spark):
    assert _cells(_points(spark, [3.5, 3.5, None]), 0.05) == [0, 0, None]


def test_all_missing(spark):
    assert _cells(_points(spark, [None, None]), 0.05) == [None, None]


def test_unbounded_points_do_not_stretch_the_grid(spark):
    values = [0.0, 1.0, 2.5, math.nan, math.inf, -math.inf]
    assert _cells(_points(spark, values), 1.0) == [0, 1, 2, None, None, None]


@pytest.mark.parametrize("step", [0.05, 0.1, 1 / 16, 0.3])
@pytest.mark.parametrize("low", [30.25, -85.6052, 0.0])
def test_same_cells_as_a_split_list(spark, step, low):
    """Random points and points put on the cell borders."""
    rng = random.Random(7)
    start = float(np.float32(low))
    values = [start] + [rng.uniform(start, start + 4) for _ in range(2000)]
    values += [float(np.float32(start + k * step)) for k in range(40)]
    df = _points(spark, values)
    top = df.agg(F.max("x")).first()[0]
    splits = list(np.arange(start, top + step, step))
    expected = Bucketizer(splits=splits, inputCol="x", outputCol="cell").transform(df)
    assert _cells(df, step) == [r.cell for r in expected.orderBy("i").collect()]


def test_same_cells_for_doubles_on_borders(spark):
    """Borders as doubles, where a plain division lands on the wrong side."""
    start, step = -85.60519, 0.05
    splits = np.arange(start, start + 3, step)
    values = [float(s) for s in splits]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    splits = list(np.arange(start, values[-1] + step, step))
    expected = Bucketizer(splits=splits, inputCol="x", outputCol="cell").transform(df)
    assert _cells(df, step) == [r.cell for r in expected.orderBy("i").collect()]


def test_rate_per_cell(spark):
    df = spark.createDataFrame(
        [(0.0, 0.0, 1), (0.4, 0.4, 0), (2.5, 0.0, 1), (None, 0.0, 1), (0.1, None, 1), (2.9, 1.5, None)],
        "x float, y float, flag int",
    )
    rate = op.grid_rate(df, {"x": "xc", "y": "yc"}, F.col("flag"), 1.0)
    assert {tuple(r) for r in rate.collect()} == {
        (0.0, 0.0, 0.5, 2),
        (2.0, 0.0, 1.0, 1),
        (2.0, 1.0, None, 1),
    }


def test_bounds_come_from_all_rows(spark):
    """A row without one coordinate still counts for the bounds of the other."""
    df = spark.createDataFrame(
        [(-5.0, None, 1), (0.0, 0.0, 1), (1.0, 1.0, 0)], "x float, y float, flag int"
    )
    rate = op.grid_rate(df, {"x": "xc", "y": "yc"}, F.col("flag"), 1.0)
    assert {r.xc for r in rate.collect()} == {5.0}


@pytest.mark.parametrize("parts", [1, 7])
def test_rows_with_both_coordinates_are_all_counted(spark, parts):
    df = spark.range(5000).select(
        F.when(F.col("id") % 11 > 0, F.rand(1).cast("float")).alias("x"),
        F.when(F.col("id") % 13 > 0, F.rand(2).cast("float")).alias("y"),
    )
    rate = op.grid_rate(df.repartition(parts), {"x": "xc", "y": "yc"}, F.lit(1))
    assert rate.agg(F.sum("n")).first()[0] == df.na.drop().count()


def test_one_hot_equals_spark(spark):
    df = spark.createDataFrame(
        [(0, 0.0, 1.0), (1, 2.0, 0.0), (2, None, 3.0), (3, 1.0, None)], "i int, a double, b double"
    )
    got = op.one_hot_grid(df, {"a": "av", "b": "bv"}).orderBy("i").collect()
    for cell, vector in (("a", "av"), ("b", "bv")):
        encoder = OneHotEncoder(inputCols=[cell], outputCols=[vector])
        fitted = encoder.fit(df.na.drop(subset=[cell]))  # Spark's fit fails on nulls
        expected = fitted.transform(df).orderBy("i").collect()
        assert [r[vector] for r in got] == [r[vector] for r in expected]
    assert [r.av for r in got][2] is None
    arrays = op.one_hot_grid(df, {"a": "av"}).filter("a is not null")
    assert [r[0] for r in arrays.orderBy("i").select(vector_to_array("av")).collect()] == [
        [1.0, 0.0], [0.0, 0.0], [0.0, 1.0],
    ]


def test_bounding_box(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, 5.0), (None, -2.0)], "a double, b double")
    assert op.bounding_box(df, ["a", "b"]).first().asDict() == {
        "min_a": 1.0, "max_a": 3.0, "min_b": -2.0, "max_b": 5.0,
    }


def test_bounding_box_leaves_out_what_the_grid_leaves_out(spark):
    rows = [(float("nan"),), (3.0,), (float("inf"),), (None,)]
    df = spark.createDataFrame(rows, "a double")
    assert tuple(op.bounding_box(df, ["a"]).first()) == (3.0, 3.0)


@pytest.mark.parametrize("step", [0.05, 0.3])
def test_counted_places_give_the_same_rates_from_one_scan(spark, tmp_path, step):
    """Points on borders, many rows to a place, null flags and missing coordinates."""
    rng = random.Random(3)
    borders = [float(np.float32(30.25 + k * step)) for k in range(12)]
    some = [*borders, *(rng.uniform(30.25, 33) for _ in range(40)), None, math.nan, math.inf]
    rows = [(rng.choice(some), rng.choice(some), rng.choice([0, 1, None])) for _ in range(4000)]
    spark.createDataFrame(rows, "x float, y float, f int").write.parquet(f"{tmp_path}/points")
    df = spark.read.parquet(f"{tmp_path}/points")
    axes = {"x": "a", "y": "b"}
    once = op.grid_rate(df, axes, df["f"], step, collapse=True)
    twice = op.grid_rate(df, axes, df["f"], step)
    assert once.columns == twice.columns
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert ran(once).count("FileScan parquet") == 1


def test_counted_places_of_no_rows(spark):
    df = spark.createDataFrame([], "x float, y float, f int")
    assert op.grid_rate(df, {"x": "a", "y": "b"}, df["f"], collapse=True).collect() == []
