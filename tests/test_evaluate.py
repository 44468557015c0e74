"""ROC, AUC, confusion and correlation against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from cohortkit import operators as op
from cohortkit.operators import evaluate
from tests.plans import ran


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame(
        [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.4), (1, 0.2)], "label int, score double"
    )


def _curve(labels, values):
    """Every threshold from high to low, by counting."""
    labels, values = np.array(labels), np.array(values)
    points = [(None, 0.0, 0.0)]
    for t in sorted(set(values.tolist()), reverse=True):
        at = values >= t
        points.append(
            (t, (at & (labels == 0)).sum() / (labels == 0).sum(), (at & (labels == 1)).sum() / (labels == 1).sum())
        )
    return points


def _points(df):
    rows = df.collect()
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, -(r[0] or 0)))


def _close(got, expected):
    assert [g[0] for g in got] == [e[0] for e in expected]
    assert np.allclose([g[1:] for g in got], [e[1:] for e in expected], atol=1e-12)


def test_roc_of_five_scores(scores):
    _close(
        _points(op.roc_points(scores, "score", "label")),
        [(None, 0, 0), (0.9, 0, 1 / 3), (0.8, 0.5, 2 / 3), (0.4, 1, 2 / 3), (0.2, 1, 1)],
    )


def test_auc_of_five_scores(scores):
    assert op.auc(scores, "score", "label").first()[0] == pytest.approx(0.583333, abs=1e-6)


@pytest.mark.parametrize("digits", [1, 6])
def test_roc_and_auc_of_many_scores(spark, digits):
    rng = random.Random(3)
    rows = [(int(rng.random() < 0.3 + 0.4 * s), round(s, digits)) for s in (rng.random() for _ in range(3000))]
    df = spark.createDataFrame(rows, "label int, score double").repartition(7)
    expected = _curve(*zip(*rows))
    _close(_points(op.roc_points(df, "score", "label")), expected)
    area = sum(
        (b[1] - a[1]) * (a[2] + b[2]) / 2 for a, b in zip(expected, expected[1:])
    )
    exact = op.auc(df, "score", "label").first()[0]
    assert exact == pytest.approx(area, abs=1e-12)
    evaluator = BinaryClassificationEvaluator(
        labelCol="label", rawPredictionCol="score", numBins=0
    )
    assert exact == pytest.approx(evaluator.evaluate(df), abs=1e-9)


def test_a_hot_score_and_missing_values(spark):
    """A third of the rows share one score; rows without score or label are left out."""
    df = spark.range(30000).select(
        (F.col("id") % 2).cast("int").alias("label"),
        F.when(F.col("id") % 3 == 0, 0.5).when(F.col("id") % 50 != 1, F.rand(5)).alias("score"),
    )
    df = df.unionAll(spark.sql("select cast(null as int), 0.7D"))
    rows = df.na.drop().collect()
    expected = _auc_by_rank([r.label for r in rows], [r.score for r in rows])
    assert op.auc(df, "score", "label").first()[0] == pytest.approx(expected, abs=1e-10)


def _auc_by_rank(labels, values):
    ranks = pd.Series(values).rank().to_numpy()
    labels = np.array(labels)
    pos, neg = (labels == 1).sum(), (labels == 0).sum()
    return (ranks[labels == 1].sum() - pos * (pos + 1) / 2) / (pos * neg)


def test_one_class_gives_null(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "label int, score double")
    assert op.auc(df, "score", "label").first()[0] is None
    assert {r.fpr for r in op.roc_points(df, "score", "label").filter("score > 0").collect()} == {None}


def test_no_rows(spark, scores):
    empty = scores.filter("score > 2")
    assert op.auc(empty, "score", "label").first()[0] is None
    assert [tuple(r) for r in op.roc_points(empty, "score", "label").collect()] == [(None, 0, 0)]


def test_confusion(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.0), (1, 0.0)], "label int, prediction double")
    long = op.confusion_long(df, "label", "prediction")
    assert {tuple(r) for r in long.collect()} == {(0, 0.0, 1), (1, 0.0, 2)}
    wide = op.pivot_counts(df, "label", "prediction")
    assert wide.columns == ["label", "0.0", "1.0", "other"]
    assert {tuple(r) for r in wide.collect()} == {(0, 1, 0, 0), (1, 2, 0, 0)}


def test_correlation_of_three_rows(spark):
    df = spark.createDataFrame([(1, 2.0, 1), (2, 4.1, 1), (3, 5.0, 1)], "a int, b double, k int")
    r = {(x.a, x.b): x.r for x in op.correlation_matrix(df, ["a", "b", "k"]).collect()}
    assert r["a", "b"] == r["b", "a"] == pytest.approx(0.974355, abs=1e-6)
    assert r["a", "a"] == r["b", "b"] == pytest.approx(1)
    assert {v for key, v in r.items() if "k" in key} == {None}
    assert len(r) == 9


def test_correlation_equals_pandas(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame(
        {
            "flag": rng.integers(0, 2, 4000),
            "age": rng.integers(18, 31, 4000),
            "income": rng.normal(60000, 20000, 4000),
            "far": 1e9 + rng.normal(0, 1, 4000),
        }
    )
    frame["income"] += 3000 * frame["age"]
    columns = list(frame.columns)
    got = op.correlation_matrix(spark.createDataFrame(frame).repartition(7), columns).collect()
    expected = frame.corr()
    assert len(got) == 16
    for row in got:
        assert row.r == pytest.approx(expected.loc[row.a, row.b], abs=1e-7)


def test_correlation_uses_complete_rows(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 1), (9, None)], "a int, b int")
    r = {(x.a, x.b): x.r for x in op.correlation_matrix(df, ["a", "b"]).collect()}
    assert r["a", "b"] == pytest.approx(0.0, abs=1e-12)


def test_pivot_counts_lose_no_row(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 2.0), (0, None), (1, 1.0)], "label int, prediction double")
    wide = {r.label: tuple(r)[1:] for r in op.pivot_counts(df, "label", "prediction").collect()}
    assert wide == {0: (1, 0, 2), 1: (0, 1, 0)}


def test_labels_other_than_0_and_1_are_not_on_the_curve(spark):
    rows = [(0.9, 1.0), (0.8, 0.7), (0.4, 0.0), (0.3, 2.0), (0.2, 1.0)]
    df = spark.createDataFrame(rows, "score double, label double")
    known = df.filter("label in (0, 1)")
    points = lambda d: sorted(map(str, op.roc_points(d, "score", "label").collect()))
    assert points(df) == points(known)
    assert op.auc(df, "score", "label").first()[0] == 0.5


@pytest.mark.parametrize("judge", [op.auc, op.roc_points])
def test_curves_read_the_input_once_and_only_when_asked(spark, tmp_path, judge):
    rows = spark.range(5000).select(F.rand(1).alias("score"), (F.col("id") % 2).alias("label"))
    rows.write.parquet(f"{tmp_path}/rows")
    read = spark.read.parquet(f"{tmp_path}/rows")
    spark.sparkContext.setJobGroup(judge.__name__, "curve")
    built = judge(read, "score", "label")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup(judge.__name__)
    built.collect()
    assert ran(built).count("FileScan parquet") == 1
    assert ran(built).count("ReusedExchange") >= 1


@pytest.mark.parametrize("ranges", [1, 2, 5, 256])
def test_any_number_of_ranges_gives_one_curve(spark, ranges, monkeypatch):
    rows = [(int(k * 7919 % 100 < 40), (k * 31 % 97) / 97) for k in range(900)]
    df = spark.createDataFrame(rows, "label int, score double").repartition(3)
    steps = evaluate._cumulated(df, "score", "label", ranges)
    got = sorted((r.score, r.cum_pos, r.cum_neg) for r in steps.collect())
    expected = [
        (s, sum(l for l, v in rows if v >= s), sum(1 - l for l, v in rows if v >= s)) for s in sorted({v for _, v in rows})
    ]
    assert got == expected
    assert steps.select("part").distinct().count() == min(ranges, len(expected))
