"""Many columns, many reports and many files: what is read, and that results are the same."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortkit import operators as op
from cohortkit.plans import PEOPLE, VOTER_FILE, Analyses
from cohortkit.sources import people
from tests.plans import ran

TABLES = "/root/testdata/sf0.001"
REPORTS = (
    "group_details", "group_counts", "group_share", "turnout_by_group", "turnout_by_age", "totals_by_age",
    "turnout_by_gender", "turnout_by_income", "turnout_by_income_gender", "age_by_group", "income_by_group",
)


def _rows(df):
    round_ = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(map(round_, r)) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def voters_with_gaps(spark):
    """The registration file's columns, as text, with null keys and unreadable values."""
    i = F.col("id")
    text = lambda column: column.cast("string")
    return spark.range(2000).select(
        F.lit("MURRAY").alias("County"),
        F.when(i % 31 > 0, F.when(i % 17 == 0, "100").when(i % 19 == 0, "x").otherwise(text(18 + i % 40))).alias("Voters_Age"),
        F.when(i % 5 > 0, F.when(i % 2 == 0, "M").otherwise("F")).alias("Voters_Gender"),
        F.when(i % 7 > 0, F.concat(F.lit("G"), i % 4)).alias("Ethnic_Description"),
        F.when(i % 3 > 0, F.concat(F.lit("E"), i % 3)).alias("EthnicGroups_EthnicGroup1Desc"),
        F.concat(F.lit("band"), i % 6).alias("CommercialData_EstimatedHHIncome"),
        F.when(i % 11 > 0, F.concat(F.lit("$"), 20000 + (i * 37) % 90000)).alias("CommercialData_EstimatedHHIncomeAmount"),
        F.when((i * 7919) % 11 < 6, "Y").when(i % 3 == 0, "N").when(i % 13 == 0, "A").alias("General_2020"),
    )


@pytest.mark.parametrize("report", REPORTS)
def test_reports_of_one_scan_are_the_single_reports(spark, voters_with_gaps, report, stored):
    for analyses, reports in stored:
        single, shared = getattr(analyses, report)(), getattr(reports, report)()
        assert shared.columns == single.columns
        assert _rows(shared) == _rows(single)


@pytest.fixture(scope="module")
def stored(spark, voters_with_gaps):
    both = [Analyses(voters_with_gaps, VOTER_FILE), Analyses(people(spark, TABLES), PEOPLE)]
    out = [(a, a.group_reports()) for a in both]
    yield out
    for _, reports in out:
        reports.close()


def test_all_group_reports_read_the_table_once(spark, voters_with_gaps, tmp_path):
    voters_with_gaps.write.parquet(f"{tmp_path}/voters")
    totals = Analyses(spark.read.parquet(f"{tmp_path}/voters"), VOTER_FILE).group_totals()
    totals.collect()
    plan = ran(totals)
    assert plan.count("FileScan parquet") == 1
    assert plan.count("Exchange hashpartitioning") == 1
    partial = plan[plan.index("Exchange hashpartitioning") :]
    assert "HashAggregate" in partial and "Expand" in partial


def test_two_reports_with_the_same_keys_are_refused(voters_with_gaps):
    key = {"g": voters_with_gaps["Voters_Gender"]}
    with pytest.raises(ValueError, match="same keys"):
        op.totals_by_sets(voters_with_gaps, key, {"one": ["g"], "two": ["g"]}, {})


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("wide") / "table")
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({f"c{k}": np.where(rng.random(500) < k / 700, None, "x") for k in range(600)})
    spark.createDataFrame(frame, ", ".join(f"c{k} string" for k in range(600))).repartition(3).write.parquet(path)
    return spark.read.parquet(path), frame


def test_nulls_of_600_columns_in_generated_code(wide):
    df, frame = wide
    counts = op.null_counts(df)
    assert counts.columns == df.columns
    expected = frame.isna().sum()
    assert counts.first().asDict() == expected.to_dict()
    ratios = {r.column_name: r.null_ratio for r in op.null_ratios(df).collect()}
    assert ratios == {c: pytest.approx(n / 500, abs=6e-4) for c, n in expected.items()}
    for result in (counts, op.null_ratios(df)):
        result.collect()
        scans = [line for line in ran(result).splitlines() if "FileScan parquet" in line]
        assert len(scans) == 7 and all("Batched: true" in line for line in scans)
        partial = [line for line in ran(result).splitlines() if "HashAggregate" in line and "partial_count" in line]
        assert len(partial) >= 7 and all("*(" in line for line in partial if "c0" in line or "c599" in line)


def test_nulls_of_an_empty_wide_table(wide):
    df = wide[0].filter("c0 = 'no'")
    assert set(op.null_counts(df).first()) == {0}
    assert {r.null_ratio for r in op.null_ratios(df).collect()} == {None}


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(3000, 200))
    base[:, 1:] += 0.5 * base[:, :-1]
    frame = pd.DataFrame(base, columns=[f"x{k}" for k in range(200)])
    frame["x7"] += 1e9  # far from zero
    frame["x9"] = 5.0
    frame.loc[::50, "x3"] = np.nan
    return spark.createDataFrame(frame).repartition(9), frame


def test_correlations_of_200_columns(numbers):
    df, frame = numbers
    found = op.correlation_matrix(df, list(frame.columns))
    got = {(r.a, r.b): r.r for r in found.collect()}
    expected = frame.dropna().corr()
    assert len(got) == 200 * 200
    for (a, b), r in got.items():
        if "x9" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(expected.loc[a, b], abs=1e-6)


def test_wide_correlations_are_the_narrow_ones_from_one_scan(spark, numbers, tmp_path):
    df, frame = numbers
    df.write.parquet(f"{tmp_path}/numbers")
    stored = spark.read.parquet(f"{tmp_path}/numbers")
    some = [f"x{k}" for k in (0, 1, 2, 7, 9)]
    wide = op.wide_correlations(stored, some)
    got = {(r.a, r.b): r.r for r in wide.collect()}
    # The narrow form takes a NaN for a number.
    narrow = {(r.a, r.b): r.r for r in op.correlation_matrix(stored, some).collect()}
    assert got.keys() == narrow.keys()
    for pair, r in narrow.items():
        assert got[pair] == (None if r is None else pytest.approx(r, abs=1e-7 if "x7" in pair else 1e-10))
    assert ran(wide).count("FileScan parquet") == 1
    assert "struct<x0:double,x1:double,x2:double,x7:double,x9:double>" in ran(wide)


def test_correlations_without_rows(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert {r.r for r in op.wide_correlations(df, ["a", "b"]).collect()} == {None}


def test_a_sample_of_files_opens_only_those(spark, tmp_path):
    spark.range(4000).repartition(40).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    sample = op.file_sample(df, 0.25)
    again = op.file_sample(spark.read.parquet(f"{tmp_path}/t"), 0.25)
    ids = sorted(r.id for r in sample.collect())
    assert ids == sorted(r.id for r in again.collect()) and 0 < len(ids) < 2500
    leaf = sample._jdf.queryExecution().executedPlan().collectLeaves().head()
    sample._jdf.queryExecution().executedPlan().executeCollect()
    files = leaf.metrics().apply("numFiles").value()
    assert abs(files * 100 - len(ids)) < 50 and files < 25
    other = op.file_sample(df, 0.25, seed=1)
    assert sorted(r.id for r in other.collect()) != ids
    assert op.file_sample(df, 1).count() == 4000 and op.file_sample(df, 0).count() == 0
    with pytest.raises(ValueError):
        op.file_sample(df, 1.5)
