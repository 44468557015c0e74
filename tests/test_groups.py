"""Group and profile operators on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from cohortkit import operators as op
from cohortkit.functions import flag_equals, flag_translate, parse_money


@pytest.fixture
def young(voters):
    return op.cohort(voters, {"county": "MURRAY"}, {"age": (18, 30)})


def _rows(df):
    return [tuple(r) for r in df.collect()]


def _set(df):
    return set(_rows(df))


def test_group_counts_leaves_out_null_and_sorts(young):
    assert _rows(op.group_counts(young, "grp")) == [("A", 2), ("B", 1)]


def test_group_share_keeps_null(young):
    assert _set(op.group_share(young, "grp")) == {("A", 2, 0.5), ("B", 1, 0.25), (None, 1, 0.25)}


def test_shares_sum_to_one(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"))
    assert op.group_share(df, "g").agg(F.sum("share")).first()[0] == pytest.approx(1)


def test_rate_with_unreadable_flags(young, voters):
    rate = op.mean_by(young, "grp", flag_translate(young["voted"]), "rate", drop_null_keys=True)
    assert _set(rate) == {("A", 0.5), ("B", 0.0)}
    unreadable = voters.filter("id = 7")
    flag = flag_translate(unreadable["voted"])
    assert _rows(op.mean_by(unreadable, "grp", flag)) == [("B", None)]
    assert _rows(op.mean_by(unreadable, "grp", flag, drop_null_means=True)) == []


def test_rate_by_age_in_numeric_order(voters):
    df = voters.withColumn("age", op.int_column(voters, "age"))
    df = df.filter(df["age"] != 100)
    rate = op.mean_by(df, "age", flag_equals(df["voted"])).orderBy("age")
    assert _rows(rate) == [(18, 0.0), (20, 1.0), (25, 1.0), (30, 0.0), (31, 1.0)]


def test_totals(voters):
    totals = op.totals_by(voters, "county", flag_equals(voters["voted"]))
    assert _set(totals) == {("MURRAY", 7, 4), ("OTHER", 1, 1)}


def test_means(voters):
    income = op.mean_by(voters, "grp", parse_money(voters["income"]))
    assert _set(income) == {("A", 12843.5), ("B", 53.5), (None, 20.0)}
    age = op.mean_by(voters, "grp", op.int_column(voters, "age"))
    means = {r.grp: r.mean for r in age.collect()}
    assert means["A"] == pytest.approx(68 / 3)
    assert means["B"] == pytest.approx(161 / 3)


def test_two_keys(voters):
    both = op.mean_by(voters, ["county", "gender"], flag_equals(voters["voted"]))
    assert both.count() == 4


def test_distinct_and_count(young):
    assert _set(op.distinct_values(young, "grp")) == {("A",), ("B",), (None,)}
    assert _rows(op.row_count(young)) == [(4,)]


def test_null_counts_and_ratios(voters):
    counts = op.null_counts(voters).first().asDict()
    assert counts == {
        "id": 0, "county": 0, "age": 1, "gender": 1, "grp": 1, "voted": 1, "income": 1,
        "interest": 2,
    }
    ratios = dict(_rows(op.null_ratios(voters)))
    assert ratios == {c: {0: 0.0, 1: 0.125, 2: 0.25}[n] for c, n in counts.items()}
    assert set(dict(_rows(op.null_ratios(voters.filter("id < 0")))).values()) == {None}


def test_null_ratio_rounds_half_up(spark):
    df = spark.range(80).select(F.when(F.col("id") > 0, 1).alias("c"))
    assert _rows(op.null_ratios(df)) == [("c", 0.013)]


def test_flag_profile(young, voters):
    assert _rows(op.flag_profile(young, ["interest"])) == [("interest", 1, 3, 0.25)]
    empty = voters.filter("id < 0")
    assert _rows(op.flag_profile(empty, ["interest"])) == [("interest", 0, 0, 0.0)]


def test_flag_counts_hold_only_values_that_occur(young):
    assert _set(op.flag_counts(young, ["interest"])) == {("interest", 0, 3), ("interest", 1, 1)}
    yes = young.filter("interest = 'Yes'")
    assert _rows(op.flag_ratios(yes, ["interest"])) == [("interest", 1, 1, 1.0)]


@pytest.mark.parametrize("parts", [1, 7])
def test_partitioning_changes_nothing(voters, parts):
    placed = voters.repartition(parts)
    flag = flag_equals(voters["voted"])
    assert _set(op.group_share(placed, "grp")) == _set(op.group_share(voters, "grp"))
    assert _set(op.mean_by(placed, "grp", flag)) == _set(op.mean_by(voters, "grp", flag))
    assert _set(op.null_counts(placed)) == _set(op.null_counts(voters))
