"""Column functions and row operators on hand-made rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from cohortkit import operators as op
from cohortkit.functions import (
    flag_equals,
    flag_translate,
    hash_bucket,
    parse_money,
    to_float,
    to_int,
)


@pytest.fixture(params=["true", "false"])
def ansi(spark, request):
    """Runs a test with ANSI mode on and off."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield request.param
    spark.conf.set("spark.sql.ansi.enabled", before)


def _texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i int, t string")


def _apply(df, expression):
    return [r.v for r in df.select("i", expression.alias("v")).orderBy("i").collect()]


def test_flags(spark, ansi, voters):
    rows = voters.orderBy("id")
    assert [r[0] for r in rows.select(flag_translate(rows["voted"])).collect()] == [
        1, 0, 0, 1, 1, 1, None, 1,
    ]
    assert [r[0] for r in rows.select(flag_equals(rows["voted"])).collect()] == [
        1, 0, 0, 1, 1, 1, 0, 1,
    ]


def test_flag_translate_works_on_characters(spark, ansi):
    df = _texts(spark, ["YN", "Y", "N", None, "", "A", "y"])
    assert _apply(df, flag_translate(df["t"])) == [10, 1, 0, 0, None, None, None]


@pytest.mark.parametrize(
    ("mode", "expected"),
    [
        ("strip_dollar", [50000, None, 77, None, 100, 20, 30, 40]),
        ("strip_all", [50000, 1234, 77, None, 100, 20, 30, 40]),
        ("substr", [50000, None, 7, None, 100, 20, 30, 40]),
    ],
)
def test_money(spark, ansi, voters, mode, expected):
    rows = voters.orderBy("id")
    assert [r[0] for r in rows.select(parse_money(rows["income"], mode)).collect()] == expected


def test_money_rejects_unknown_mode():
    with pytest.raises(ValueError, match="mode must be one of"):
        parse_money(None, "other")


def test_to_int_cuts_fractions_and_keeps_bad_text_out(spark, ansi):
    df = _texts(spark, ["25", " 25 ", "25.7", "-25.7", ".5", "abc", "1e3", "", None, "99999999999"])
    assert _apply(df, to_int(df["t"])) == [25, 25, 25, -25, 0, None, None, None, None, None]


def test_to_int_reads_a_lone_point_as_zero(spark, ansi):
    df = _texts(spark, [".", "-.5", "+7.", " 25.9 ", "2.5.1", "1.e3"])
    assert _apply(df, to_int(df["t"])) == [0, 0, 7, 25, None, None]


def test_flag_characters_are_checked():
    for yes, no in (("Yes", "N"), ("Y", ""), ("Y", "Y")):
        with pytest.raises(ValueError, match="different characters"):
            flag_translate(F.lit("x"), yes, no)


def test_small_samples_are_not_rounded_away(spark):
    df = spark.range(200000)
    hashes = [int(hashlib.md5(str(i).encode()).hexdigest()[8:23], 16) for i in range(200000)]
    expected = {i for i, h in enumerate(hashes) if h < round(2e-5 * 16**15)}
    assert {r.id for r in op.hash_sample(df, "id", 2e-5).collect()} == expected
    fraction = (min(hashes) + 1) / 16**15  # far below a millionth of the buckets
    assert op.hash_sample(df, "id", fraction * 1.0000001).count() == 1
    for wrong in (-0.1, 1.1):
        with pytest.raises(ValueError, match="fraction"):
            op.hash_sample(df, "id", wrong)


def test_money_reads_long_text_whole(spark):
    df = _texts(spark, ["$" + "0" * 150 + "7"])
    assert _apply(df, parse_money(df["t"], "substr")) == [7]


def test_to_float_is_32_bit(spark, ansi):
    df = _texts(spark, ["0.1", "x", None])
    assert _apply(df, to_float(df["t"]).cast("double")) == [0.10000000149011612, None, None]


def test_cohort(spark, ansi, voters):
    young = op.cohort(voters, {"county": "MURRAY"}, {"age": (18, 30)})
    assert sorted(r.id for r in young.collect()) == [1, 2, 3, 6]
    assert dict(young.dtypes)["age"] == "int"


def test_complete_cases_and_fill(voters):
    assert sorted(r.id for r in op.complete_cases(voters).collect()) == [1, 5, 7]
    some = op.complete_cases(voters, ["income", "age"])
    assert sorted(r.id for r in some.collect()) == [1, 2, 3, 5, 6, 7]
    filled = op.fill_nulls(voters, "N", ["voted"])
    assert filled.filter("voted is null").isEmpty()
    assert filled.filter("gender is null").count() == 1


def test_flag_columns_and_rename(voters):
    flags = op.flag_columns(voters, {"interest": "Yes", "gender": "M"}).orderBy("id").collect()
    assert [r.interest for r in flags] == [1, 0, 0, 1, 1, 0, 0, 1]
    assert [r.gender for r in flags] == [1, 0, 0, 0, 0, 1, 1, 0]
    renamed = op.rename_columns(voters, {"grp": "The Group", "age": "Age Now"})
    assert renamed.columns == [
        "id", "county", "Age Now", "gender", "The Group", "voted", "income", "interest",
    ]


def test_first_rows(voters):
    assert [r.id for r in op.first_rows(voters.repartition(7), "id", 3).collect()] == [1, 2, 3]


def test_hash_split_is_whole_and_repeatable(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    df = df.unionAll(spark.createDataFrame([(None,), (None,)], "k bigint"))
    train, test = op.hash_split(df, "k")
    assert train.count() + test.count() == 20002
    assert abs(train.count() / 20002 - 0.8) < 0.01
    again = op.hash_split(df.repartition(7), "k")[1]
    assert sorted(r.k or -1 for r in test.collect()) == sorted(r.k or -1 for r in again.collect())
    tagged = op.tag_split(df, "k")
    assert tagged.filter("part = 'test'").count() == test.count()


def test_hash_bucket_is_md5(spark):
    import hashlib

    df = spark.range(50)
    for offset in (1, 9):
        got = [r.v for r in df.select(hash_bucket(F.col("id"), 1000, offset).alias("v")).collect()]
        digests = [hashlib.md5(str(i).encode()).hexdigest() for i in range(50)]
        assert got == [int(d[offset - 1 : offset + 7], 16) % 1000 for d in digests]


def test_hash_sample_then_split_stays_unbiased(spark):
    df = spark.range(100000)
    sample = op.hash_sample(df, "id", 0.1)
    assert abs(sample.count() - 10000) < 400
    train, _ = op.hash_split(sample, "id")
    assert abs(train.count() / sample.count() - 0.8) < 0.02


def test_random_sample_and_split_cover(spark):
    df = spark.range(10000)
    assert abs(op.random_sample(df, 0.1).count() - 1000) < 200
    train, test = op.random_split(df)
    assert train.count() + test.count() == 10000
