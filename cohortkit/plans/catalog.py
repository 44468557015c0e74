"""Registered queries: name to a function of session and table directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortkit import operators as op
from cohortkit.functions import flag_equals, flag_translate, parse_money, to_float
from cohortkit.plans.analyses import Analyses, ModelRun
from cohortkit.plans.layout import PEOPLE
from cohortkit.sources import cut_lineage, keep, people

Query = Callable[[SparkSession, str], DataFrame]

COUNTY = "NATION_3"
INTERESTS = list(PEOPLE.plotted_interests)
SAMPLE_FRACTION = 0.01


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles at six digits, the precision results are compared at; floats
    widened to doubles."""
    plain = {T.FloatType: lambda c: c.cast("double"), T.DoubleType: lambda c: F.round(c, 6)}
    return df.withColumns(
        {
            f.name: plain[type(f.dataType)](df[f.name])
            for f in df.schema.fields
            if type(f.dataType) in plain
        }
    )


def _on_people(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, directory: _rounded(build(people(spark, directory)))


def _analysis(build: Callable[[Analyses], DataFrame]) -> Query:
    return _on_people(lambda df: build(Analyses(df, PEOPLE)))


def _in_cohort(build: Callable[[Analyses], DataFrame]) -> Query:
    return _analysis(lambda a: build(a.cohort(COUNTY)))


def _column(name: str, value: Callable[[DataFrame], Column]) -> Query:
    return _on_people(lambda df: df.select("person_id", value(df).alias(name)))


def _model(run: Callable[[Analyses], ModelRun], view: Callable[[ModelRun], DataFrame]) -> Query:
    return _analysis(lambda a: view(run(a)))


def _by_age(judge: Callable[[DataFrame], DataFrame]) -> Query:
    """Judges age as if it were a score for the vote: a fixed score to check."""

    def build(df: DataFrame) -> DataFrame:
        return judge(
            df.select(
                op.int_column(df, "age").alias("score"),
                flag_equals(df["voted"]).alias("label"),
            )
        )

    return _on_people(build)


def _by_age_limit(judge: Callable[[DataFrame], DataFrame]) -> Query:
    """Judges the prediction "votes if 50 or older"."""
    return _by_age(
        lambda df: judge(
            df.withColumn("prediction", F.when(df["score"] >= 50, 1.0).otherwise(0.0))
        )
    )


def _vector_shape(cell: str, vector: str) -> list[Column]:
    """Length of a one-hot vector and the index of its 1 (none for the last cell)."""
    array = F.when(F.col(vector).isNotNull(), vector_to_array(vector))
    hot = F.nullif(F.array_position(array, F.lit(1.0)), F.lit(0).cast("bigint")) - 1
    return [F.array_size(array).alias(f"{cell}_length"), hot.alias(f"{cell}_hot")]


_AXES = {"longitude": "long_bucket", "latitude": "lat_bucket"}


def _points(df: DataFrame) -> DataFrame:
    return df.select("person_id", *[to_float(df[name]).alias(name) for name in _AXES])


def _cells(df: DataFrame) -> DataFrame:
    return op.grid_buckets(_points(df), _AXES).select("person_id", *_AXES.values())


def _one_hot(df: DataFrame) -> DataFrame:
    points = _points(df)
    bounds = op.grid_bounds(points, list(_AXES))
    vectors = op.one_hot_grid(
        op.grid_buckets(points, _AXES, bounds=bounds),
        {"long_bucket": "long_vector", "lat_bucket": "lat_vector"},
        op.highest_cells(points, _AXES, bounds),
    )
    return vectors.select(
        "person_id",
        *_vector_shape("long", "long_vector"),
        *_vector_shape("lat", "lat_vector"),
    )


def _check(run: ModelRun) -> DataFrame:
    """The score equations at the three digits to which the fit meets them."""
    return run.score_equations().withColumn("value", F.round("value", 3))


def _sample(run: ModelRun) -> DataFrame:
    return run.sample().select("person_id", "Voters_Turnout")


WIDE = 200  # columns of the wide table


def _wide(df: DataFrame) -> DataFrame:
    """A table of very many columns: ages, missing by a rule of each column's own."""
    return df.select(
        *[F.when((df["person_id"] + k) % (k + 2) != 0, df["age"]).alias(f"c{k}") for k in range(WIDE)]
    )


def _interactions(a: Analyses) -> DataFrame:
    """Correlations of the model features and of all products of two of them."""
    rows = a.all_features()
    names = [c for c in rows.columns if c not in ("person_id", "Voters_Turnout")]
    products = {
        f"{x} x {y}": F.col(x).cast("double") * F.col(y) for i, x in enumerate(names) for y in names[i:]
    }
    return op.wide_correlations(rows.withColumns(products), [*names, *products])


def _sample_check(df: DataFrame) -> DataFrame:
    """What holds for every random sample: rows of the table, none twice, about as many as asked for."""
    sample = op.random_sample(df.select("person_id"), 0.25)
    counted = sample.agg(
        F.count("*").alias("taken"), (F.count("*") == F.count_distinct("person_id")).alias("none_twice")
    )
    strangers = sample.join(df.select("person_id"), "person_id", "left_anti").agg(F.count("*")).scalar()
    rows = df.agg(F.count("*")).scalar()
    near = F.abs(F.col("taken") - rows / 4) <= 5 * F.sqrt(rows * 3 / 16)
    return counted.select(rows.alias("n"), "none_twice", strangers.alias("strangers"), near.alias("near_share"))


def _split_check(df: DataFrame) -> DataFrame:
    """What holds for every random split: each row in one part, the shares about as asked for."""
    train, test = op.random_split(df.select("person_id"))
    parts = train.select("person_id", F.lit(1).alias("train")).unionAll(test.select("person_id", F.lit(0)))
    each = parts.groupBy("person_id").agg(F.count("*").alias("times"), F.max("train").alias("train"))
    counted = each.agg(F.count("*").alias("n"), F.max("times").cast("bigint").alias("times"), F.sum("train").alias("train"))
    near = F.abs(F.col("train") - 0.8 * F.col("n")) <= 5 * F.sqrt(0.16 * F.col("n"))
    return counted.select("n", "times", near.alias("near_share"))


def _file_check(df: DataFrame) -> DataFrame:
    """What holds for a sample of files: each file wholly in it or not at all, the same again."""
    stored = cut_lineage(df.select("person_id").repartition(16, "person_id"))
    tag = lambda rows, n: rows.select("person_id", F.col("_metadata.file_name").alias("file"), F.lit(n).alias("n"))
    every = tag(stored, 0)
    for _ in range(2):
        every = every.unionAll(tag(op.file_sample(stored, 0.5), 1))
    sums = every.groupBy("file").agg(
        F.count_if(F.col("n") == 0).alias("all"), F.count_if(F.col("n") == 1).alias("twice")
    )
    whole = F.col("twice").isin(0) | (F.col("twice") == 2 * F.col("all"))
    return sums.agg(F.sum("all").alias("n"), F.bool_and(whole).alias("whole_files"))


def _kept_turnout(df: DataFrame) -> DataFrame:
    """Turnout by group over a kept projection."""
    return Analyses(keep(df, ["ethnic_group", "voted"]), PEOPLE).turnout_by_group()


MODELS = {
    "lr_interests": Analyses.interest_model,
    "lr_demo": Analyses.demographic_model,
    "lr_all": Analyses.full_model,
}
REPORTS: dict[str, Callable[[ModelRun], DataFrame]] = {
    "check": _check,
    "auc": ModelRun.auc,
    "confusion_long": ModelRun.confusion,
    "test_labels": ModelRun.test_labels,
    "sample": _sample,
}

QUERIES: dict[str, Query] = {
    # sources and cleaning
    "row_count": _on_people(op.row_count),
    "first_rows": _on_people(lambda df: op.first_rows(df, "person_id", 10)),
    "hash_sample": _on_people(lambda df: op.hash_sample(df, "person_id", SAMPLE_FRACTION)),
    "random_sample_check": _on_people(_sample_check),
    "random_split_check": _on_people(_split_check),
    "file_sample_check": _on_people(_file_check),
    "kept_turnout_by_group": _on_people(_kept_turnout),
    "rename_columns": _analysis(lambda a: a.area()),
    "complete_cases": _analysis(lambda a: a.area_points()),
    "flag_translate": _column("flag", lambda df: flag_translate(df["voted"])),
    "flag_equals": _column("flag", lambda df: flag_equals(df["voted"])),
    "flag_columns": _on_people(
        lambda df: op.flag_columns(
            df.select("person_id", "gender", *INTERESTS),
            dict.fromkeys(INTERESTS, "Yes") | {"gender": "M"},
        )
    ),
    "fill_nulls": _on_people(
        lambda df: op.fill_nulls(df.select("person_id", "voted", "gender"), "N", ["voted"])
    ),
    "money_strip_dollar": _column(
        "amount", lambda df: parse_money(df["income_amount"], "strip_dollar")
    ),
    "money_strip_all": _column("amount", lambda df: parse_money(df["income_amount"])),
    "money_substr": _column("amount", lambda df: parse_money(df["income_amount"], "substr")),
    # groups, over the whole table
    "distinct_values": _analysis(lambda a: a.group_details()),
    "group_counts": _analysis(lambda a: a.group_counts()),
    "group_share": _analysis(lambda a: a.group_share()),
    "turnout_by_group": _analysis(lambda a: a.turnout_by_group()),
    "turnout_by_age": _analysis(lambda a: a.turnout_by_age()),
    "totals_by_age": _analysis(lambda a: a.totals_by_age()),
    "turnout_by_gender": _analysis(lambda a: a.turnout_by_gender()),
    "turnout_by_income": _analysis(lambda a: a.turnout_by_income()),
    "turnout_by_income_gender": _analysis(lambda a: a.turnout_by_income_gender()),
    "avg_age_by_group": _analysis(lambda a: a.age_by_group()),
    "avg_income_by_group": _analysis(lambda a: a.income_by_group()),
    "group_totals": _analysis(lambda a: a.group_totals()),
    **{
        f"report_{name}": _analysis(lambda a, name=name: getattr(a.group_reports(), name)())
        for name in ("turnout_by_group", "group_share", "totals_by_age", "turnout_by_income_gender", "age_by_group", "income_by_group")
    },
    # profiles
    "interest_counts": _analysis(lambda a: a.interest_counts()),
    "interest_ratio": _analysis(lambda a: a.interest_ratio()),
    "interest_table": _analysis(lambda a: a.interest_table()),
    "null_counts": _on_people(op.null_counts),
    "null_ratios": _analysis(lambda a: a.area_null_ratios()),
    "null_profile_wide": _on_people(lambda df: op.null_ratios(_wide(df))),
    # the same analyses in one county's young cohort
    "cohort": _in_cohort(lambda a: a.df),
    "cohort_distinct_values": _in_cohort(lambda a: a.group_details()),
    "cohort_group_counts": _in_cohort(lambda a: a.group_counts()),
    "cohort_turnout_by_group": _in_cohort(lambda a: a.turnout_by_group()),
    "cohort_group_share": _in_cohort(lambda a: a.group_share()),
    "cohort_interest_counts": _in_cohort(lambda a: a.interest_counts()),
    "cohort_interest_ratio": _in_cohort(lambda a: a.interest_ratio()),
    "cohort_interest_table": _in_cohort(lambda a: a.interest_table()),
    # grid
    "bounding_box": _analysis(lambda a: a.area_bounds()),
    "grid_buckets": _on_people(_cells),
    "one_hot_grid": _on_people(_one_hot),
    "grid_turnout": _analysis(lambda a: a.turnout_by_cell()),
    "grid_turnout_counted": _analysis(lambda a: a.turnout_by_cell(collapse=True)),
    # models
    "hash_split": _on_people(lambda df: op.tag_split(df.select("person_id"), "person_id")),
    "model_features_interests": _analysis(lambda a: a.interest_features()),
    "model_features_demo": _analysis(lambda a: a.demographic_features()),
    "model_features_all": _analysis(lambda a: a.all_features()),
    "lr_interests": _model(Analyses.interest_model, lambda run: run.scored),
    "lr_demo": _model(Analyses.demographic_model, lambda run: run.scored),
    "lr_all": _model(Analyses.full_model, lambda run: run.scored),
    **{
        f"{name}_{report}": _model(run, view)
        for name, run in MODELS.items()
        for report, view in REPORTS.items()
    },
    "young_lr_interests_check": _analysis(lambda a: _check(a.ages().interest_model())),
    "young_correlation_matrix": _analysis(lambda a: a.ages().interest_correlations()),
    "lr_all_roc": _model(Analyses.full_model, ModelRun.roc),
    "lr_all_confusion": _model(Analyses.full_model, ModelRun.confusion_wide),
    # evaluation
    "roc_points": _by_age(lambda df: op.roc_points(df, "score", "label")),
    "auc": _by_age(lambda df: op.auc(df, "score", "label")),
    "confusion_long": _by_age_limit(lambda df: op.confusion_long(df, "label", "prediction")),
    "pivot_counts": _by_age_limit(lambda df: op.pivot_counts(df, "label", "prediction")),
    "correlation_matrix": _analysis(lambda a: a.interest_correlations()),
    "wide_correlations": _analysis(_interactions),
}
