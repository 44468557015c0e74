"""The analyses a user asks for, over any table with a ``Layout``."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit import operators as op
from cohortkit.functions import flag_equals, flag_translate, parse_money, to_float
from cohortkit.operators.grid import DEFAULT_STEP, Bounds
from cohortkit.plans.layout import Layout
from cohortkit.sources import cut_lineage, discard

_SPECIAL_AGE = 100
_LABEL = "Voters_Turnout"
_GRID = {"Longitude": "long_bucket", "Latitude": "lat_bucket"}


@dataclass(frozen=True)
class ModelRun:
    """A fitted model, the rows it learned from and the scored test rows.

    All read the run's stored tables, which ``close`` deletes.
    """

    model: PipelineModel
    train: DataFrame
    scored: DataFrame
    features: tuple[str, ...]
    stored: tuple[DataFrame, ...]

    def close(self) -> None:
        for table in self.stored:
            discard(table)

    def score_equations(self) -> DataFrame:
        """Per feature and for the intercept (``feature``, ``n_train``, ``value``).

        ``value`` is the sum of probability times feature over the sum of the
        feature. At the maximum of the likelihood it is what the label gives
        in place of the probability.
        """
        fitted = op.score(self.model, self.train, _LABEL, carried=self.features)
        p = F.col("probability")
        sums = [F.try_divide(F.sum(p * F.col(f)), F.sum(f)) for f in self.features]
        names = [*self.features, "intercept"]
        values = [*sums, F.avg(p)]
        each = F.array(*(F.struct(F.lit(n).alias("feature"), v.alias("value")) for n, v in zip(names, values, strict=True)))
        one = fitted.agg(F.count("*").alias("n_train"), each.alias("each"))
        return one.select("n_train", F.inline("each"))

    def test_labels(self) -> DataFrame:
        """Test rows per label."""
        return self.scored.groupBy(_LABEL).agg(F.count("*").alias("n"))

    def auc(self) -> DataFrame:
        return op.auc(self.scored, "probability", _LABEL)

    def roc(self) -> DataFrame:
        return op.roc_points(self.scored, "probability", _LABEL)

    def confusion(self) -> DataFrame:
        return op.confusion_long(self.scored, _LABEL, "prediction", "count")

    def confusion_wide(self) -> DataFrame:
        return op.pivot_counts(self.scored, _LABEL, "prediction")

    def sample(self, n: int = 10) -> DataFrame:
        """The first ``n`` predictions by row key; the ``n`` least probable without one."""
        keys = [c for c in self.scored.columns if c not in (_LABEL, "probability", "prediction")]
        return op.first_rows(self.scored, keys or ["probability"], n)


@dataclass(frozen=True)
class GroupReports:
    """All reports by group, read off one stored table of totals, which ``close`` deletes.

    Each is what the method of ``Analyses`` with its name gives.
    """

    totals: DataFrame
    at: Layout

    def close(self) -> None:
        discard(self.totals)

    def _of(self, report: str) -> DataFrame:
        return self.totals.filter(F.col("report") == report)

    def _mean(self, report: str, value: str, name: str, **keys: str) -> DataFrame:
        """Keys, renamed, and the mean of a value."""
        mean = F.try_divide(F.col(f"sum_{value}"), F.col(f"n_{value}"))
        named = [F.col(key).alias(to) for key, to in keys.items()]
        return self._of(report).select(*named, mean.alias(name))

    def group_details(self) -> DataFrame:
        return self._of("detail").select(F.col("detail").alias(self.at.group_detail))

    def group_counts(self) -> DataFrame:
        name = "ethnicgroup_count"
        counts = self._of("group").select(F.col("group").alias(self.at.group), F.col("n").alias(name))
        return counts.na.drop(subset=[self.at.group]).orderBy(F.desc(name), self.at.group)

    def group_share(self) -> DataFrame:
        counts = self._of("group").select(F.col("group").alias(self.at.group), F.col("n").alias("count"))
        share = F.col("count") / counts.agg(F.sum("count")).scalar()
        return counts.withColumn("share", share).withColumn("percent", F.round(100 * F.col("share"), 2))

    def turnout_by_group(self) -> DataFrame:
        name = "general_2020_turnout"
        means = self._mean("group", "translated", name, group=self.at.group).na.drop()
        return means.orderBy(F.desc(name), self.at.group)

    def _ages(self) -> DataFrame:
        return self._of("age").filter(F.col("age") != _SPECIAL_AGE)

    def turnout_by_age(self) -> DataFrame:
        mean = F.try_divide("sum_voted", "n_voted").alias("Average_Turnout_2020")
        return self._ages().select(F.col("age").alias(self.at.age), mean).orderBy(self.at.age)

    def totals_by_age(self) -> DataFrame:
        return (
            self._ages()
            .select(
                F.col("age").alias(self.at.age),
                F.col("n").alias("Total_Voters"),
                F.col("sum_voted").alias("Voters_Who_Voted"),
            )
            .orderBy(self.at.age)
        )

    def turnout_by_gender(self) -> DataFrame:
        return self._mean("gender", "voted", "Average_Turnout_By_Gender", gender=self.at.gender)

    def turnout_by_income(self) -> DataFrame:
        band = self.at.income_band
        return self._mean("income", "voted", "Average_Turnout_By_Income", band=band).orderBy(band)

    def turnout_by_income_gender(self) -> DataFrame:
        band, gender = self.at.income_band, self.at.gender
        name = "Average_Turnout_By_Income_Gender"
        return self._mean("income_gender", "voted", name, band=band, gender=gender).orderBy(band, gender)

    def age_by_group(self) -> DataFrame:
        detail = self.at.group_detail
        return self._mean("detail", "years", "Average_Age", detail=detail).orderBy("Average_Age", detail)

    def income_by_group(self) -> DataFrame:
        detail = self.at.group_detail
        means = self._mean("detail", "income", "Average_Income", detail=detail)
        return means.na.drop(subset=["Average_Income"]).orderBy("Average_Income", detail)


class Analyses:
    """Every method is a lazy query over ``df``, but the models, which fit."""

    def __init__(self, df: DataFrame, layout: Layout):
        self.df = df
        self.at = layout

    def cohort(self, county: str, low: int = 18, high: int = 30) -> Analyses:
        """The same analyses over one county and an inclusive age range."""
        at = self.at
        return Analyses(op.cohort(self.df, {at.county: county}, {at.age: (low, high)}), at)

    # --- groups -----------------------------------------------------------

    def ages(self, low: int = 18, high: int = 30) -> Analyses:
        """The same analyses over an inclusive age range, in all counties."""
        return Analyses(op.cohort(self.df, None, {self.at.age: (low, high)}), self.at)

    def with_key(self, key: str) -> Analyses:
        """The same analyses with a row key, for splits that can be repeated."""
        return Analyses(self.df, replace(self.at, key=key))

    def group_details(self) -> DataFrame:
        return op.distinct_values(self.df, self.at.group_detail)

    def group_counts(self) -> DataFrame:
        return op.group_counts(self.df, self.at.group, "ethnicgroup_count")

    def turnout_by_group(self) -> DataFrame:
        """Null votes count as no; unreadable votes leave the average."""
        flag = flag_translate(self.df[self.at.voted])
        return op.mean_by(
            self.df,
            self.at.group,
            flag,
            "general_2020_turnout",
            drop_null_keys=True,
            drop_null_means=True,
        ).orderBy(F.desc("general_2020_turnout"), self.at.group)

    def group_share(self) -> DataFrame:
        shares = op.group_share(self.df, self.at.group, "count")
        return shares.withColumn("percent", F.round(100 * F.col("share"), 2))

    def group_totals(self) -> DataFrame:
        """Rows, votes, ages and incomes by every key of the group reports, in one scan."""
        at, df = self.at, self.df
        return op.totals_by_sets(
            df,
            keys={
                "group": df[at.group],
                "detail": df[at.group_detail],
                "age": op.int_column(df, at.age),
                "gender": df[at.gender],
                "band": df[at.income_band],
            },
            sets={
                "group": ["group"],
                "detail": ["detail"],
                "age": ["age"],
                "gender": ["gender"],
                "income": ["band"],
                "income_gender": ["band", "gender"],
            },
            values={
                "translated": flag_translate(df[at.voted]),
                "voted": self._flag(),
                "years": df[at.age].try_cast("double"),
                "income": parse_money(df[at.income_amount], "strip_all"),
            },
        )

    def group_reports(self) -> GroupReports:
        """Every report by group from one scan of the table; its totals are stored."""
        return GroupReports(cut_lineage(self.group_totals()), self.at)

    # --- interests --------------------------------------------------------

    def interest_counts(self) -> DataFrame:
        return op.flag_counts(self.df, self.at.plotted_interests)

    def interest_ratio(self) -> DataFrame:
        return op.flag_ratios(self.df, self.at.plotted_interests)

    def interest_table(self) -> DataFrame:
        return op.flag_profile(self.df, self.at.plotted_interests)

    # --- area and income --------------------------------------------------

    def area(self) -> DataFrame:
        """Vote, county, coordinates and incomes, renamed and typed."""
        at = self.at
        renamed = op.rename_columns(
            self.df.select(
                at.voted, at.county, at.latitude, at.longitude, at.income_amount, at.area_income
            ),
            {
                at.voted: "General 2020",
                at.latitude: "Latitude",
                at.longitude: "Longitude",
                at.income_amount: "Household Income",
                at.area_income: "Median Household Income",
            },
        )
        return renamed.withColumns(
            {
                "Household Income": parse_money(renamed["Household Income"], "strip_dollar"),
                "Median Household Income": parse_money(
                    renamed["Median Household Income"], "strip_dollar"
                ),
                "Latitude": to_float(renamed["Latitude"]),
                "Longitude": to_float(renamed["Longitude"]),
            }
        )

    def area_null_ratios(self) -> DataFrame:
        return op.null_ratios(self.area())

    def area_points(self) -> DataFrame:
        """The rows of ``area`` without any null, a null vote included."""
        return op.complete_cases(self.area())

    def area_bounds(self) -> DataFrame:
        return op.bounding_box(self.area(), list(_GRID))

    def area_cells(self, step: float = DEFAULT_STEP, bounds: Bounds | None = None) -> DataFrame:
        """``area`` with the vote as a flag and a cell per coordinate."""
        area = self.area()
        voted = area.withColumn("General 2020", flag_translate(area["General 2020"]))
        return op.grid_buckets(voted, _GRID, step, bounds)

    def area_cell_vectors(self, step: float = DEFAULT_STEP) -> DataFrame:
        vectors = {cell: f"{cell}_vec" for cell in _GRID.values()}
        area = self.area()
        bounds = op.grid_bounds(area, list(_GRID))
        highest = op.highest_cells(area, _GRID, bounds, step)
        return op.one_hot_grid(self.area_cells(step, bounds), vectors, highest)

    def turnout_by_cell(self, step: float = DEFAULT_STEP, collapse: bool = False) -> DataFrame:
        """``collapse`` counts equal places first, which reads the table once."""
        area = self.area()
        flag = flag_translate(area["General 2020"])
        return op.grid_rate(area, _GRID, flag, step, "General 2020", "n", collapse)

    # --- turnout by attribute ---------------------------------------------

    def _flag(self) -> Column:
        return flag_equals(self.df[self.at.voted])

    def _plain_ages(self) -> DataFrame:
        """Ages as ints, without the special value and without nulls."""
        df = self.df.select(self.at.age, self.at.voted)
        df = df.withColumn(self.at.age, op.int_column(df, self.at.age))
        return df.filter(df[self.at.age] != _SPECIAL_AGE)

    def turnout_by_age(self) -> DataFrame:
        df = self._plain_ages()
        flag = flag_equals(df[self.at.voted])
        return op.mean_by(df, self.at.age, flag, "Average_Turnout_2020").orderBy(self.at.age)

    def totals_by_age(self) -> DataFrame:
        df = self._plain_ages()
        flag = flag_equals(df[self.at.voted])
        return op.totals_by(
            df, self.at.age, flag, "Total_Voters", "Voters_Who_Voted"
        ).orderBy(self.at.age)

    def turnout_by_gender(self) -> DataFrame:
        return op.mean_by(self.df, self.at.gender, self._flag(), "Average_Turnout_By_Gender")

    def turnout_by_income(self) -> DataFrame:
        band = self.at.income_band
        return op.mean_by(self.df, band, self._flag(), "Average_Turnout_By_Income").orderBy(band)

    def turnout_by_income_gender(self) -> DataFrame:
        keys = [self.at.income_band, self.at.gender]
        return op.mean_by(
            self.df, keys, self._flag(), "Average_Turnout_By_Income_Gender"
        ).orderBy(*keys)

    def age_by_group(self) -> DataFrame:
        age = self.df[self.at.age].try_cast("double")
        return op.mean_by(self.df, self.at.group_detail, age, "Average_Age").orderBy(
            "Average_Age", self.at.group_detail
        )

    def income_by_group(self) -> DataFrame:
        income = parse_money(self.df[self.at.income_amount], "strip_all")
        return op.mean_by(
            self.df, self.at.group_detail, income, "Average_Income", drop_null_means=True
        ).orderBy("Average_Income", self.at.group_detail)

    # --- models -----------------------------------------------------------

    def interest_features(self) -> DataFrame:
        return self._features(list(self.at.model_interests))

    def demographic_features(self) -> DataFrame:
        return self._features(self._demographics())

    def all_features(self) -> DataFrame:
        return self._features([*self.at.model_interests, *self._demographics()])

    def interest_model(self) -> ModelRun:
        """Flags only: equal rows are counted before the fit."""
        return self._run(self.interest_features(), collapse=True)

    def demographic_model(self) -> ModelRun:
        return self._run(self.demographic_features())

    def full_model(self) -> ModelRun:
        return self._run(self.all_features())

    def interest_correlations(self) -> DataFrame:
        features = self.interest_features()
        return op.correlation_matrix(features, [*self.at.model_interests, _LABEL], collapse=True)

    def _demographics(self) -> list[str]:
        return [self.at.age, self.at.gender, self.at.income_amount]

    def _features(self, columns: list[str]) -> DataFrame:
        """Interests and gender as flags, age and income as ints, complete rows."""
        at, df = self.at, self.df
        yes = dict.fromkeys(at.model_interests, "Yes") | {at.gender: "M"}
        typed = op.flag_columns(df, {c: v for c, v in yes.items() if c in columns})
        typed = typed.withColumns(
            {
                _LABEL: flag_equals(df[at.voted]),
                at.age: op.int_column(df, at.age),
                at.income_amount: parse_money(df[at.income_amount], "substr"),
            }
        )
        return op.feature_table(typed, columns, _LABEL, at.key)

    def _run(self, rows: DataFrame, collapse: bool = False) -> ModelRun:
        """Split 80/20, by key where there is one, fit and score the rest.

        The complete rows are few narrow columns. They are stored once, so that
        the fit, the scores and every report on them read those instead of the
        whole table, and a split without a key cannot change between them.
        """
        features = [c for c in rows.columns if c not in (self.at.key, _LABEL)]
        rows = cut_lineage(rows)
        stored = [rows]
        train, test = op.hash_split(rows, self.at.key) if self.at.key else op.random_split(rows)
        model = op.fit_logistic(train, features, _LABEL, collapse, to_maximum=True, stored=stored)
        scored = op.score(model, test, _LABEL, self.at.key)
        return ModelRun(model, train, scored, tuple(features), tuple(stored))
