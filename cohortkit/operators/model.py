"""Logistic regression on complete rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.sources.tables import cut_lineage

_FEATURES = "__features"
_WEIGHT = "__weight"


def feature_table(
    df: DataFrame, features: Sequence[str], label: str, key: str | None = None
) -> DataFrame:
    """Key, features and label of the rows that have them all."""
    carried = [key] if key else []
    return df.select(*carried, *features, label).na.drop(subset=[*features, label])


def fit_logistic(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    collapse: bool = True,
    to_maximum: bool = False,
    stored: list[DataFrame] | None = None,
) -> PipelineModel:
    """Fit with Spark's default settings, or ``to_maximum`` of the likelihood.

    The default optimizer stops where a step gains little, with coefficients
    that are still off in the third digit. To the maximum, Newton steps
    (reweighted least squares) go on until no coefficient moves by 1e-12, so
    that scores can be compared with those of any other method. Where only one
    label occurs there is no maximum, and the default fit is returned.

    Equal rows have equal likelihood, so with ``collapse`` they are first
    counted into one weighted row each: eleven yes/no features and a label
    make at most 4,096 rows out of any number. To the maximum, rows of equal
    features become one with the share of 1 as its label. The optimizer passes
    over that frame many times, so its lineage is cut first. The model's summary
    reads the table; it is put into ``stored`` to be discarded with the model.
    """
    assembler = VectorAssembler(inputCols=list(features), outputCol=_FEATURES)
    rows = train.select(*features, label)
    to_maximum = to_maximum and rows.select(label).distinct().count() > 1
    if collapse:
        weight = F.count("*").cast("double").alias(_WEIGHT)
        if to_maximum:
            counted = rows.groupBy(*features).agg(F.avg(label).alias(label), weight)
        else:
            counted = rows.groupBy(*features, label).agg(weight)
        rows = cut_lineage(counted)
        if stored is not None:
            stored.append(rows)
    if to_maximum:
        regression = GeneralizedLinearRegression(
            featuresCol=_FEATURES, labelCol=label, family="binomial", link="logit", tol=1e-12, maxIter=50
        )
    else:
        regression = LogisticRegression(featuresCol=_FEATURES, labelCol=label)
    if collapse:
        regression.setWeightCol(_WEIGHT)
    return Pipeline(stages=[assembler, regression]).fit(rows)


@dataclass(frozen=True)
class Logit:
    """A fitted model's coefficients, to be written out as column expressions."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float

    @staticmethod
    def of(model: PipelineModel) -> Logit:
        """From a fitted pipeline of an assembler and a binary regression."""
        assembler, regression = model.stages
        weights = tuple(float(w) for w in regression.coefficients.toArray())
        return Logit(tuple(assembler.getInputCols()), weights, float(regression.intercept))

    def margin(self) -> Column:
        """Log odds of 1; NULL where a feature is."""
        terms = (F.col(f).cast("double") * F.lit(w) for f, w in zip(self.features, self.weights, strict=True))
        return reduce(lambda total, term: total + term, terms, F.lit(self.intercept))

    def probability(self) -> Column:
        """Probability of 1."""
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin()))

    def prediction(self) -> Column:
        """1.0 where 1 is likelier than 0, else 0.0; NULL where a feature is."""
        return (self.margin() > 0).cast("double")


def score(
    model: PipelineModel | Logit,
    df: DataFrame,
    label: str,
    key: str | None = None,
    carried: Sequence[str] = (),
) -> DataFrame:
    """``(key, label, probability, prediction)`` with the probability of 1.

    The coefficients stand in the plan as one expression, so scoring is part
    of generated code, reads the features only and lets filters pass. A row
    with a null feature has neither probability nor prediction. ``carried``
    columns come along.
    """
    logit = model if isinstance(model, Logit) else Logit.of(model)
    carried = [*([key] if key else []), *carried]
    return df.select(
        *carried,
        label,
        logit.probability().alias("probability"),
        logit.prediction().alias("prediction"),
    )
