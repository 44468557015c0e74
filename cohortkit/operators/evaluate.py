"""Judge scores: ROC curve, AUC, confusion and correlation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.operators.moments import wide_correlations

MANY = 30  # columns whose correlations are matrices' work
RANGES = 256  # of scores; their number sets the balance of tasks only


def _inside():
    """The scores of a range, highest first."""
    return Window.partitionBy("part").orderBy(F.desc("score"))


def _cumulated(df: DataFrame, score: str, label: str, ranges: int = RANGES) -> DataFrame:
    """Per distinct score, positives and negatives at it and above it.

    Rows are first counted per score, which removes any hot score. Quantiles of
    the counted scores cut them into ``ranges``; their number and places only
    set the balance. Cuts and sums read the shuffle of the counts, so the input
    is read once and nothing runs before the result is asked for. A running
    sum inside each range plus the sums of the ranges above it gives the whole
    running sum without sorting everything in one task. Only one row per range
    is gathered and broadcast. Rows without a score (null or NaN) and rows
    whose label is not 0 or 1 have no place on the curve.
    """
    known = (
        df.select(df[score].alias("score"), df[label].alias("label"))
        .na.drop()
        .filter(F.col("label").isin(0, 1))
    )
    counted = known.groupBy("score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    ranged = _ranged(counted, ranges).repartition("part")
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    above = Window.orderBy(F.desc("top")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("part")
        .agg(
            F.max("score").alias("top"),  # reads the same columns, so the shuffle is shared
            F.sum("pos").alias("part_pos"),
            F.sum("neg").alias("part_neg"),
        )
        .select(
            "part",
            F.coalesce(F.sum("part_pos").over(above), F.lit(0)).alias("pos_above"),
            F.coalesce(F.sum("part_neg").over(above), F.lit(0)).alias("neg_above"),
            F.sum("part_pos").over(whole).alias("all_pos"),
            F.sum("part_neg").over(whole).alias("all_neg"),
        )
    )
    inside = _inside().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.join(F.broadcast(offsets), "part").select(
        "part",
        "score",
        "pos",
        "neg",
        "all_pos",
        "all_neg",
        (F.col("pos_above") + F.sum("pos").over(inside)).alias("cum_pos"),
        (F.col("neg_above") + F.sum("neg").over(inside)).alias("cum_neg"),
    )


def _ranged(counted: DataFrame, ranges: int) -> DataFrame:
    """The counted scores with ``part``: how many of ``ranges`` - 1 quantiles are not above the score.

    Found by halving, each step a column of its own, as the next one reads it twice.
    """
    shares = [k / ranges for k in range(1, ranges)]
    # The counts are named so that this reads the same columns, and the shuffle is shared.
    found = counted.agg(
        F.struct(F.percentile_approx("score", shares).alias("cuts"), F.max("pos"), F.max("neg")).alias("found")
    ).scalar()
    parted = counted.withColumn("cuts", found["cuts"]).withColumn("part", F.lit(0))
    for power in reversed(range((ranges - 1).bit_length())):
        # No cut there, or no cuts at all: null, which is not above.
        cut = F.get("cuts", F.col("part") + F.lit(2**power - 1))
        parted = parted.withColumn("part", F.col("part") + F.when(cut <= F.col("score"), 2**power).otherwise(0))
    return parted.drop("cuts")


def roc_points(df: DataFrame, score: str, label: str, thin: bool = False) -> DataFrame:
    """``(score, fpr, tpr)`` at every distinct score, and the origin.

    The origin has a null score. A rate is NULL if its class has no rows.
    ``thin`` leaves out points on a straight line between their neighbours of
    the same range of scores, which changes neither the curve nor its area.
    """
    steps = _cumulated(df, score, label)
    if thin:
        pos, neg = (F.col(c).cast("decimal(19,0)") for c in ("pos", "neg"))
        straight = pos * F.lead(neg).over(_inside()) == neg * F.lead(pos).over(_inside())
        inner = F.lag("score").over(_inside()).isNotNull()
        steps = steps.withColumn("straight", inner & straight).filter(
            ~F.coalesce("straight", F.lit(False))
        )
    points = steps.select(
        F.col("score").cast("double").alias("score"),
        F.try_divide("cum_neg", "all_neg").alias("fpr"),
        F.try_divide("cum_pos", "all_pos").alias("tpr"),
    )
    origin = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("score"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    return origin.unionAll(points)


def auc(df: DataFrame, score: str, label: str, name: str = "auc") -> DataFrame:
    """One row: the exact area under the ROC curve, tied scores as one step.

    Each score adds a trapezoid: its negatives times the positives above it
    with and without its own. These are summed in whole numbers, so the area
    doesn't depend on the order of rows. NULL if a class has no rows.
    """
    pos, neg, cum_pos = (F.col(c).cast("decimal(19,0)") for c in ("pos", "neg", "cum_pos"))
    twice = F.sum((neg * (2 * cum_pos - pos)).cast("decimal(38,0)")).cast("double")
    pairs = F.max("all_pos").cast("double") * F.max("all_neg")
    return _cumulated(df, score, label).agg(F.try_divide(twice, 2 * pairs).alias(name))


def confusion_long(df: DataFrame, label: str, prediction: str, name: str = "n") -> DataFrame:
    """Rows per pair of label and prediction."""
    return df.groupBy(label, prediction).agg(F.count("*").alias(name))


def pivot_counts(
    df: DataFrame,
    rows: str,
    columns: str,
    values: Sequence[object] = (0.0, 1.0),
    other: str = "other",
) -> DataFrame:
    """Rows per value of ``rows``, one count column per value of ``columns``.

    The values are given, so a class that never occurs is a column of zeros,
    and the pivot is a single aggregation. Rows with another value or none
    are counted in the column ``other``.
    """
    named = F.coalesce(df[columns].isin(*values), F.lit(False))
    return df.groupBy(rows).agg(
        *[F.count_if(df[columns] == value).alias(str(value)) for value in values],
        F.count_if(~named).alias(other),
    )


def correlation_matrix(
    df: DataFrame, columns: Sequence[str], collapse: bool = False
) -> DataFrame:
    """Pearson ``(a, b, r)`` for all pairs, over the rows complete in ``columns``.

    One aggregation, one row per task. With ``collapse``, for columns of few
    values such as flags, equal rows are first counted into one weighted row,
    then means and centred products are summed; both passes read the same
    shuffle. ``r`` is NULL where a column is constant. The plan has a sum for
    each pair, so more than ``MANY`` columns go to ``wide_correlations``.
    """
    names = list(columns)
    if len(names) > MANY:
        return wide_correlations(df, names)
    short = [f"c{i}" for i in range(len(names))]
    complete = df.select(*[df[name].alias(c) for name, c in zip(names, short)]).na.drop()
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    varies = [(F.min(c) < F.max(c)).alias(f"varies_{c}") for c in short]
    if collapse:
        sums = _weighted_products(complete, short, pairs, varies)
    else:
        products = [
            F.covar_pop(F.col(f"c{i}").cast("double"), F.col(f"c{j}").cast("double")).alias(f"s{i}_{j}")
            for i, j in pairs
        ]
        sums = complete.agg(*products, *varies)

    def r(i: int, j: int) -> Column:
        low, high = min(i, j), max(i, j)
        spread = F.sqrt(F.col(f"s{i}_{i}")) * F.sqrt(F.col(f"s{j}_{j}"))
        both = F.col(f"varies_c{i}") & F.col(f"varies_c{j}")
        product = F.try_divide(F.col(f"s{low}_{high}"), spread) if i != j else F.lit(1.0)
        return F.when(both, product)

    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r(i, j).alias("r"))
        for i, a in enumerate(names)
        for j, b in enumerate(names)
    ]
    return sums.select(F.inline(F.array(*cells)))


def _weighted_products(
    complete: DataFrame, short: list[str], pairs: list[tuple[int, int]], varies: list[Column]
) -> DataFrame:
    """One row of centred products, from equal rows counted into one."""
    rows = (
        complete.groupBy(*short)
        .agg(F.count("*").cast("double").alias("w"))
        .withColumns({c: F.col(c).cast("double") for c in short})
    )
    weighted = [F.try_divide(F.sum(F.col("w") * F.col(c)), F.sum("w")).alias(c) for c in short]
    means = rows.agg(F.struct(*weighted)).scalar()
    centred = rows.withColumn("mean", means).withColumns(
        {f"d_{c}": F.col(c) - F.col(f"mean.{c}") for c in short}
    )
    return centred.agg(
        *[
            F.sum(F.col("w") * F.col(f"d_c{i}") * F.col(f"d_c{j}")).alias(f"s{i}_{j}")
            for i, j in pairs
        ],
        *varies,
    )
