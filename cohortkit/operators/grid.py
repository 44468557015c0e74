"""Bin points onto a grid of equal cells and average an outcome per cell."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_STEP = 0.05


def bounding_box(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: ``min_<column>`` and ``max_<column>`` of each column's finite numbers."""
    return df.agg(
        *[
            end(_finite(c)).alias(f"{label}_{c}")
            for c in columns
            for label, end in (("min", F.min), ("max", F.max))
        ]
    )


Bounds = Mapping[str, tuple[float | None, float | None]]


def grid_bounds(df: DataFrame, columns: Sequence[str]) -> Bounds:
    """The least and largest finite number of each column; runs one job, for one row."""
    ends = [end(_finite(df[c].cast("double"))) for c in columns for end in (F.min, F.max)]
    found = df.agg(*ends).first()
    return {c: (found[2 * i], found[2 * i + 1]) for i, c in enumerate(columns)}


def grid_buckets(
    df: DataFrame,
    buckets: Mapping[str, str],
    step: float = DEFAULT_STEP,
    bounds: Bounds | Column | None = None,
) -> DataFrame:
    """Add a cell index per coordinate: ``buckets`` maps column to new column.

    Cell ``k`` starts at ``min + k * width``; the last cell is closed above;
    a missing coordinate has no cell. ``width`` is the step as it comes out
    of double arithmetic at ``min``, and the comparison with both cell borders
    settles points that the division puts on the wrong side. Without given
    ``bounds`` they are one scalar subquery that reads only the coordinates;
    as a column they are a struct of ``low0``, ``high0``, ``low1`` and so on.

    Each stage names its results, so that the next refers to columns instead
    of repeating their expressions.
    """
    axes = list(enumerate(buckets))
    staged = df.withColumns({f"__v{i}": df[name].cast("double") for i, name in axes})
    staged = staged.withColumns({f"__x{i}": _finite(f"__v{i}") for i, _ in axes})
    if bounds is None:
        ends = [
            end(f"__x{i}").alias(f"{label}{i}")
            for i, _ in axes
            for label, end in (("low", F.min), ("high", F.max))
        ]
        box = staged.agg(F.struct(*ends)).scalar()
    elif isinstance(bounds, Column):
        box = bounds
    else:
        box = F.struct(
            *[
                F.lit(value).cast("double").alias(f"{label}{i}")
                for i, name in axes
                for label, value in zip(("low", "high"), bounds[name])
            ]
        )
    staged = staged.withColumn("__box", box)
    staged = staged.withColumns(
        {name: value for i, _ in axes for name, value in _axis(i, step).items()}
    )
    staged = staged.withColumns({f"__guess{i}": _guess(i) for i, _ in axes})
    cells = staged.withColumns({bucket: _cell(i) for i, bucket in enumerate(buckets.values())})
    return cells.select(*[c for c in df.columns if c not in buckets.values()], *buckets.values())


def _finite(value: str | Column) -> Column:
    """NaN and infinities are missing values: one bad row cannot stretch the grid."""
    number = F.col(value) if isinstance(value, str) else value
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def _axis(i: int, step: float) -> dict[str, Column]:
    low, high = F.col(f"__box.low{i}"), F.col(f"__box.high{i}")
    cells = F.ceil(((high + step) - low) / step) - 1
    return {
        f"__low{i}": low,
        f"__width{i}": (low + step) - low,
        f"__last{i}": F.greatest(cells - 1, F.lit(0)),
    }


def _guess(i: int) -> Column:
    return F.floor((F.col(f"__x{i}") - F.col(f"__low{i}")) / F.col(f"__width{i}"))


def _cell(i: int) -> Column:
    x, low, width = F.col(f"__x{i}"), F.col(f"__low{i}"), F.col(f"__width{i}")
    guess = F.col(f"__guess{i}")
    exact = (
        F.when(x < low + guess * width, guess - 1)
        .when(x >= low + (guess + 1) * width, guess + 1)
        .otherwise(guess)
    )
    return F.when(x.isNotNull(), F.least(exact, F.col(f"__last{i}"))).cast("double")


def grid_rate(
    df: DataFrame,
    buckets: Mapping[str, str],
    flag: Column,
    step: float = DEFAULT_STEP,
    name: str = "rate",
    rows_name: str = "n",
    collapse: bool = False,
) -> DataFrame:
    """Mean flag and rows per cell; rows without a cell are left out.

    They are left out after the aggregation, where they are few groups. A
    filter before it would move down to the scan and compute every coordinate
    twice.

    The table is read twice, for the bounds and for the cells. With
    ``collapse`` rows of equal coordinates are counted first, and bounds and
    cells both read that shuffle: one scan, for tables where many rows share
    their place.
    """
    cells = list(buckets.values())
    if collapse:
        counted, box = _counted_places(df, list(buckets), flag)
        sums = grid_buckets(counted, buckets, step, box).groupBy(*cells)
        mean = F.try_divide(F.sum("__yes"), F.sum("__known"))
        located = F.sum(F.when(reduce(and_, [F.col(c).isNotNull() for c in cells]), F.col("__rows")))
        return sums.agg(mean.alias(name), located.alias(rows_name)).filter(F.col(rows_name) > 0)
    located = F.count_if(reduce(and_, [F.col(c).isNotNull() for c in cells]))
    return (
        grid_buckets(df.withColumn("__flag", flag), buckets, step)
        .groupBy(*cells)
        .agg(F.avg("__flag").alias(name), located.alias(rows_name))
        .filter(F.col(rows_name) > 0)
    )


def _counted_places(df: DataFrame, names: list[str], flag: Column) -> tuple[DataFrame, Column]:
    """Sums per distinct place, and the bounds of all places as a scalar of the same shuffle."""
    places = df.select(*[_finite(df[n].cast("double")).alias(n) for n in names], flag.alias("__flag"))
    counted = places.groupBy(*names).agg(
        F.sum("__flag").alias("__yes"), F.count("__flag").alias("__known"), F.count("*").alias("__rows")
    )
    ends = [
        end(n).alias(f"{label}{i}")
        for i, n in enumerate(names)
        for label, end in (("low", F.min), ("high", F.max))
    ]
    # The sums are named so that this reads the same columns, and the shuffle is shared.
    return counted, counted.agg(F.struct(*ends, F.max("__yes"), F.max("__known"), F.max("__rows"))).scalar()


def highest_cells(
    df: DataFrame, buckets: Mapping[str, str], bounds: Bounds, step: float = DEFAULT_STEP
) -> DataFrame:
    """One row: the highest cell of each axis, which is that of its largest coordinate."""
    corner = df.sparkSession.range(1).select(
        *[F.lit(bounds[name][1]).cast("double").alias(name) for name in buckets]
    )
    cells = grid_buckets(corner, buckets, step, bounds)
    return cells.select(*[F.coalesce(c, F.lit(0.0)).alias(c) for c in buckets.values()])


def one_hot_grid(
    df: DataFrame, vectors: Mapping[str, str], highest: DataFrame | None = None
) -> DataFrame:
    """Add a sparse one-hot vector per cell index; the last index is all zero.

    The encoder is fitted on one row with the highest index of each column:
    the given one, or one aggregation of the table.
    """
    cells = list(vectors)
    if highest is None:
        highest = df.agg(*[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in cells])
    encoder = OneHotEncoder(inputCols=cells, outputCols=list(vectors.values()))
    return encoder.fit(highest).transform(df)
