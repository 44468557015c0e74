"""Whole-table profiles. Each is one aggregation to one row, then unpivoted; very wide ones go by blocks of columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 90  # columns aggregated at once; generated code takes 100 fields

_ROWS = "__rows"


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row with the number of nulls of each column.

    Of many columns, blocks of ``BLOCK`` are counted each for itself: a wider
    scan or aggregation than that leaves vectorized reading and generated code.
    A block reads its own columns only, so no byte is read twice.
    """
    names = list(columns or df.columns)
    if len(names) <= BLOCK:
        return df.agg(*[F.count_if(df[c].isNull()).alias(c) for c in names])
    each = _nulls_by_block(df, names)
    by_place = each.agg(F.map_from_entries(F.collect_list(F.struct("at", "nulls"))).alias("nulls"))
    return by_place.select(*[F.element_at("nulls", i).alias(c) for i, c in enumerate(names)])


def null_ratios(
    df: DataFrame, columns: Sequence[str] | None = None, digits: int = 3
) -> DataFrame:
    """``(column_name, null_ratio)``; the ratio is NULL for an empty table.

    Many columns are counted in blocks, as by ``null_counts``.
    """
    long = _nulls_by_block(df, list(columns or df.columns))
    ratio = F.round(F.try_divide(F.col("nulls"), F.col(_ROWS)), digits)
    return long.select("column_name", ratio.alias("null_ratio"))


def _nulls_by_block(df: DataFrame, names: list[str]) -> DataFrame:
    """``(at, column_name, nulls, __rows)``: per column its place, nulls and the rows."""
    parts = []
    for low in range(0, len(names), BLOCK):
        some = names[low : low + BLOCK]
        counted = df.agg(F.count("*").alias(_ROWS), *[F.count(df[c]).alias(f"c{i}") for i, c in enumerate(some)])
        each = F.array(
            *[
                F.struct(
                    F.lit(low + i).alias("at"),
                    F.lit(c).alias("column_name"),
                    (F.col(_ROWS) - F.col(f"c{i}")).alias("nulls"),
                )
                for i, c in enumerate(some)
            ]
        )
        parts.append(counted.select(F.inline(each), _ROWS))
    return reduce(DataFrame.unionAll, parts)


def _yes_and_rows(df: DataFrame, columns: Sequence[str], yes: str) -> DataFrame:
    """``(interest, yes, __rows)``, one row per column, from one aggregation."""
    counted = df.agg(
        F.count("*").alias(_ROWS), *[F.count_if(df[c] == yes).alias(c) for c in columns]
    )
    return counted.unpivot([_ROWS], list(columns), "interest", "yes")


def _flag_rows(df: DataFrame, columns: Sequence[str], yes: str) -> DataFrame:
    """Two rows per column, flag 0 and 1, without the counts that are 0."""

    def side(flag: int, n: Column) -> Column:
        return F.struct(F.lit(flag).alias("flag"), n.alias("n"))

    both = F.array(side(0, F.col(_ROWS) - F.col("yes")), side(1, F.col("yes")))
    return (
        _yes_and_rows(df, columns, yes)
        .select("interest", _ROWS, F.inline(both))
        .filter(F.col("n") > 0)
    )


def flag_counts(df: DataFrame, columns: Sequence[str], yes: str = "Yes") -> DataFrame:
    """``(interest, flag, n)``: rows with and without the yes value."""
    return _flag_rows(df, columns, yes).select("interest", "flag", "n")


def flag_ratios(df: DataFrame, columns: Sequence[str], yes: str = "Yes") -> DataFrame:
    """``(interest, flag, n, ratio)``: the same with the share of all rows."""
    ratio = (F.col("n") / F.col(_ROWS)).alias("ratio")
    return _flag_rows(df, columns, yes).select("interest", "flag", "n", ratio)


def flag_profile(df: DataFrame, columns: Sequence[str], yes: str = "Yes") -> DataFrame:
    """``(Interest_Column, Count_Yes, Count_Null, Ratio_Yes)``.

    ``Count_Null`` counts every row without the yes value. An empty table
    gives 0 for all three.
    """
    ratio = F.coalesce(F.try_divide(F.col("yes"), F.col(_ROWS)), F.lit(0.0))
    return _yes_and_rows(df, columns, yes).select(
        F.col("interest").alias("Interest_Column"),
        F.col("yes").alias("Count_Yes"),
        (F.col(_ROWS) - F.col("yes")).alias("Count_Null"),
        ratio.alias("Ratio_Yes"),
    )
