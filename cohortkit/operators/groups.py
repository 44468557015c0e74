"""Counts, shares and means by group.

Each is one partially aggregated shuffle: a group holding a third of all rows
reaches the reducer as one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _names(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def distinct_values(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """The distinct values, null included."""
    return df.select(*_names(keys)).distinct()


def row_count(df: DataFrame, name: str = "n") -> DataFrame:
    """One row with the number of rows."""
    return df.agg(F.count("*").alias(name))


def group_counts(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Rows per value, most first; the null group is left out before the shuffle."""
    return (
        df.filter(df[key].isNotNull())
        .groupBy(key)
        .agg(F.count(key).alias(name))
        .orderBy(F.desc(name), key)
    )


def group_share(df: DataFrame, key: str, name: str = "n", share: str = "share") -> DataFrame:
    """Rows per value, null kept, and their share of all rows.

    The total is a scalar subquery over the grouped rows, so it reuses their
    shuffle and the table is scanned once.
    """
    counts = df.groupBy(key).agg(F.count("*").alias(name))
    total = counts.agg(F.sum(name)).scalar()
    return counts.withColumn(share, F.col(name) / total)


def mean_by(
    df: DataFrame,
    keys: str | Sequence[str],
    value: Column,
    name: str = "mean",
    drop_null_keys: bool = False,
    drop_null_means: bool = False,
) -> DataFrame:
    """The mean of ``value`` by group, nulls skipped. Of a 0/1 flag: the rate."""
    names = _names(keys)
    if drop_null_keys:
        df = df.na.drop(subset=names)
    means = df.groupBy(*names).agg(F.avg(value).alias(name))
    return means.na.drop(subset=[name]) if drop_null_means else means


def totals_by(
    df: DataFrame,
    keys: str | Sequence[str],
    flag: Column,
    rows_name: str = "n",
    sum_name: str = "n_yes",
) -> DataFrame:
    """Rows and the sum of a flag by group."""
    return df.groupBy(*_names(keys)).agg(
        F.count("*").alias(rows_name), F.sum(flag).alias(sum_name)
    )
