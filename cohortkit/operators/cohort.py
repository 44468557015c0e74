"""Choose and clean rows: cohorts, flags, samples, splits. No shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortkit.functions import flag_equals, hash_bucket, to_int

_SAMPLE_DIGITS = 15  # hex digits of the hash, 60 bits


def int_column(df: DataFrame, name: str) -> Column:
    """The column as an int. A column stored as int stays bare, so that
    filters on it still reach the Parquet scan."""
    stored = df.schema[name].dataType
    if isinstance(stored, T.IntegerType):
        return df[name]
    if isinstance(stored, T.StringType):
        return to_int(df[name])
    return df[name].try_cast("int")


def cohort(
    df: DataFrame,
    equals: Mapping[str, object] | None = None,
    between: Mapping[str, tuple[int, int]] | None = None,
) -> DataFrame:
    """Rows with the given values and inside the inclusive integer ranges.

    Range columns come back as ints. The explicit null test is pushed to the
    scan even where the range itself must wait for the cast.
    """
    for name, value in (equals or {}).items():
        df = df.filter(df[name] == value)
    for name, (low, high) in (between or {}).items():
        df = df.filter(df[name].isNotNull()).withColumn(name, int_column(df, name))
        df = df.filter(df[name].between(low, high))
    return df


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without a null in ``columns`` (all columns if not given)."""
    return df.na.drop(subset=list(columns) if columns else None)


def fill_nulls(df: DataFrame, value: str, columns: Sequence[str]) -> DataFrame:
    """Nulls of the named columns replaced by ``value``."""
    return df.na.fill(value, subset=list(columns))


def flag_columns(df: DataFrame, yes: Mapping[str, str]) -> DataFrame:
    """Each named column replaced by 1 where it has its yes value, else 0."""
    return df.withColumns({name: flag_equals(df[name], value) for name, value in yes.items()})


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Old to new names in one step; new names may hold spaces."""
    return df.withColumnsRenamed(dict(names))


def first_rows(df: DataFrame, key: str | Sequence[str], n: int = 10) -> DataFrame:
    """The ``n`` rows lowest by ``key``: a per-task top-n, then a merge."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(*keys).limit(n)


def hash_sample(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """A repeatable sample chosen by a hash of ``key``.

    Uses other digits of the hash than ``hash_split``, so a sample can be
    split again without bias. Rows without a key are in or out together.
    """
    if not 0 <= fraction <= 1:
        raise ValueError(f"fraction must be from 0 to 1, not {fraction}")
    buckets = 16**_SAMPLE_DIGITS
    return df.filter(
        hash_bucket(df[key], buckets, offset=9, digits=_SAMPLE_DIGITS) < round(fraction * buckets)
    )


def file_sample(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """All rows of a repeatable choice of a table's files, by a hash of their paths.

    ``df`` must be a table read from files. The choice is made while the files
    are listed, so what is not in the sample isn't opened and bytes read go
    down with the fraction, where ``hash_sample`` reads everything. Rows come
    by whole files: with files of n_i rows, the number of rows has mean
    f * sum(n_i) and variance f * (1 - f) * sum(n_i ** 2), which is as good as
    a sample of rows only where rows are spread over files at random.
    """
    if not 0 <= fraction <= 1:
        raise ValueError(f"fraction must be from 0 to 1, not {fraction}")
    buckets = 16**_SAMPLE_DIGITS
    path = F.concat(F.lit(f"{seed}:"), F.col("_metadata.file_path"))
    return df.filter(hash_bucket(path, buckets, offset=9, digits=_SAMPLE_DIGITS) < round(fraction * buckets))


def random_sample(df: DataFrame, fraction: float = 0.01, seed: int = 42) -> DataFrame:
    """Spark's own sample; the rows it takes depend on the partitioning."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def _part(df: DataFrame, key: str, train_percent: int) -> Column:
    return F.when(hash_bucket(df[key], 100) < train_percent, "train").otherwise("test")


def tag_split(
    df: DataFrame, key: str, train_percent: int = 80, name: str = "part"
) -> DataFrame:
    """The rows with ``train`` or ``test`` by a hash of ``key``, in one pass.

    Rows without a key hash alike, so all of them are in one part.
    """
    return df.withColumn(name, _part(df, key, train_percent))


def hash_split(df: DataFrame, key: str, train_percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of ``key``; every row is in exactly one."""
    part = _part(df, key, train_percent)
    return df.filter(part == "train"), df.filter(part == "test")


def random_split(
    df: DataFrame, train_percent: int = 80, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Spark's own split, for tables without a key; depends on partitioning."""
    train, test = df.randomSplit([train_percent / 100, 1 - train_percent / 100], seed=seed)
    return train, test
