"""Totals by many keys at once: one scan for all reports by group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def totals_by_sets(
    df: DataFrame,
    keys: Mapping[str, Column],
    sets: Mapping[str, Sequence[str]],
    values: Mapping[str, Column],
) -> DataFrame:
    """Rows, sums and counts by several sets of keys, from one scan and one shuffle.

    ``keys`` and ``values`` name expressions, ``sets`` name lists of keys. The
    result has ``report`` (the set's name), all keys (NULL where the set is
    without it), ``n``, and for each value its sum and the number of rows that
    have it, ``sum_<value>`` and ``n_<value>``. Each row is expanded to one per
    set and partially aggregated in its task, so a hot group is one row per
    task and set. Null keys are groups.
    """
    staged = df.select(*[k.alias(name) for name, k in keys.items()], *[v.alias(name) for name, v in values.items()])
    names = list(keys)
    grouped = staged.groupingSets([[F.col(k) for k in some] for some in sets.values()], *names)
    sums = [e for v in values for e in (F.sum(v).alias(f"sum_{v}"), F.count(v).alias(f"n_{v}"))]
    totals = grouped.agg(F.grouping_id().alias("__id"), F.count("*").alias("n"), *sums)
    # A set's number has a 1 for each key that it is without, the first key's highest.
    without = {
        sum(2 ** (len(names) - 1 - i) for i, k in enumerate(names) if k not in some): report
        for report, some in sets.items()
    }
    if len(without) < len(sets):
        raise ValueError("two reports have the same keys")
    report = F.create_map(*[F.lit(x) for pair in without.items() for x in pair])[F.col("__id").cast("int")]
    return totals.select(report.alias("report"), *names, "n", *[c for v in values for c in (f"sum_{v}", f"n_{v}")])
