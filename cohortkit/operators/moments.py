"""Correlations of many columns: one scan, one small matrix per task."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 8192  # multiplied at once

_SCHEMA = "n double, mean binary, low binary, high binary, products binary"
Batches = Iterator[pa.RecordBatch]


def wide_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson ``(a, b, r)`` for all pairs of many columns, over the rows complete in them.

    Built-in aggregates need an expression for each pair, which stops at tens
    of columns. Here each task multiplies its rows, some thousand at a time,
    as matrices, and gives one row of sums; those are put together first by
    the shuffle's partitions, then in one task, each holding two matrices. The
    input is read once. A NaN counts as missing. ``r`` is NULL where a column
    is constant or no row is complete.
    """
    names = list(columns)
    numbers = [F.nanvl(df[c].cast("double"), F.lit(None)).alias(f"c{i}") for i, c in enumerate(names)]
    summed, together, listed = _steps(names)
    parts = df.select(*numbers).mapInArrow(summed, _SCHEMA)
    dealt = parts.repartition(F.spark_partition_id()).mapInArrow(together, _SCHEMA)
    return dealt.repartition(1).mapInArrow(listed, "a string, b string, r double")


def _steps(names: list[str]) -> tuple[Callable[[Batches], Batches], ...]:
    """The work of tasks: sums of rows, sums of sums, the correlations.

    Made inside a function, these travel with the job, and executors need no
    copy of this package. A sum is (rows, means, least, largest, products of
    differences from the means), so columns far from zero lose no digits.
    """
    k, at_once = len(names), ROWS
    fields = ["n", "mean", "low", "high", "products"]

    def none() -> tuple:
        return 0.0, np.zeros(k), np.full(k, np.inf), np.full(k, -np.inf), np.zeros((k, k))

    def of(rows: np.ndarray) -> tuple:
        mean = rows.mean(axis=0)
        centred = rows - mean
        return float(len(rows)), mean, rows.min(axis=0), rows.max(axis=0), centred.T @ centred

    def plus(one: tuple, other: tuple) -> tuple:
        if not one[0] or not other[0]:
            return one if one[0] else other
        n, apart = one[0] + other[0], other[1] - one[1]
        return (
            n,
            one[1] + apart * (other[0] / n),
            np.minimum(one[2], other[2]),
            np.maximum(one[3], other[3]),
            one[4] + other[4] + np.outer(apart, apart) * (one[0] * other[0] / n),
        )

    def total(batches: Batches) -> tuple:
        out = none()
        for batch in batches:
            for row in batch.to_pylist():
                mean, low, high, products = (np.frombuffer(row[f]) for f in fields[1:])
                out = plus(out, (row["n"], mean, low, high, products.reshape(k, k)))
        return out

    def written(sums: tuple) -> Batches:
        if sums[0]:
            blobs = [pa.array([x.tobytes()], pa.binary()) for x in sums[1:]]
            yield pa.RecordBatch.from_arrays([pa.array([sums[0]]), *blobs], fields)

    def summed(batches: Batches) -> Batches:
        out = none()
        for batch in batches:
            # Arrow's nulls come as NaN.
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            rows = rows[~np.isnan(rows).any(axis=1)]
            for low in range(0, len(rows), at_once):
                out = plus(out, of(rows[low : low + at_once]))
        yield from written(out)

    def together(batches: Batches) -> Batches:
        yield from written(total(batches))

    def listed(batches: Batches) -> Batches:
        _, _, low, high, products = total(batches)
        spread = np.sqrt(np.diag(products))
        with np.errstate(divide="ignore", invalid="ignore"):
            r = products / np.outer(spread, spread)
        np.fill_diagonal(r, 1.0)
        constant = ~(low < high)
        r[constant] = r[:, constant] = np.nan
        for name, values in zip(names, r, strict=True):
            # From NaN to null.
            columns = [pa.array([name] * k), pa.array(names), pa.array(values, from_pandas=True)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "r"])

    return summed, together, listed
