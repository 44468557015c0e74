"""Two yes/no encodings. They differ on values other than Y, N and null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortkit.functions.casts import to_int


def flag_translate(text: Column, yes: str = "Y", no: str = "N") -> Column:
    """Null counts as no; each ``yes`` character becomes 1 and each ``no`` 0.

    Other text becomes NULL, so it leaves averages; ``YN`` becomes 10.
    """
    if len(yes) != 1 or len(no) != 1 or yes == no:
        raise ValueError(f"yes and no must be two different characters, not {yes!r} and {no!r}")
    return to_int(F.translate(F.coalesce(text, F.lit(no)), yes + no, "10"))


def flag_equals(text: Column, yes: str = "Y") -> Column:
    """1 where the value is ``yes``; anything else, null included, is 0."""
    return F.when(text == yes, 1).otherwise(0)
