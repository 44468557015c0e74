"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"


def whole(text: str | Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def word_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def salt(key: str | Column, n: int) -> Column:
    """0 to ``n`` - 1 by a hash of the key (a null key is one more value)."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
