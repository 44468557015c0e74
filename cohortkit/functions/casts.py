"""Casts that give NULL for unreadable text, with ANSI mode on or off."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sign and whole part of a decimal number; with a 0 between them it is an int.
_DECIMAL_TEXT = r"^\s*([+-]?)([0-9]*)\.[0-9]*\s*$"


def to_int(text: Column) -> Column:
    """Text to a 32-bit int; a fraction such as ``25.7`` is cut to 25, ``.`` is 0.

    The text occurs once, so an expression for it is computed once.
    """
    return F.regexp_replace(text, _DECIMAL_TEXT, "$10$2").try_cast("int")


def to_float(text: Column) -> Column:
    """Text or number to a 32-bit float, the width coordinates are kept in."""
    return text.try_cast("float")
