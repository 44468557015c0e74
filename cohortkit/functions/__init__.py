"""Column expressions: flags, money text, casts, key hashes."""

from cohortkit.functions.casts import to_float, to_int
from cohortkit.functions.flags import flag_equals, flag_translate
from cohortkit.functions.hashing import hash_bucket
from cohortkit.functions.money import MONEY_MODES, parse_money
from cohortkit.functions.ranges import range_index

__all__ = [
    "MONEY_MODES",
    "flag_equals",
    "flag_translate",
    "hash_bucket",
    "parse_money",
    "range_index",
    "to_float",
    "to_int",
]
