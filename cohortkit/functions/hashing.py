"""A key hash that any SQL engine can recompute."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_bucket(key: Column, buckets: int, offset: int = 1, digits: int = 8) -> Column:
    """A bucket number from some hex digits of the key's md5, up to 15.

    Depends on the key alone, not on partitioning or retries. Different
    ``offset`` values give independent buckets. A null key hashes as ``''``.
    """
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, offset, digits), 16, 10).cast("bigint") % buckets
