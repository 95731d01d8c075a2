"""Draws: whole numbers from digests of keys, the same on every engine and for every partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(k: int, *keys: Column) -> Column:
    """A number from 0 to k - 1, from the first 15 hex digits of the MD5 of the keys."""
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in keys]).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % k
