"""Portable md5 buckets: the same in any engine, for splits, folds and samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_number(key: Column, salt: str = "") -> Column:
    """The first 60 bits of md5(key || salt) as a long; null for a null key."""
    text = F.concat(key.cast("string"), F.lit(salt)) if salt else key.cast("string")
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def md5_bucket(key: Column, n: int, salt: str = "") -> Column:
    return F.pmod(md5_number(key, salt), F.lit(n))


def split_name(key: Column, train: int = 70, val: int = 15) -> Column:
    """train, val or test by the key's bucket of 100; a null key counts as an empty one, so it has one split."""
    b = md5_bucket(F.coalesce(key.cast("string"), F.lit("")), 100)
    return F.when(b < train, "train").when(b < train + val, "val").otherwise("test")
