"""Exact dedup by key, with a total order so that reruns agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row of each key that is least by order; one aggregation, combined before the shuffle.

    Nulls in the order come first. Key columns keep their values, null being a key of its own.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def keep_earliest(df: DataFrame, keys: Sequence[str], date: str, ties: Sequence[Column]) -> DataFrame:
    """The row of each key with the earliest date, null dates last, ties by the given columns."""
    return keep_first(df, keys, [F.coalesce(F.col(date), F.lit("9999-12-31").cast("date")).alias("_date"), *ties])


def accounting(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows before, rows after dedup by keys, rows dropped."""
    n = F.count("*")
    kept = F.count_distinct(F.struct(*keys))
    return df.agg(n.alias("rows_before"), kept.alias("rows_final"), (n - kept).alias("dropped"))
