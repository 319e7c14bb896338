"""Tables stored in buckets by key, so that dedup, joins and aggregates by that key run without an exchange."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def store(df: DataFrame, name: str, key: str, buckets: int, path: str) -> DataFrame:
    """df as the table `name` at path, in so many buckets by the hash of key, each sorted by it.

    Tables that are to be joined need equal numbers of buckets. Rows are dealt once, here; a bucket is
    one file, so choose buckets of what a task can hold.
    """
    dealt = df.repartition(buckets, key).sortWithinPartitions(key)
    dealt.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


def keep_first(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """One row of each key: the first in the order, by an aggregation that a table in buckets by key answers in place."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return best.select(key, *(F.col(f"_first.{c}").alias(c) for c in rest))


def exchanges(df: DataFrame) -> int:
    """How often the plan shuffles."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
