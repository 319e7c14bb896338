"""Deterministic samples: the order of md5 stands for chance, so reruns and other engines agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.hashing import md5_bucket, md5_number
from quillspark.operators.ordering import running_sums


#: Rows that are ordered to find the last of a sample, and bits of the order that one pass over the rest resolves.
ORDERED_ROWS, STEP_BITS, NUMBER_BITS = 50_000, 15, 60


def sample_rows(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """The n rows that are first by md5, or all if there are fewer.

    Histograms of md5 numbers find the range in which the n-th lies, until it has at most
    ORDERED_ROWS rows or one number. Rows before it are all taken, by a filter; only those in it are ordered.
    """
    placed = df.withColumn("_u", F.coalesce(md5_number(F.col(key), seed), F.lit(-1)) + 1)
    low, width, left, inside = 0, NUMBER_BITS, n, placed
    while True:
        width = max(0, width - STEP_BITS)
        counts = sorted((r["b"], r["n"]) for r in inside.groupBy(F.shiftright("_u", width).alias("b")).agg(F.count("*").alias("n")).collect())
        last = None
        for bin_, count in counts:
            if count >= left:
                last = bin_, count
                break
            left -= count
        if last is None:
            return df
        low = last[0] << width
        inside = placed.where(F.col("_u").between(low, low + (1 << width) - 1))
        if width == 0 or last[1] <= ORDERED_ROWS:
            break
    edge = inside.orderBy("_u", key).limit(left)
    return placed.where(F.col("_u") < low).unionByName(edge).drop("_u")


def hash_slice(df: DataFrame, key: str, one_in: int) -> DataFrame:
    return df.where(md5_bucket(F.col(key), one_in) == 0)


def with_negatives(df: DataFrame, label: str, key: str, ratio: float, seed: str) -> DataFrame:
    """All rows of label 1 and ratio times as many of label 0."""
    positives = df.where(F.col(label) == 1)
    n = int(positives.count() * ratio)
    return positives.unionByName(sample_rows(df.where(F.col(label) == 0), key, n, seed))


def stratified(df: DataFrame, label: str, key: str, cap: int, seed: str) -> DataFrame:
    """cap rows at the label's real prevalence."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if total <= cap:
        return df
    n_pos = round(cap * counts.get(1, 0) / total)
    return sample_rows(df.where(F.col(label) == 1), key, n_pos, seed).unionByName(sample_rows(df.where(F.col(label) == 0), key, cap - n_pos, seed))


def ranked(df: DataFrame, by: Sequence[str], key: str, seed: str, name: str = "rn") -> DataFrame:
    order = Window.partitionBy(*by).orderBy(md5_number(F.col(key), seed), F.col(key))
    return df.withColumn(name, F.row_number().over(order))


def blocks(df: DataFrame, label: str, key: str, n_blocks: int, block_size: int, seed: str) -> DataFrame:
    """Disjoint blocks of block_size rows at the label's real prevalence, with a column `block`.

    Only the rows that a block can hold are ordered within their label.
    """
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    total = max(1, sum(counts.values()))
    n_pos = round(block_size * counts.get(1, 0) / total)
    parts = []
    for value, n in ((1, n_pos), (0, block_size - n_pos)):
        first = sample_rows(df.where(F.col(label) == value), key, n * n_blocks, seed)
        parts.append(ranked(first, [label], key, seed, "_rn").withColumn("block", F.floor((F.col("_rn") - 1) / max(1, n)).cast("int")).where(F.col("block") < n_blocks).drop("_rn"))
    return parts[0].unionByName(parts[1])


def balanced_draws(df: DataFrame, label: str, key: str, draws: int, seed: str) -> DataFrame:
    """For each draw all positives and as many negatives, another choice each time, with a column `draw`."""
    n_pos = df.where(F.col(label) == 1).count()
    each = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    placed = each.where(F.col(label) == 0).withColumn("_h", md5_number(F.concat_ws(":", F.col(key), "draw"), seed))
    negatives = running_sums(placed, "_h", {"_rn": F.lit(1)}, ["draw"]).where(F.col("_rn") <= n_pos).drop("_h", "_rn")
    return each.where(F.col(label) == 1).unionByName(negatives)


def oversampled(df: DataFrame, label: str) -> DataFrame:
    """Rows of the rarer label repeated to near the other's count."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return df
    rare = min(counts, key=counts.get)
    times = max(counts.values()) // counts[rare]
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col(label) == rare, times).otherwise(1)))).drop("_copy")


#: Parts in which a group's rows are capped before they meet.
CAP_PARTS = 64


def capped_per_group(df: DataFrame, by: str, key: str, cap: int, seed: str) -> DataFrame:
    """At most cap rows of each group, chosen without regard to any score, with the group's count n_total.

    A group's rows are dealt in CAP_PARTS parts by their order, each cut to cap rows (as tasks do before the
    shuffle), so a group of any size costs a task a part and then CAP_PARTS * cap rows; the count is an
    aggregate of its own.
    """
    order = [md5_number(F.col(key), seed), F.col(key)]
    part = F.pmod(F.xxhash64(key), F.lit(CAP_PARTS))
    first = df.withColumn("_part", part).withColumn("_rn", F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order))).where(F.col("_rn") <= cap)
    kept = first.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_rn") <= cap).drop("_part", "_rn")
    totals = df.groupBy(F.col(by).alias("_of")).agg(F.count("*").alias("n_total"))
    return kept.join(totals, kept[by].eqNullSafe(totals["_of"])).drop("_of")


def folds(df: DataFrame, label: str, key: str, k: int, seed: str = "") -> DataFrame:
    """df with `fold`: each label's rows dealt round-robin in md5 order, so folds differ by one row a label."""
    placed = running_sums(df.withColumn("_h", md5_number(F.col(key), seed)), "_h", {"_rn": F.lit(1)}, [label])
    return placed.withColumn("fold", ((F.col("_rn") - 1) % k).cast("int")).drop("_h", "_rn")


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered from 1; Spark keeps k rows a group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)
