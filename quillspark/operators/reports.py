"""Characterization reports: validity, agreement, counts, tags, profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.labels import DETOXIFY, PERSPECTIVE, toxic, valid_score
from quillspark.operators.ordering import exact_quantiles, group_totals, running_sums


def n_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def null_summary(df: DataFrame) -> DataFrame:
    """(column, n_null) by falling count, in one pass."""
    counts = df.agg(*(n_if(F.col(c).isNull()).alias(c) for c in df.columns))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in df.columns))).alias("x")).select("x.*").orderBy(F.desc("n_null"), "column")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, mean, sd, least, q25, q50, q75, most) of numeric columns, with exact quantiles."""
    made = [
        F.struct(
            F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).cast("double").alias("least"),
            *(F.percentile(c, q / 100).alias(f"q{q}") for q in (25, 50, 75)), F.max(c).cast("double").alias("most"),
        ).alias(c)
        for c in columns
    ]
    return df.agg(*made).select(F.explode(F.array(*(F.col(c) for c in columns))).alias("x")).select("x.*")


def validity(df: DataFrame, by: str) -> DataFrame:
    """Rows, valid rows and rows with an invalid (or missing) score of either kind, by a column."""
    p, d = valid_score(F.col("perspective")), valid_score(F.col("detoxify"))
    return df.groupBy(by).agg(F.count("*").alias("n_rows"), n_if(p & d).alias("n_valid"), n_if(~p).alias("n_bad_perspective"), n_if(~d).alias("n_bad_detoxify"))


def label_split(df: DataFrame, by: str, total: str = "total") -> DataFrame:
    """Rows that only one score labels, both, either and all, by a column and in total (one rollup)."""
    p, d = F.coalesce(F.col("perspective") >= PERSPECTIVE, F.lit(False)), F.coalesce(F.col("detoxify") >= DETOXIFY, F.lit(False))
    counts = [n_if(p & ~d).alias("only_perspective"), n_if(d & ~p).alias("only_detoxify"), n_if(p & d).alias("both"), n_if(p | d).alias("either"), F.count("*").alias("n_rows"), F.grouping(by).alias("_all")]
    return df.rollup(by).agg(*counts).withColumn(by, F.when(F.col("_all") == 1, total).otherwise(F.col(by))).drop("_all")


def threshold_agreement(df: DataFrame, by: str) -> DataFrame:
    """Of the rows that either score labels, the percentage that both do; 0 without any."""
    p, d = F.coalesce(F.col("perspective") >= PERSPECTIVE, F.lit(False)), F.coalesce(F.col("detoxify") >= DETOXIFY, F.lit(False))
    out = df.groupBy(by).agg(n_if(p & d).alias("both"), n_if(p | d).alias("either"))
    return out.withColumn("both_pct_of_either", F.coalesce(F.round(100 * F.col("both") / F.nullif(F.col("either"), F.lit(0)), 2), F.lit(0.0)))


def language_validation(df: DataFrame, declared: str, detected: str) -> DataFrame:
    """Matches, mismatches and undetermined rows with their percentages, in one row."""
    und = F.col(detected) == "und"
    same = F.col(detected) == F.col(declared)
    out = df.agg(F.count("*").alias("n"), n_if(same).alias("n_match"), n_if(und).alias("n_undetermined"), n_if(~same & ~und).alias("n_mismatch"))
    return out.withColumns({f"pct_{k}": F.round(100 * F.col(f"n_{k}") / F.nullif(F.col("n"), F.lit(0)), 2) for k in ("match", "mismatch", "undetermined")})


def mismatch_breakdown(df: DataFrame, declared: str, detected: str) -> DataFrame:
    """Mismatches by detected language, with their share of all mismatches."""
    bad = df.where((F.col(detected) != F.col(declared)) & (F.col(detected) != "und"))
    counts = bad.groupBy(detected).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 2))  # a row for each language


def per_key_counts(df: DataFrame, key: str) -> DataFrame:
    """(key, n, n_toxic) from valid rows with the union label."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.sum(toxic(F.col("perspective"), F.col("detoxify"))).alias("n_toxic"))


def accounting(df: DataFrame, key: str) -> DataFrame:
    """Rows read, kept and dropped by validity, distinct keys and toxic rows of those kept, in one pass."""
    kept = valid_score(F.col("perspective")) & valid_score(F.col("detoxify"))
    bad = toxic(F.col("perspective"), F.col("detoxify")) == 1
    return df.agg(F.count("*").alias("n_read"), n_if(kept).alias("n_kept"), n_if(~kept).alias("n_dropped"), F.count_distinct(F.when(kept, F.col(key))).alias("n_keys"), n_if(kept & bad).alias("n_toxic"))


def tag_toxicity(counts: DataFrame, tags: DataFrame, key: str) -> DataFrame:
    """(tag, n_reviews, n_toxic, toxicity_rate, toxicity_pct): a game counts once for each of its tags."""
    each = tags.select(key, F.explode("tags").alias("tag")).where("tag <> ''").distinct()
    out = each.join(counts, key).groupBy("tag").agg(F.sum("n").alias("n_reviews"), F.sum("n_toxic").alias("n_toxic"))
    rate = F.col("n_toxic") / F.col("n_reviews")
    return out.withColumns({"toxicity_rate": rate, "toxicity_pct": 100 * rate})


def above_quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    """Rows at or above the exact quantile of a column; the quantile is one row, so it is broadcast."""
    floor = exact_quantiles(df, column, [q]).select(F.get("q", F.lit(0)).alias("_floor"))
    return df.crossJoin(F.broadcast(floor)).where(F.col(column) >= F.col("_floor")).drop("_floor")


def tag_coverage(counts: DataFrame, tags: DataFrame, key: str) -> DataFrame:
    """Games and reviews with tags and without, over distinct games, in one row."""
    tagged = tags.where(F.size("tags") > 0).select(key).distinct().withColumn("_tagged", F.lit(True))
    got = counts.join(tagged, key, "left").withColumn("_tagged", F.coalesce("_tagged", F.lit(False)))
    return got.agg(n_if(F.col("_tagged")).alias("games_with_tags"), n_if(~F.col("_tagged")).alias("games_without"), F.sum(F.when(F.col("_tagged"), F.col("n")).otherwise(0)).alias("reviews_with_tags"), F.sum(F.when(~F.col("_tagged"), F.col("n")).otherwise(0)).alias("reviews_without"))


def with_profiles(users: DataFrame, profiles: DataFrame, key: str) -> DataFrame:
    """users with the profile's columns and `found`: whether the key is in the profile table, whatever its payload."""
    return users.join(profiles.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def ban_rates(users: DataFrame) -> DataFrame:
    """By is_toxic: users, matched users, banned users, and the ban percentage over either denominator."""
    banned = F.col("has_ban") == True  # noqa: E712
    out = users.groupBy("is_toxic").agg(F.count("*").alias("n_users"), n_if(F.col("found")).alias("n_matched"), n_if(banned).alias("n_banned"))
    return out.withColumns({"ban_pct_all": F.round(100 * F.col("n_banned") / F.col("n_users"), 4), "ban_pct_matched": F.round(100 * F.col("n_banned") / F.nullif(F.col("n_matched"), F.lit(0)), 4)})


def ecdf(df: DataFrame, column: str, points: int | None = None) -> DataFrame:
    """(value, share at or below) over the distinct values; with points, thinned to about as many.

    Values are counted before the running sum, which orders ranges of distinct values apart.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    out = group_totals(running_sums(counts, "value", {"upto": "n", "i": F.lit(1)}), {"total": F.sum("n"), "size": F.count("*")})
    out = out.withColumn("share", F.col("upto") / F.col("total"))
    if points:
        step = F.greatest(F.lit(1), F.floor(F.col("size") / points))
        out = out.where((F.col("i") % step == 0) | (F.col("i") == F.col("size")) | (F.col("i") == 1))
    return out.select("value", "share")


def bands(df: DataFrame, order: str, family: str) -> DataFrame:
    """(family, first, last, n): runs of rows of one family that are adjacent in the order of distinct numbers."""
    placed = running_sums(running_sums(df, order, {"_all": F.lit(1)}), order, {"_own": F.lit(1)}, [family])
    return placed.groupBy(family, F.col("_all") - F.col("_own")).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).select(family, "first", "last", "n")
