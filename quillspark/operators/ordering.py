"""Running sums over an ordered column without ordering a whole table in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range of values that is ordered apart, and most ranges.
RANGE_ROWS, MOST_RANGES = 100_000, 256


def _matches(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    out = F.lit(True)
    for a, b in pairs:
        out = out & left[a].eqNullSafe(right[b])
    return out


def _range_of(value: Column, cuts: list, before: int) -> Column:
    """The number of cuts below the value, by halving."""
    if not cuts:
        return F.lit(before)
    half = len(cuts) // 2
    return F.when(value > F.lit(cuts[half]), _range_of(value, cuts[half + 1 :], before + half + 1)).otherwise(_range_of(value, cuts[:half], before))


def running_sums(df: DataFrame, value: str, sums: Mapping[str, str | Column], by: Sequence[str] = (), descending: bool = False, range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with, for each name of `sums`, the sum of its column over all rows up to this one in the order of `value`.

    Values must be distinct within `by`, and numeric. Approximate quantiles cut them into ranges of
    about range_rows rows, of which each is ordered by itself; a range's rows then get the sum of the ranges before it. So a
    task holds a range, and one task the sums of all ranges of a group.
    """
    steps = F.array(*(F.lit(i / MOST_RANGES) for i in range(1, MOST_RANGES)))
    found = df.agg(F.percentile_approx(value, steps, 4 * MOST_RANGES).alias("q"), F.count(value).alias("n")).first()
    ranges = min(MOST_RANGES, -(-found["n"] // range_rows) or 1)
    cuts = sorted({found["q"][i * MOST_RANGES // ranges - 1] for i in range(1, ranges)}) if ranges > 1 else []
    if not cuts:  # one range
        upto = Window.partitionBy(*by).orderBy(F.desc(value) if descending else F.asc(value)).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *(F.sum(F.col(c) if isinstance(c, str) else c).over(upto).alias(n) for n, c in sums.items()))
    place = _range_of(F.col(value), cuts, 0)
    marked = df.withColumns({"_range": -place if descending else place, **{f"_x_{n}": F.col(c) if isinstance(c, str) else c for n, c in sums.items()}})
    totals = marked.groupBy(*by, "_range").agg(*(F.sum(f"_x_{n}").alias(f"_t_{n}") for n in sums))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*(F.col(b).alias(f"_by_{b}") for b in by), F.col("_range").alias("_of"), *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums))
    inside = Window.partitionBy(*by, "_range").orderBy(F.desc(value) if descending else F.asc(value)).rowsBetween(Window.unboundedPreceding, 0)
    within = marked.withColumns({f"_w_{n}": F.sum(f"_x_{n}").over(inside) for n in sums})
    out = within.join(offsets, _matches(within, offsets, [("_range", "_of"), *((b, f"_by_{b}") for b in by)]))
    return out.select(*df.columns, *((F.col(f"_w_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums))


def group_totals(df: DataFrame, totals: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """df with aggregates over each group; of one group, they are one row that is broadcast."""
    made = df.groupBy(*by).agg(*(c.alias(n) for n, c in totals.items()))
    if not by:
        return df.crossJoin(F.broadcast(made))
    renamed = made.withColumnsRenamed({b: f"_by_{b}" for b in by})
    return df.join(renamed, _matches(df, renamed, [(b, f"_by_{b}") for b in by])).drop(*(f"_by_{b}" for b in by))


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """One row (q): the interpolated quantiles of a column as an array, null without values.

    Values are counted first, and found by their place in the running sum of the counts, so no buffer holds them all.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("c"))
    placed = group_totals(running_sums(counts, "v", {"upto": "c"}), {"n": F.sum("c")})
    at = lambda place: F.max(F.when((place >= F.col("upto") - F.col("c")) & (place < F.col("upto")), F.col("v")))
    bounds = []
    for i, share in enumerate(shares):
        place = F.lit(share) * (F.col("n") - 1)
        bounds += [at(F.floor(place)).alias(f"lo{i}"), at(F.ceil(place)).alias(f"hi{i}"), F.max(place - F.floor(place)).alias(f"part{i}")]
    found = placed.agg(*bounds)
    values = [F.col(f"lo{i}") + F.col(f"part{i}") * (F.col(f"hi{i}") - F.col(f"lo{i}")) for i in range(len(shares))]
    return found.select(F.when(F.col("lo0").isNotNull(), F.array(*values)).alias("q"))
