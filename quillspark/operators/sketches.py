"""Aggregates that are kept as mergeable sketches, so that an incremental run needs no old rows.

Distinct counts are HyperLogLog sketches and quantiles KLL sketches, one of each for a key and part. Merging
parts gives what one pass over all rows would, up to the sketches' error. Exact aggregates stay the default;
`quantiles` goes over to a sketch beyond a stated number of rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.ordering import exact_quantiles

#: Bits of HyperLogLog registers: a relative standard error of about 1.04 / sqrt(2^12), 1.6 %.
HLL_BITS = 12
#: Size of KLL sketches: a rank error of about 0.7 % at 99 %.
KLL_SIZE = 400
#: Rows beyond which `quantiles` may sketch.
EXACT_ROWS = 50_000_000


def sketch(df: DataFrame, by: Sequence[str], distinct: Sequence[str] = (), numbers: Sequence[str] = ()) -> DataFrame:
    """(by, rows, hll_<column>, kll_<column>): one row of sketches for each group; nulls are left out."""
    made = [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(HLL_BITS)).alias(f"hll_{c}") for c in distinct]
    made += [F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(KLL_SIZE)).alias(f"kll_{c}") for c in numbers]
    return df.groupBy(*by).agg(F.count("*").alias("rows"), *made)


def merge(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row of sketches for each group of rows of sketches, as if their rows had been sketched together."""
    hll = [c for c in parts.columns if c.startswith("hll_")]
    kll = [c for c in parts.columns if c.startswith("kll_")]
    return parts.groupBy(*by).agg(F.sum("rows").alias("rows"), *(F.hll_union_agg(c).alias(c) for c in hll), *(F.kll_merge_agg_double(c).alias(c) for c in kll))


def estimates(sketches: DataFrame, by: Sequence[str], shares: Sequence[float] = (0.5,)) -> DataFrame:
    """(by, rows, n_<column>, q_<column>): estimated distinct counts, and quantiles at the shares as an array."""
    at = F.array(*map(F.lit, shares))
    out: list[Column] = []
    for c in sketches.columns:
        if c.startswith("hll_"):
            out.append(F.coalesce(F.hll_sketch_estimate(c), F.lit(0)).alias(f"n_{c[4:]}"))
        elif c.startswith("kll_"):
            out.append(F.when(F.kll_sketch_get_n_double(c) > 0, F.kll_sketch_get_quantile_double(F.col(c), at)).alias(f"q_{c[4:]}"))
    return sketches.select(*by, "rows", *out)


def add_part(df: DataFrame, path: str, part: str, by: Sequence[str], distinct: Sequence[str] = (), numbers: Sequence[str] = ()) -> None:
    """Sketches of a part's rows under path, in place of those that a former run of the same part left."""
    sketch(df, by, distinct, numbers).write.mode("overwrite").parquet(f"{path}/part={part}")


def quantiles(df: DataFrame, column: str, shares: Sequence[float], exact_rows: int = EXACT_ROWS) -> DataFrame:
    """One row (q): a column's quantiles, exact up to exact_rows rows and from a KLL sketch beyond; null without values."""
    if df.count() <= exact_rows:
        return exact_quantiles(df, column, shares)
    return estimates(sketch(df, [], numbers=[column]), [], shares).select(F.col(f"q_{column}").alias("q"))
