"""Requests in chunks of bounded tokens: the greedy rule without a task that holds a group, and a log of what was sent.

A chunk ends before the row that would pass the budget, so a chunk's start tells the next one's: the first row
whose running sum passes the sum before the start by more than the budget. Rows are dealt in ranges of their
order; running sums give every row its next start by an as-of lookup; each range shortens its rows'
chains to where they leave it, and pointer doubling over these exits finds the first start in every range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.staging import staged


def _dealt(df: DataFrame, order: str, group: str, tokens: str, budget: int) -> DataFrame:
    """df with _g, _part (range), _i (place in the group, from 1), _t (tokens, at most just over the budget) and _s (their sum so far)."""
    made = df.withColumns({"_g": F.struct(F.col(group).alias("k")), "_t": F.least(F.greatest(F.coalesce(F.col(tokens), F.lit(0)), F.lit(0)), F.lit(budget + 1)).cast("long")})
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["_g", order, F.xxhash64(*df.columns)]
    rows = staged(made.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "dealt")
    rows = rows.withColumn("_part", F.shiftright("_at", 33).cast("int"))
    inside = Window.partitionBy("_g", "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_g", "_part").agg(F.sum("_t").alias("_st"), F.count("*").alias("_n"))
    offsets = totals.select("_g", "_part", F.coalesce(F.sum("_st").over(before), F.lit(0)).alias("_os"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_oi"))
    within = rows.withColumns({"_si": F.sum("_t").over(inside), "_ii": F.count("*").over(inside)})
    return within.join(offsets, ["_g", "_part"]).withColumns({"_s": F.col("_si") + F.col("_os"), "_i": F.col("_ii") + F.col("_oi")}).drop("_si", "_ii", "_os", "_oi", "_at")


def _with_next(rows: DataFrame, budget: int) -> DataFrame:
    """(_g, _part, _i, _next): the start that follows a chunk begun at a row; null for none.

    Sums and what is looked up are dealt in buckets of the sums, just wider than a budget, so what is looked for
    lies in the same bucket or is the next one's first. Rows of no tokens share their bucket with those around.
    """
    width = budget + 1
    sums = rows.select("_g", F.floor(F.col("_s") / width).alias("b"), F.col("_s").alias("v"), F.lit(1).alias("kind"), "_i", "_part")
    asked = (F.col("_s") - F.col("_t") + budget).alias("v")
    looked = rows.select("_g", asked, F.lit(0).alias("kind"), "_i", "_part").select("_g", F.floor(F.col("v") / width).alias("b"), "v", "kind", "_i", "_part")
    down = Window.partitionBy("_g", "b").orderBy(F.desc("v"), "kind", F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    seen = sums.unionByName(looked).withColumn("found", F.last(F.when(F.col("kind") == 1, F.col("_i")), ignorenulls=True).over(down)).where("kind = 0")
    first = sums.groupBy("_g", (F.col("b") - 1).alias("b")).agg(F.min("_i").alias("following"))
    joined = seen.join(first, ["_g", "b"], "left")
    return joined.select("_g", "_part", "_i", F.greatest(F.coalesce("found", "following"), F.when(F.coalesce("found", "following").isNotNull(), F.col("_i") + 1)).alias("_next"))


def _exits(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Where a chain from each row of a range leaves it (0: nowhere, as the group ends)."""
    rows = rows.sort_values("_i")
    base, following = int(rows["_i"].iloc[0]), rows["_next"].fillna(0).astype("int64").tolist()
    out = [0] * len(following)
    for i in range(len(following) - 1, -1, -1):
        at = following[i] - base
        out[i] = out[at] if following[i] and at < len(out) else following[i]
    return rows.assign(_exit=np.array(out, dtype=np.int64))[["_g", "_part", "_i", "_exit"]]


def _starts(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The number of starts of a range up to each row, from its first start (_entry, null for none) on."""
    rows = rows.sort_values("_i")
    base, following = int(rows["_i"].iloc[0]), rows["_next"].fillna(0).astype("int64").tolist()
    flags = np.zeros(len(rows), dtype=np.int64)
    entry = rows["_entry"].iloc[0]
    at = -1 if pd.isna(entry) else int(entry) - base
    while 0 <= at < len(flags):
        flags[at] = 1
        at = following[at] - base if following[at] else -1
    return rows.assign(_starts=np.cumsum(flags))[["_g", "_part", "_i", "_starts"]]


def _entries(exits: DataFrame) -> DataFrame:
    """(_g, _part, _entry): the first start in every range that has one, by pointer doubling over the exits that any row takes."""
    reached = exits.where("_exit > 0").select("_g", F.col("_exit").alias("_i")).distinct()
    small = exits.join(reached, ["_g", "_i"], "left_semi").unionByName(exits.where("_i = 1")).distinct()
    jump = staged(small, "exits")
    hops = jump.select("_g", "_i", F.when(F.col("_exit") > 0, F.col("_exit")).alias("to"))
    marked = jump.where("_i = 1").select("_g", "_i")
    while not hops.where("to IS NOT NULL").isEmpty():  # as many rounds as the logarithm of the ranges that a group spans
        reach = marked.join(hops, ["_g", "_i"]).where("to IS NOT NULL").select("_g", F.col("to").alias("_i"))
        marked = staged(marked.unionByName(reach).distinct(), "marked")
        further = hops.select("_g", F.col("_i").alias("to"), F.col("to").alias("_far"))
        hops = staged(hops.join(further, ["_g", "to"], "left").select("_g", "_i", F.col("_far").alias("to")), "hops")
    return jump.join(marked, ["_g", "_i"]).select("_g", "_part", F.col("_i").alias("_entry"))


def chunk_by_budget(df: DataFrame, order: str, tokens: str, budget: int, group: str) -> DataFrame:
    """df with `chunk` (int, from 0 in each group): rows in order, a new chunk where the next row would pass the budget.

    A row over the budget is a chunk of its own. Ties in order go by a hash of the row; null and negative tokens
    count as 0; a null group is a group. No task holds more than a range of rows, however large a group is.
    """
    if budget < 0:
        raise ValueError("the budget can't be negative")
    rows = staged(_dealt(df, order, group, tokens, budget), "sums")
    g = rows.schema["_g"].dataType.simpleString()
    nexts = staged(_with_next(rows, budget), "nexts")
    exits = staged(nexts.groupBy("_g", "_part").applyInPandas(_flat(_exits), f"_g {g}, _part int, _i long, _exit long"), "exits")
    placed = nexts.join(_entries(exits), ["_g", "_part"], "left")
    local = staged(placed.groupBy("_g", "_part").applyInPandas(_flat(_starts), f"_g {g}, _part int, _i long, _starts long"), "starts")
    before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = local.groupBy("_g", "_part").agg(F.max("_starts").alias("_n")).select("_g", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = rows.join(local, ["_g", "_part", "_i"]).join(counts, ["_g", "_part"])
    return out.select(*df.columns, (F.col("_before") + F.col("_starts") - 1).cast("int").alias("chunk"))


def _flat(of):
    """The function of a group, which keeps the group's struct as it came."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return of(key, rows)

    return run


#: States of a request, in the order in which they come.
STATES = ("sent", "failed", "done")


def outstanding(requests: DataFrame, log: DataFrame, key: list[str], tries: int = 3) -> DataFrame:
    """requests that the log(key, state) doesn't call done, and that haven't failed `tries` times.

    What was sent without an outcome is asked for again, so a run that broke off resumes by the log alone.
    """
    seen = log.groupBy(*key).agg(F.max(F.when(F.col("state") == "done", 1).otherwise(0)).alias("_done"), F.count_if(F.col("state") == "failed").alias("_failed"))
    over = seen.where((F.col("_done") == 1) | (F.col("_failed") >= tries)).select(*key)
    return requests.join(over, key, "left_anti")


def record(log: DataFrame, path: str, state: str) -> None:
    """Add rows of keys to the log at path, in a state."""
    if state not in STATES:
        raise ValueError(f"state is one of {', '.join(STATES)}")
    log.withColumn("state", F.lit(state)).write.mode("append").parquet(path)
