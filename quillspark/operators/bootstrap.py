"""Paired bootstrap of average precision at any number of rows: Poisson weights by row and round, curves in ranges.

A row's weight in a round is a Poisson number from its key and the round, so rounds need no common draw and
reruns agree. Rows are ordered by score in ranges. One pass sums each range's weights for all rounds at once,
which tells every range where its curve begins; a second pass adds up the steps of the curves. A task holds
a batch of rows by all rounds; the driver gets sums of each range, never rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.hashing import md5_number
from quillspark.sources.staging import staged

#: Numbers (rows by rounds) that a task computes at once.
CELLS = 2_000_000
#: Fixed values of the 64-bit mixing function.
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: A uniform 32-bit number below so many of these is a Poisson number of mean 1.
POISSON = [round(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)]


def poisson_weights(keys: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    """(row, round) Poisson numbers of mean 1 from 64-bit keys."""
    x = keys.astype(np.uint64)[:, None] + (rounds.astype(np.uint64) + np.uint64(1)) * np.uint64(STEP)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(FIRST)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(SECOND)
    u = (x ^ (x >> np.uint64(31))) >> np.uint64(32)
    return np.searchsorted(np.array(POISSON, dtype=np.uint64), u, side="right").astype(np.float64)


class _Curve:
    """The steps of one unit (a range of one arm) for all rounds, fed in order of score."""

    def __init__(self, rounds: int, tp: np.ndarray | float = 0.0, n: np.ndarray | float = 0.0) -> None:
        self.tp, self.n = np.zeros(rounds) + tp, np.zeros(rounds) + n
        self.area = np.zeros(rounds)
        self.score: float | None = None  # of the group whose rows are still coming
        self.pos = np.zeros(rounds)
        self.first: float | None = None
        self.head_pos, self.head_n = np.zeros(rounds), np.zeros(rounds)

    def feed(self, scores: np.ndarray, y: np.ndarray, weights: np.ndarray) -> None:
        at = np.flatnonzero(np.append(True, scores[1:] != scores[:-1]))
        pos, n = np.add.reduceat(weights * y[:, None], at), np.add.reduceat(weights, at)
        groups = scores[at]
        if self.first is None:
            self.first = groups[0]
        if groups[0] == self.first:
            self.head_pos, self.head_n = self.head_pos + pos[0], self.head_n + n[0]
        start = 0
        if self.score is not None and groups[0] == self.score:
            self.pos, self.tp, self.n, start = self.pos + pos[0], self.tp + pos[0], self.n + n[0], 1
        if start == len(at):
            return
        self.end()
        tp, all_ = self.tp + np.cumsum(pos[start:], axis=0), self.n + np.cumsum(n[start:], axis=0)
        self.area += (pos[start:-1] * tp[:-1] / np.maximum(all_[:-1], 1)).sum(axis=0)
        self.score, self.pos, self.tp, self.n = groups[-1], pos[-1], tp[-1], all_[-1]

    def end(self, more_tp: np.ndarray | float = 0.0, more_n: np.ndarray | float = 0.0) -> None:
        """The group so far is whole, but for what later ranges hold of it."""
        if self.score is not None:
            self.area += self.pos * (self.tp + more_tp) / np.maximum(self.n + more_n, 1)


def _units(batches: Iterator[pd.DataFrame], rounds: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, arm, scores, labels, weights) of rows in order, in pieces of CELLS numbers."""
    size = max(1, CELLS // max(1, rounds))
    every = np.arange(rounds)
    for batch in batches:
        unit = batch["part"].to_numpy() * 2 + batch["arm"].to_numpy()
        cuts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1])) if len(unit) else []
        for a, b in zip(cuts, np.append(cuts[1:], len(unit)), strict=True) if len(unit) else ():
            for start in range(a, b, size):
                rows = batch.iloc[start : min(b, start + size)]
                yield int(unit[a] // 2), int(unit[a] % 2), rows["score"].to_numpy(), rows["y"].to_numpy(dtype=float), poisson_weights(rows["h"].to_numpy(), every)


def _summary(rounds: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, curve = None, None

        def row() -> pd.DataFrame:
            numbers = {"tp": curve.tp, "n": curve.n, "head_tp": curve.head_pos, "head_n": curve.head_n}
            return pd.DataFrame({"part": [at[0]], "arm": [at[1]], "first": [curve.first], "last": [curve.score], **{k: [v.tobytes()] for k, v in numbers.items()}})

        for part, arm, scores, y, w in _units(batches, rounds):
            if at != (part, arm):
                if at:
                    yield row()
                at, curve = (part, arm), _Curve(rounds)
            curve.feed(scores, y, w)
        if at:
            yield row()

    return run


def _areas(rounds: int, begins: dict[tuple[int, int], tuple[np.ndarray, ...]], totals: dict[int, np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, curve = None, None

        def rows() -> pd.DataFrame:
            curve.end(*begins[at][2:])
            total = totals[at[1]]
            return pd.DataFrame({"arm": at[1], "round": np.arange(rounds), "area": np.where(total > 0, curve.area / np.maximum(total, 1), np.nan)})

        for part, arm, scores, y, w in _units(batches, rounds):
            if at != (part, arm):
                if at:
                    yield rows()
                at, curve = (part, arm), _Curve(rounds, *begins[part, arm][:2])
            curve.feed(scores, y, w)
        if at:
            yield rows()

    return run


def _begins(units: list) -> tuple[dict[tuple[int, int], tuple[np.ndarray, ...]], dict[int, np.ndarray], dict[int, np.ndarray]]:
    """For each unit what stands before it and what follows of its last group; each arm's positives and weights in all."""
    number = lambda u, k: np.frombuffer(u[k], dtype=np.float64)
    begins, totals, weights = {}, {}, {}
    for arm in (0, 1):
        own = sorted((u for u in units if u["arm"] == arm), key=lambda u: u["part"])
        tp = n = np.zeros(len(number(own[0], "tp")) if own else 0)
        for i, u in enumerate(own):
            more_tp, more_n = np.zeros_like(tp), np.zeros_like(n)
            for v in own[i + 1 :]:
                if v["first"] != u["last"]:
                    break
                more_tp, more_n = more_tp + number(v, "head_tp"), more_n + number(v, "head_n")
                if v["last"] != u["last"]:
                    break
            begins[u["part"], arm] = (tp, n, more_tp, more_n)
            tp, n = tp + number(u, "tp"), n + number(u, "n")
        totals[arm], weights[arm] = tp, n
    return begins, totals, weights


def bootstrap_rounds(df: DataFrame, key: str, truth: str, a: str, b: str, rounds: int = 2000, seed: int = 7) -> DataFrame:
    """(round, ap_a, ap_b): the average precision of both scores in each Poisson resample of the rows.

    Rows with a null in truth or a score don't count. key tells rows apart (equal keys have equal weights; a
    null one counts as an empty one). Rounds in which one class is missing are left out. An empty table gives no
    round.
    """
    rows = df.where(F.col(truth).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    h = md5_number(F.coalesce(F.col(key).cast("string"), F.lit("")), str(seed))
    arms = F.explode(F.array(*(F.struct(F.lit(i).alias("arm"), F.col(c).cast("double").alias("score")) for i, c in enumerate((a, b))))).alias("z")
    long = rows.select(h.alias("h"), F.col(truth).cast("int").alias("y"), arms).select("h", "y", "z.arm", "z.score")
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["arm", F.desc("score"), "h"]
    dealt = long.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    held = staged(dealt, "curve").repartition(ranges, "part").sortWithinPartitions("part", "at")
    kind = "part int, arm int, first double, last double, tp binary, n binary, head_tp binary, head_n binary"
    units = held.mapInPandas(_summary(rounds), kind).collect()  # four sums a round for each range
    begins, totals, weights = _begins(units)
    areas = held.mapInPandas(_areas(rounds, begins, totals), "arm int, round int, area double")
    both = [i for i in range(rounds) if units and 0 < totals[0][i] < weights[0][i]]
    kept = df.sparkSession.createDataFrame([(i,) for i in both], "round int")
    by = areas.groupBy("round").agg(*(F.sum(F.when(F.col("arm") == i, F.col("area")).otherwise(0.0)).alias(n) for i, n in enumerate(("ap_a", "ap_b"))))
    return by.join(F.broadcast(kept), "round", "left_semi")


def paired_bootstrap(df: DataFrame, key: str, truth: str, a: str, b: str, rounds: int = 2000, seed: int = 7) -> DataFrame:
    """One row (delta, low, high, excludes_0): AP(b) - AP(a) of all rows, and the 95 % interval of its resamples."""
    from quillspark.operators.statistics import ranking_metrics

    drawn = bootstrap_rounds(df, key, truth, a, b, rounds, seed).select((F.col("ap_b") - F.col("ap_a")).alias("d"))
    q = drawn.agg(F.percentile("d", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))  # over the rounds alone
    known = df.where(F.col(truth).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    point = [ranking_metrics(known, truth, c).select(F.col("auc_pr").alias(n)) for c, n in ((a, "_a"), (b, "_b"))]
    one = q.crossJoin(F.broadcast(point[0])).crossJoin(F.broadcast(point[1]))  # one row each
    out = one.select((F.col("_b") - F.col("_a")).alias("delta"), F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))
    return out.withColumn("excludes_0", (F.col("low") > 0) | (F.col("high") < 0))
