"""Tree ensembles over binned features: histogram gradient boosting and extremely randomised trees.

Rows hold their features as one byte each (a quantile bin; the last bin is for missing values). All nodes of a
level get their histograms by one aggregation: tasks sum their own rows, and a cell (tree, node, feature,
bin) is one row of the shuffle. Gradients are rounded to whole numbers, so sums are exact and the same trees
grow however rows are dealt to tasks.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.staging import staged

#: Most bins of a feature, without that for missing values; the relative error of the quantiles between them.
BINS, QUANTILE_ERROR = 254, 0.001
MISSING = 255
#: Gradients and curvatures are whole multiples of this.
UNIT = 1.0 / (1 << 20)


@dataclass
class Tree:
    """Nodes as lists: feature (-1: a leaf), last bin that goes left, where missing goes, children, value."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for column, x in ((self.feature, -1), (self.cut, 0), (self.missing_left, False), (self.left, -1), (self.right, -1), (self.value, value)):
            column.append(x)
        return len(self.value) - 1

    def split(self, node: int, feature: int, cut: int, missing_left: bool, left: float, right: float) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.missing_left[node] = feature, cut, missing_left
        self.left[node], self.right[node] = self.add(left), self.add(right)
        return self.left[node], self.right[node]

    def leaves(self, binned: np.ndarray) -> np.ndarray:
        """The node in which each row ends."""
        feature, cut, missing = np.array(self.feature), np.array(self.cut), np.array(self.missing_left)
        left, right = np.array(self.left), np.array(self.right)
        at = np.zeros(len(binned), dtype=np.int64)
        rows = np.arange(len(binned))
        while len(rows := rows[feature[at[rows]] >= 0]):
            node = at[rows]
            x = binned[rows, feature[node]]
            goes_left = np.where(x == MISSING, missing[node], x <= cut[node])
            at[rows] = np.where(goes_left, left[node], right[node])
        return at

    def predict(self, binned: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(binned)]


def quantile_cuts(df: DataFrame, features: str, n_features: int, bins: int = BINS) -> list[list[float]]:
    """For each feature the distinct cuts between its bins, from approximate quantiles of all rows.

    At most n_features times bins numbers reach the driver.
    """
    steps = [i / bins for i in range(1, bins)]
    columns = df.select(*(F.get(features, F.lit(i)).cast("double").alias(f"f{i}") for i in range(n_features)))
    finite = columns.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns.columns))
    return [sorted(set(q)) for q in finite.approxQuantile(finite.columns, steps, QUANTILE_ERROR)]


def bin_rows(values: Sequence[Sequence[float]], cuts: Sequence[Sequence[float]]) -> np.ndarray:
    """A byte for each value: the number of cuts below it; MISSING for null and NaN, and where a row is too short."""
    wide = np.full((len(values), len(cuts)), np.nan)
    for i, row in enumerate(values):
        if row is not None:
            part = np.asarray(row, dtype=np.float64)[: len(cuts)]
            wide[i, : len(part)] = part
    out = np.full(wide.shape, MISSING, dtype=np.uint8)
    for j, c in enumerate(cuts):
        known = ~np.isnan(wide[:, j])
        out[known, j] = np.searchsorted(np.asarray(c), wide[known, j], side="left")
    return out


def binned(df: DataFrame, features: str, cuts: list[list[float]], name: str = "_bins") -> DataFrame:
    """df with a row's bins as bytes."""

    @F.pandas_udf("binary")
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([r.tobytes() for r in bin_rows(list(s), cuts)], dtype=object)

    return df.withColumn(name, make(F.col(features)))


def _rows(bins: pd.Series, n_features: int) -> np.ndarray:
    return np.frombuffer(b"".join(bins), dtype=np.uint8).reshape(len(bins), n_features)


def histograms(binned_: np.ndarray, cells: np.ndarray, features: np.ndarray, weights: Sequence[np.ndarray], n_cells: int) -> np.ndarray:
    """(weight, cell, place, bin) sums; features(row, place) tells whose bin a row counts in at that place."""
    out = np.zeros((len(weights), n_cells, features.shape[1], 256))
    rows = np.arange(len(binned_))
    for p in range(features.shape[1]):
        at = cells * 256 + binned_[rows, features[:, p]]
        for w, x in enumerate(weights):
            out[w, :, p] = np.bincount(at, x, minlength=n_cells * 256).reshape(n_cells, 256)
    return out


# Gradient boosting


@dataclass(frozen=True)
class BoostingParams:
    """max_leaves are opened best first within max_depth; a split needs least_rows and least_gain on either side."""

    rounds: int = 50
    rate: float = 0.1
    max_depth: int = 5
    max_leaves: int = 31
    least_rows: int = 20
    ridge: float = 0.0
    least_gain: float = 1e-9


@dataclass(frozen=True)
class Boosted:
    """A fitted ensemble: log-odds are base plus the sum of the trees' values."""

    cuts: list[list[float]]
    base: float
    trees: list[Tree]

    def margins(self, binned_: np.ndarray) -> np.ndarray:
        return self.base + sum((t.predict(binned_) for t in self.trees), np.zeros(len(binned_)))

    def score(self, features: Column) -> Column:
        """The probability of label 1 of a column of feature arrays."""

        @F.pandas_udf("double")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield pd.Series(1 / (1 + np.exp(-self.margins(bin_rows(list(s), self.cuts)))))

        return run(features)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [("head", json.dumps({"cuts": self.cuts, "base": self.base}))] + [(f"tree{i:06}", json.dumps(vars(t))) for i, t in enumerate(self.trees)]
        spark.createDataFrame(rows, "part string, body string").coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Boosted:
        parts = {r["part"]: json.loads(r["body"]) for r in spark.read.parquet(path).collect()}
        return Boosted(parts["head"]["cuts"], parts["head"]["base"], [Tree(**parts[k]) for k in sorted(parts) if k != "head"])


def gradients(y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the log loss, as whole multiples of UNIT."""
    p = 1 / (1 + np.exp(-margin))
    return np.rint((p - y) / UNIT), np.rint(p * (1 - p) / UNIT)


def best_split(sums: np.ndarray, params: BoostingParams) -> tuple[float, int, int, bool, tuple[float, float, float]] | None:
    """(gain, feature, cut, missing left, sums to the left) of a node's histograms (g, h, n by feature and bin), or None."""
    g, h, n = sums
    upto = np.stack([x[:, :-1].cumsum(axis=1) for x in (g, h, n)])  # without the missing
    total = sums[:, 0].sum(axis=1)
    missing = sums[:, :, -1]
    score = lambda a, b: a * a / np.maximum(b + params.ridge / UNIT, 1.0)
    best = None
    for missing_left in (False, True):
        left = upto + missing[:, :, None] if missing_left else upto
        right = total[:, None, None] - left
        gain = (score(left[0], left[1]) + score(right[0], right[1]) - score(total[0], total[1])) * UNIT / 2
        gain = np.where((left[2] >= params.least_rows) & (right[2] >= params.least_rows), gain, -np.inf)
        at = int(np.argmax(gain))  # ties: the first feature, then the first bin, then missing to the right
        found = float(gain.flat[at])
        if found > params.least_gain and (best is None or found > best[0]):
            f, b = divmod(at, gain.shape[1])
            best = found, f, b, missing_left, tuple(float(x) for x in left[:, f, b])
    return best


def grow(level_sums: Callable[[Tree, dict[int, int]], np.ndarray], params: BoostingParams) -> Tree:
    """A tree of the gradients. level_sums(tree, cells) gives the histograms of the nodes that are keys of
    cells; each split asks for its smaller child alone, as the other is its parent's rest.

    Every level is opened as a whole, one call each. Since a split's gain doesn't depend on the order in
    which nodes are opened, the best-first tree of max_leaves is a part of it, cut out at the end.
    """
    value = lambda s: float(-params.rate * s[0] / max(s[1] + params.ridge / UNIT, 1.0))
    full = Tree()
    full.add(0.0)
    sums = {0: level_sums(full, {0: 0})[:, 0]}
    full.value[0] = value(sums[0][:, 0].sum(axis=1))
    gains: dict[int, tuple] = {}
    level = [0]
    for _ in range(params.max_depth):
        asked: dict[int, int] = {}
        pairs = []
        for node in level:
            split = best_split(sums[node], params)
            if split is None:
                continue
            gain, f, b, missing_left, left = split
            total = sums[node][:, 0].sum(axis=1)
            right = total - np.array(left)
            children = full.split(node, f, b, missing_left, value(left), value(right))
            gains[node] = (gain, f, b, missing_left, *children)
            small = children[0] if left[2] <= right[2] else children[1]
            asked[small] = len(asked)
            pairs.append((node, small, children[0] + children[1] - small))
        if not asked:
            break
        got = level_sums(full, asked)
        for node, small, large in pairs:
            sums[small] = got[:, asked[small]]
            sums[large] = sums.pop(node) - sums[small]
        level = [n for pair in pairs for n in sorted(pair[1:])]
    return _best_first(full, gains, params.max_leaves)


def _best_first(full: Tree, gains: dict[int, tuple], max_leaves: int) -> Tree:
    tree = Tree()
    tree.add(full.value[0])
    queue = [(-gains[0][0], 0, 0)] if 0 in gains else []
    leaves = 1
    while queue and leaves < max_leaves:
        _, node, at = heapq.heappop(queue)
        _, f, b, missing_left, left, right = gains[node]
        for child, to in zip((left, right), tree.split(at, f, b, missing_left, full.value[left], full.value[right]), strict=True):
            if child in gains:
                heapq.heappush(queue, (-gains[child][0], child, to))
        leaves += 1
    return tree


#: Trees after which rows are written anew with their margins, so that a task evaluates so many at most.
STAGE_TREES = 10


def boost(df: DataFrame, label: str, features: str, *, n_features: int, params: BoostingParams | None = None, cuts: list[list[float]] | None = None) -> Boosted:
    """A gradient-boosted ensemble for 0/1 labels over an array column of features.

    Rows with a null label don't count; a missing or NaN feature has a bin of its own, for which each split learns a side. Without rows, or with
    one class only, the base is the (clipped) log-odds and there are no trees. The driver holds histograms
    of one level, 2^(max_depth - 1) nodes by n_features by 256 bins, whatever the number of rows.
    """
    params = params or BoostingParams()
    known = df.where(F.col(label).isNotNull())
    cuts = cuts if cuts is not None else quantile_cuts(known, features, n_features)
    rows = staged(binned(known.select(F.col(label).cast("double").alias("_y"), features), features, cuts).select("_y", "_bins", F.lit(0.0).alias("_margin")), "boosted")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0.0))).first()
    base = float(np.log((ones + 0.5) / (n - ones + 0.5)))
    model = Boosted(cuts, base, [])
    if not 0 < ones < n:
        return model
    pending: list[Tree] = []
    for _ in range(params.rounds):
        tree = grow(_level_sums(rows, n_features, base, pending), params)
        if len(tree.value) == 1:
            break
        model.trees.append(tree)
        pending.append(tree)
        if len(pending) == STAGE_TREES:
            rows, pending = staged(_with_margins(rows, n_features, pending), "boosted"), []
    return model


def _with_margins(rows: DataFrame, n_features: int, trees: list[Tree]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _rows(b["_bins"], n_features)
            yield b.assign(_margin=b["_margin"] + sum(t.predict(x) for t in trees))

    return rows.mapInPandas(run, "_y double, _bins binary, _margin double")


def _level_sums(rows: DataFrame, n_features: int, base: float, pending: list[Tree]) -> Callable[[Tree, dict[int, int]], np.ndarray]:
    """One aggregation over all rows for the nodes of a level."""
    pending = list(pending)

    def sums(tree: Tree, cells: dict[int, int]) -> np.ndarray:
        n_cells = len(cells)
        place = np.full(len(tree.value), -1, dtype=np.int64)
        place[list(cells)] = list(cells.values())

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((3, n_cells, n_features, 256))
            for b in batches:
                x = _rows(b["_bins"], n_features)
                at = place[tree.leaves(x)]
                if not (kept := at >= 0).any():
                    continue
                x, y, at = x[kept], b["_y"].to_numpy()[kept], at[kept]
                margin = base + b["_margin"].to_numpy()[kept] + sum((t.predict(x) for t in pending), np.zeros(len(x)))
                g, h = gradients(y, margin)
                every = np.broadcast_to(np.arange(n_features), (len(x), n_features))
                total += histograms(x, at, every, (g, h, np.ones(len(x))), n_cells)
            full = np.flatnonzero(total[2].ravel())
            flat = total.reshape(3, -1)[:, full].astype(np.int64)
            yield pd.DataFrame({"cell": full, "g": flat[0], "h": flat[1], "n": flat[2]})

        out = np.zeros((3, n_cells * n_features * 256))
        got = rows.mapInPandas(run, "cell long, g long, h long, n long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toPandas()
        out[:, got["cell"].to_numpy()] = got[["g", "h", "n"]].to_numpy(dtype=np.float64).T
        return out.reshape(3, n_cells, n_features, 256)

    return sums


def boost_serial(x: np.ndarray, y: np.ndarray, cuts: list[list[float]], params: BoostingParams) -> Boosted:
    """The same ensemble of rows that one process holds; a yardstick for tests and small samples."""
    n, ones = len(y), y.sum()
    base = float(np.log((ones + 0.5) / (n - ones + 0.5)))
    model = Boosted(cuts, base, [])
    every = np.broadcast_to(np.arange(x.shape[1]), x.shape)
    margin = np.full(n, base)
    for _ in range(params.rounds if 0 < ones < n else 0):
        g, h = gradients(y, margin)

        def sums(tree: Tree, cells: dict[int, int], g=g, h=h) -> np.ndarray:
            place = np.full(len(tree.value), -1, dtype=np.int64)
            place[list(cells)] = list(cells.values())
            at = place[tree.leaves(x)]
            kept = at >= 0
            return histograms(x[kept], at[kept], every[kept], (g[kept], h[kept], np.ones(kept.sum())), len(cells))

        tree = grow(sums, params)
        if len(tree.value) == 1:
            break
        model.trees.append(tree)
        margin = margin + tree.predict(x)
    return model


# Extremely randomised trees


@dataclass(frozen=True)
class ForestParams:
    trees: int = 50
    max_depth: int = 8
    least_rows: int = 2
    places: int = 0  # candidate features of a node; 0: the root of their number
    seed: int = 7


@dataclass(frozen=True)
class ExtraTrees:
    cuts: list[list[float]]
    trees: list[Tree]

    def shares(self, binned_: np.ndarray) -> np.ndarray:
        return sum((t.predict(binned_) for t in self.trees), np.zeros(len(binned_))) / max(1, len(self.trees))

    def score(self, features: Column) -> Column:
        """The mean share of label 1 in the leaves that a row ends in."""

        @F.pandas_udf("double")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield pd.Series(self.shares(bin_rows(list(s), self.cuts)))

        return run(features)


def _draw(seed: int, tree: int, node: int, n_features: int, places: int) -> np.ndarray:
    """The candidate features of a node, from the seed alone."""
    return np.random.default_rng([seed, tree, node]).permutation(n_features)[:places]


def random_split(counts: np.ndarray, features: np.ndarray, seed: int, tree: int, node: int) -> tuple[int, int, np.ndarray] | None:
    """(feature, cut, class counts to the left) of the candidate whose random cut separates classes best (Gini), or None.

    counts has class counts by place and bin; each cut is drawn evenly between a feature's first and last bin
    in the node. Missing values go right.
    """
    best = None
    for place, f in enumerate(features):
        here = counts[:, place]
        bins = np.flatnonzero(here[:, :-1].sum(axis=0))
        if len(bins) < 2:
            continue
        cut = int(np.random.default_rng([seed, tree, node, int(f)]).integers(bins[0], bins[-1]))
        left = here[:, : cut + 1].sum(axis=1)
        right = here.sum(axis=1) - left
        impurity = sum(s.sum() - (s * s).sum() / s.sum() for s in (left, right) if s.sum())
        if best is None or impurity < best[0] - 1e-9:
            best = impurity, int(f), cut, left
    return best[1:] if best else None


def extra_trees(df: DataFrame, label: str, features: str, *, n_features: int, params: ForestParams | None = None, cuts: list[list[float]] | None = None) -> ExtraTrees:
    """Extremely randomised trees for 0/1 labels: all trees grow a level by one groupBy of class counts.

    Cells are (tree, node, place of a candidate feature, bin); a node's split is chosen where its cells meet, in
    tasks by tree, so the driver holds the trees alone. Rows with a null label don't count; without rows
    every tree is one leaf of 0.
    """
    params = params or ForestParams()
    known = df.where(F.col(label).isNotNull())
    cuts = cuts if cuts is not None else quantile_cuts(known, features, n_features)
    rows = staged(binned(known.select(F.col(label).cast("int").alias("_y"), features), features, cuts).select("_y", "_bins"), "forest")
    places = params.places or max(1, int(np.sqrt(n_features)))
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0))).first()
    trees = [Tree() for _ in range(params.trees)]
    for t in trees:
        t.add(ones / n if n else 0.0)
    open_ = {(t, 0) for t in range(params.trees)} if 0 < ones < n else set()
    for _ in range(params.max_depth):
        if not open_:
            break
        found = _level_splits(rows, n_features, places, trees, open_, params)
        open_ = set()
        for r in found.collect():  # one row for each new node
            total, left = np.array([r["zeros"], r["ones"]]), np.array([r["left_zeros"], r["left_ones"]])
            right = total - left
            children = trees[r["tree"]].split(r["node"], r["feature"], r["cut"], False, left[1] / left.sum(), right[1] / right.sum())
            open_ |= {(r["tree"], c) for c, s in zip(children, (left, right), strict=True) if s.min() > 0 and s.sum() >= params.least_rows}
    return ExtraTrees(cuts, trees)


def _level_splits(rows: DataFrame, n_features: int, places: int, trees: list[Tree], open_: set[tuple[int, int]], params: ForestParams) -> DataFrame:
    seed = params.seed

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            x, y = _rows(b["_bins"], n_features), b["_y"].to_numpy()
            for t, tree in enumerate(trees):
                nodes = sorted(n for of, n in open_ if of == t)
                if not nodes:
                    continue
                place = np.full(len(tree.value), -1, dtype=np.int64)
                place[nodes] = np.arange(len(nodes))
                at = place[tree.leaves(x)]
                kept = at >= 0
                drawn = np.stack([_draw(seed, t, n, n_features, places) for n in nodes])
                got = histograms(x[kept], at[kept], drawn[at[kept]], (1.0 - y[kept], y[kept].astype(float)), len(nodes))
                totals[t] = totals[t] + got if t in totals else got
        for t, total in totals.items():
            nodes = np.array(sorted(n for of, n in open_ if of == t))
            flat = total.reshape(2, -1).astype(np.int64)
            full = np.flatnonzero(flat.sum(axis=0))
            node, rest = np.divmod(full, places * 256)
            yield pd.DataFrame({"tree": t, "node": nodes[node], "cell": rest, "zeros": flat[0, full], "ones": flat[1, full]})

    def choose(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        out = []
        for node, c in cells.groupby("node"):
            counts = np.zeros((2, places * 256))
            counts[:, c["cell"].to_numpy()] = c[["zeros", "ones"]].to_numpy().T
            counts = counts.reshape(2, places, 256)
            split = random_split(counts, _draw(seed, key[0], int(node), n_features, places), seed, key[0], int(node))
            if split:
                total = counts[:, 0].sum(axis=1)
                out.append((key[0], int(node), split[0], split[1], *map(int, total), *map(int, split[2])))
        return pd.DataFrame(out, columns=["tree", "node", "feature", "cut", "zeros", "ones", "left_zeros", "left_ones"])

    cells = rows.mapInPandas(count, "tree int, node long, cell int, zeros long, ones long").groupBy("tree", "node", "cell").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    return cells.groupBy("tree").applyInPandas(choose, "tree int, node long, feature int, cut int, zeros long, ones long, left_zeros long, left_ones long").orderBy("tree", "node")


def extra_trees_serial(x: np.ndarray, y: np.ndarray, cuts: list[list[float]], params: ForestParams) -> ExtraTrees:
    """The same forest of rows that one process holds; a yardstick for tests and small samples."""
    places = params.places or max(1, int(np.sqrt(x.shape[1])))
    trees = []
    for t in range(params.trees):
        tree = Tree()
        tree.add(y.mean())
        level = [(0, np.arange(len(y)))] if 0 < y.sum() < len(y) else []
        for _ in range(params.max_depth):
            following = []
            for node, rows in level:
                drawn = _draw(params.seed, t, node, x.shape[1], places)
                every = np.broadcast_to(drawn, (len(rows), places))
                counts = histograms(x[rows], np.zeros(len(rows), np.int64), every, (1.0 - y[rows], y[rows].astype(float)), 1)[:, 0]
                split = random_split(counts, drawn, params.seed, t, node)
                if split is None:
                    continue
                f, cut, _ = split
                goes_left = (x[rows, f] <= cut) & (x[rows, f] != MISSING)
                sides = rows[goes_left], rows[~goes_left]
                children = tree.split(node, f, cut, False, *(y[s].mean() for s in sides))
                following += [(c, s) for c, s in zip(children, sides, strict=True) if 0 < y[s].sum() < len(s) and len(s) >= params.least_rows]
            level = following
        trees.append(tree)
    return ExtraTrees(cuts, trees)
