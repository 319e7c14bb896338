"""Tree ensembles and the Fourier kernel against serial versions, exact kernels and ring-shaped data."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from quillspark.operators import kernels, models, statistics, trees


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(0, 1, (900, 5)), 3)
    x[rng.random(900) < 0.1, 1] = np.nan
    y = ((x[:, 0] ** 2 + np.nan_to_num(x[:, 1], nan=1.5) + rng.normal(0, 0.3, 900)) > 1.2).astype(int)
    return x, y


@pytest.fixture(scope="module")
def table(spark, rows):
    x, y = rows
    data = [(i, int(b), [None if np.isnan(v) else float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame([*data, (-1, None, [9.0] * 5)], "id long, y int, x array<double>").repartition(5)


def cuts_of(x, bins=40):
    return [sorted(set(np.nanquantile(c, np.linspace(0, 1, bins + 1)[1:-1]).tolist())) for c in x.T]


def test_bins_count_the_cuts_below():
    got = trees.bin_rows([[0.5, None], [1.0, float("nan")], [9.0], None], [[1.0, 2.0], [0.0]])
    assert got.tolist() == [[0, 255], [0, 255], [2, 255], [255, 255]]


@pytest.mark.parametrize("leaves", [4, 31])
def test_boosting_equals_a_serial_one(spark, table, rows, leaves):
    x, y = rows
    cuts = cuts_of(x)
    params = trees.BoostingParams(rounds=11, max_leaves=leaves, max_depth=3)
    got = trees.boost(table, "y", "x", n_features=5, params=params, cuts=cuts)
    want = trees.boost_serial(trees.bin_rows(list(x), cuts), y.astype(float), cuts, params)
    assert [vars(t) for t in got.trees] == [vars(t) for t in want.trees] and got.base == want.base
    assert len(got.trees) == 11 and max(t.feature.count(-1) for t in got.trees) <= leaves
    p = 1 / (1 + np.exp(-want.margins(trees.bin_rows(list(x), cuts))))
    found = dict(table.where("y IS NOT NULL").select("id", got.score(F.col("x")).alias("p")).collect())
    assert np.allclose([found[i] for i in range(len(y))], p)
    assert np.mean((p > 0.5) == y) > 0.9


def test_best_first_opens_the_best_leaf():
    """Of the trees with two splits, it has those of the highest gains, not those nearest to the root."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 8, (4000, 3)).astype(np.uint8)
    y = ((x[:, 0] > 3) & (x[:, 1] > 3) & (x[:, 2] > 3)).astype(float)
    cuts = [[float(i) for i in range(7)]] * 3
    tree = trees.boost_serial(x, y, cuts, trees.BoostingParams(rounds=1, max_leaves=4, max_depth=3)).trees[0]
    depth, at = 0, 0
    while tree.feature[at] >= 0:  # a chain to the right
        assert tree.feature[tree.left[at]] == -1
        depth, at = depth + 1, tree.right[at]
    assert depth == 3 and tree.cut[0] == 3


def test_boosting_saved_and_without_classes(spark, table, tmp_path):
    model = trees.boost(table, "y", "x", n_features=5, params=trees.BoostingParams(rounds=2))
    model.save(spark, f"{tmp_path}/model")
    assert trees.Boosted.load(spark, f"{tmp_path}/model") == model
    one = trees.boost(table.where("y = 1"), "y", "x", n_features=5)
    assert one.trees == [] and one.base > 5
    none = trees.boost(table.limit(0), "y", "x", n_features=5)
    assert (none.trees, none.base) == ([], 0.0)


def test_extra_trees_equal_a_serial_forest(table, rows):
    x, y = rows
    cuts = cuts_of(x)
    params = trees.ForestParams(trees=7, max_depth=6, seed=3)
    got = trees.extra_trees(table, "y", "x", n_features=5, params=params, cuts=cuts)
    want = trees.extra_trees_serial(trees.bin_rows(list(x), cuts), y.astype(float), cuts, params)
    assert [vars(t) for t in got.trees] == [vars(t) for t in want.trees]
    assert len({str(vars(t)) for t in got.trees}) == 7
    assert np.mean((want.shares(trees.bin_rows(list(x), cuts)) > 0.5) == y) > 0.85
    other = trees.extra_trees(table, "y", "x", n_features=5, params=trees.ForestParams(trees=7, max_depth=6, seed=4), cuts=cuts)
    assert [vars(t) for t in other.trees] != [vars(t) for t in got.trees]
    assert [t.value for t in trees.extra_trees(table.limit(0), "y", "x", n_features=5, params=params).trees] == [[0.0]] * 7


def test_fourier_features_approximate_the_kernel(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (80, 6))
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * 2.0**2))
    errors = []
    for size in (64, 1024, 8192):
        z = kernels.fourier(x, size, 2.0, 7)
        errors.append(np.abs(z @ z.T - exact).max())
        assert errors[-1] < 5 / np.sqrt(size)
    assert errors[2] < errors[0] / 3
    df = spark.createDataFrame([(r.tolist(),) for r in x], "a array<double>").select(array_to_vector("a").alias("features"))
    model = kernels.RandomFourierFeatures(size=128).fit(df)
    assert abs(model.getOrDefault("width") - kernels.median_width(x)) < 1e-9
    got = np.array([r["fourier"].toArray() for r in model.transform(df).collect()])
    assert np.allclose(got, kernels.fourier(x, 128, model.getOrDefault("width"), 7))


def test_fourier_model_is_saved(spark, tmp_path):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.0],)], "a array<double>").select(array_to_vector("a").alias("features"))
    model = kernels.RandomFourierFeatures(size=8).fit(df)
    assert model.getOrDefault("width") == 1.0  # equal rows have no distance
    model.write().overwrite().save(f"{tmp_path}/fourier")
    again = kernels.RandomFourierModel.load(f"{tmp_path}/fourier")
    assert again.transform(df).first() == model.transform(df).first()


def ring(spark, n=1200):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (n, 2))
    y = ((x**2).sum(axis=1) > 1.4).astype(int)
    return spark.createDataFrame([(str(i), int(b), float(a[0]), float(a[1])) for i, (a, b) in enumerate(zip(x, y))], "k string, y int, x0 double, x1 double").withColumn("fold", F.col("k").cast("int") % 2)


def test_kernel_machine_and_trees_tell_a_ring(spark, monkeypatch):
    monkeypatch.setattr(models, "BoostingParams", lambda rounds: trees.BoostingParams(rounds=5, rate=0.5))
    monkeypatch.setattr(models, "ForestParams", lambda seed: trees.ForestParams(trees=10, seed=seed))
    data = ring(spark)
    oof = models.arms(data, "k", "fold", ["y"], {"xy": {"numeric": ["x0", "x1"]}}, ["svm", "rbf", "hist_boosted", "extra_trees"])
    ap = {r["model"]: r["auc_pr"] for r in statistics.ranking_metrics(oof, "y", "score", ["model"]).collect()}
    assert ap["svm"] < 0.7 and min(ap["rbf"], ap["hist_boosted"], ap["extra_trees"]) > 0.95
