"""The fitted toxicity scorer: what it tells apart, its sums by hand, what it saves and its calibration."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quillspark.operators import statistics, toxicity


def texts(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.3)
        t = rng.choices(words, k=12)
        if toxic and rng.random() < 0.9:
            t[rng.randrange(12)] = rng.choice(["idiot", "scum", "moron"])
        rows.append((i, " ".join(t), toxic))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.fit(spark.createDataFrame(texts(600, 1), "k int, t string, y int"), "k", "t", "y")


def test_it_tells_rude_texts(spark, model):
    scored = model.transform(spark.createDataFrame(texts(300, 2), "k int, t string, y int"), "t")
    assert scored.columns == ["k", "t", "y", "detoxify_score"]
    assert statistics.ranking_metrics(scored, "y", "detoxify_score").first()["auc_pr"] > 0.85
    assert toxicity.calibration_error(scored, "y", "detoxify_score").first()["ece"] < 0.1


def test_score_is_the_calibrated_sum_of_weights(spark, model):
    rows = spark.createDataFrame([(1, "You IDIOT, w3 w4"), (2, "w5 w6 w7")], "k int, t string")
    linear = model.linear.stages[-1]
    made = model.linear.transform(rows.withColumn("_tox_text", F.lower("t"))).select("k", vector_to_array("_tox_features").alias("x"), vector_to_array("_tox_probability").alias("p")).collect()
    weights, bias = linear.coefficients.toArray(), linear.intercept
    xs, ys = np.array(model.calibration.boundaries.toArray()), np.array(model.calibration.predictions.toArray())
    want = {}
    for r in made:
        p = 1 / (1 + np.exp(-(np.array(r["x"]) @ weights + bias)))
        assert p == pytest.approx(r["p"][1]) and set(r["x"]) <= {0.0, 1.0}
        want[r["k"]] = float(np.interp(p, xs, ys))
    got = {r["k"]: r["detoxify_score"] for r in model.transform(rows, "t").collect()}
    assert got == pytest.approx(want) and got[1] > got[2]


def test_edge_cases_and_saved_model(spark, model, tmp_path):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 5000)], "k int, t string")
    got = {r["k"]: r["detoxify_score"] for r in model.transform(df, "t").collect()}
    assert got[1] == toxicity.FAILED and 0 <= got[2] <= 1 and 0 <= got[3] <= 1
    model.save(f"{tmp_path}/m")
    again = toxicity.ToxicityModel.load(f"{tmp_path}/m")
    assert {r["k"]: r["detoxify_score"] for r in again.transform(df, "t").collect()} == got
    assert model.transform(df.limit(0), "t").count() == 0


def test_calibration_error_by_hand(spark):
    df = spark.createDataFrame([(0, 0.05), (1, 0.05), (1, 0.95), (1, 1.0), (None, 0.5), (1, -1.0)], "y int, s double")
    r = toxicity.calibration_error(df, "y", "s").first()
    assert r["n"] == 4 and r["ece"] == pytest.approx((2 * 0.45 + 2 * 0.025) / 4)
