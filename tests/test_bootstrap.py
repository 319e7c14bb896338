"""The bootstrap against a loop with the same weights, ties over ranges, and its weights' distribution."""

import hashlib
import math

import numpy as np
import pytest

from quillspark.operators import bootstrap


def average_precision(y, s, w):
    total, out = float(np.sum(y * w)), 0.0
    for t in sorted(set(s), reverse=True):
        pos, tp, n = (float(np.sum(x)) for x in ((y * w)[s == t], (y * w)[s >= t], w[s >= t]))
        out += pos / total * tp / max(n, 1)
    return out


def loop(rows, rounds, seed):
    keys = np.array([int(hashlib.md5(f"{'' if k is None else k}{seed}".encode()).hexdigest()[:15], 16) for k, *_ in rows])
    y, a, b = (np.array([r[i] for r in rows], dtype=float) for i in (1, 2, 3))
    weights = bootstrap.poisson_weights(keys, np.arange(rounds))
    return {r: (average_precision(y, a, w), average_precision(y, b, w)) for r, w in enumerate(weights.T) if 0 < (y * w).sum() < w.sum()}


def rows_of(n, levels):
    rng = np.random.default_rng(n)
    y = (rng.random(n) < 0.3).astype(int)
    return [(f"u{i}", int(v), float(np.round(rng.random() * levels)), float(np.round(rng.random() * levels + v))) for i, v in enumerate(y)]


@pytest.mark.parametrize(("n", "levels", "cells"), [(300, 4, 2_000_000), (300, 0, 300), (250, 10_000, 200), (40, 3, 1)])
def test_rounds_equal_a_loop(spark, monkeypatch, n, levels, cells):
    """With few levels a group of ties spans ranges, with none it is all rows."""
    monkeypatch.setattr(bootstrap, "CELLS", cells)
    rows = rows_of(n, levels)
    df = spark.createDataFrame(rows, "k string, y int, a double, b double").repartition(3)
    got = {r["round"]: (r["ap_a"], r["ap_b"]) for r in bootstrap.bootstrap_rounds(df, "k", "y", "a", "b", rounds=25, seed=5).collect()}
    want = loop(rows, 25, 5)
    assert got.keys() == want.keys() and len(got) > 20
    assert all(np.allclose(got[r], want[r]) for r in want)


def test_interval(spark):
    rows = rows_of(200, 8)
    df = spark.createDataFrame([*rows, ("n", None, 1.0, 1.0), ("m", 1, None, 1.0)], "k string, y int, a double, b double")
    first, again = (bootstrap.paired_bootstrap(df, "k", "y", "a", "b", rounds=60).first() for _ in range(2))
    d = [b - a for a, b in loop(rows, 60, 7).values()]
    y, a, b = (np.array([r[i] for r in rows], dtype=float) for i in (1, 2, 3))
    one = np.ones(len(y))
    assert first == again
    assert np.allclose([first["delta"], first["low"], first["high"]], [average_precision(y, b, one) - average_precision(y, a, one), *np.percentile(d, [2.5, 97.5])])
    assert first["excludes_0"] == (first["low"] > 0 or first["high"] < 0)


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "k string, y int, a double, b double")
    assert bootstrap.bootstrap_rounds(empty, "k", "y", "a", "b", rounds=5).count() == 0
    assert bootstrap.paired_bootstrap(empty, "k", "y", "a", "b", rounds=5).first()["delta"] is None
    one_class = spark.createDataFrame([("a", 1, 0.5, 0.1), (None, 1, 0.2, 0.1)], "k string, y int, a double, b double")
    assert bootstrap.bootstrap_rounds(one_class, "k", "y", "a", "b", rounds=5).count() == 0


def test_weights_are_poisson():
    w = bootstrap.poisson_weights(np.arange(4000, dtype=np.uint64) << np.uint64(40), np.arange(50))
    for k in range(5):
        assert abs((w == k).mean() - math.exp(-1) / math.factorial(k)) < 0.005
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.05 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.45
