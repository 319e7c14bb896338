"""Chunks against the serial rule, the log of requests, and sketches against exact values and one pass."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import chunking, sketches


def serial(rows, budget):
    """(group, order) -> chunk by the rule itself."""
    out = {}
    for g in {r[0] for r in rows}:
        chunk, used = 0, 0
        for i, (_, o, t) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1])):
            t = max(0, t or 0)
            if i and used + t > budget:
                chunk, used = chunk + 1, 0
            used += t
            out[g, o] = chunk
    return out


@pytest.mark.parametrize(("budget", "most"), [(60, 40), (7, 40), (1000, 3), (0, 2)])
def test_chunks_equal_the_serial_rule(spark, budget, most):
    rng = random.Random(budget)
    rows = [(g, i, None if rng.random() < 0.03 else rng.randint(-1, most)) for g, n in (("a", 700), ("b", 1), (None, 90), ("c", 40)) for i in rng.sample(range(5000), n)]
    df = spark.createDataFrame(rows, "g string, o int, t int").repartition(5)
    got = {(r["g"], r["o"]): r["chunk"] for r in chunking.chunk_by_budget(df, "o", "t", budget, "g").collect()}
    assert got == serial(rows, budget)


def test_chunks_of_one_large_group(spark):
    """A group over all ranges: no task takes it whole."""
    n, budget = 200_000, 5000
    df = spark.range(n).select(F.lit("one").alias("g"), F.col("id").alias("o"), (F.pmod(F.xxhash64("id"), F.lit(200)) + 150).cast("int").alias("t"))
    out = chunking.chunk_by_budget(df, "o", "t", budget, "g")
    got = [r["chunk"] for r in out.orderBy("o").select("chunk").collect()]
    chunk, used, want = 0, 0, []
    for i, r in enumerate(df.orderBy("o").select("t").collect()):
        if i and used + r["t"] > budget:
            chunk, used = chunk + 1, 0
        used += r["t"]
        want.append(chunk)
    assert got == want and want[-1] > 9000


def test_chunks_of_nothing(spark):
    assert chunking.chunk_by_budget(spark.createDataFrame([], "g string, o int, t int"), "o", "t", 5, "g").count() == 0
    with pytest.raises(ValueError):
        chunking.chunk_by_budget(spark.createDataFrame([], "g string, o int, t int"), "o", "t", -1, "g")


def test_requests_resume(spark, tmp_path):
    path = f"{tmp_path}/log"
    requests = spark.createDataFrame([("a", i) for i in range(6)], "g string, chunk int")
    chunking.record(requests.where("chunk < 5"), path, "sent")
    chunking.record(requests.where("chunk < 2"), path, "done")
    chunking.record(requests.where("chunk in (2, 3)"), path, "failed")
    chunking.record(requests.where("chunk = 3"), path, "failed")
    left = chunking.outstanding(requests, spark.read.parquet(path), ["g", "chunk"], tries=2)
    assert sorted(r["chunk"] for r in left.collect()) == [2, 4, 5]
    with pytest.raises(ValueError):
        chunking.record(requests, path, "lost")


def test_merged_sketches_equal_one_pass(spark, tmp_path):
    df = spark.range(60_000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 5000).alias("game"), (F.pmod(F.xxhash64("id"), F.lit(100_000)) / 10.0).alias("hours"), (F.col("id") % 4).alias("part"))
    for p in (0, 1, 2, 3, 2):  # one part is run again
        sketches.add_part(df.where(F.col("part") == p), f"{tmp_path}/s", str(p), ["g"], ["game"], ["hours"])
    merged = sketches.merge(spark.read.parquet(f"{tmp_path}/s"), ["g"])
    shares = [0.1, 0.5, 0.9]
    got = {r["g"]: r for r in sketches.estimates(merged, ["g"], shares).collect()}
    once = {r["g"]: r for r in sketches.estimates(sketches.sketch(df, ["g"], ["game"], ["hours"]), ["g"], shares).collect()}
    exact = {r["g"]: r for r in df.groupBy("g").agg(F.count_distinct("game").alias("n"), F.count("*").alias("rows"), F.percentile("hours", F.array(*map(F.lit, shares))).alias("q")).collect()}
    for g, want in exact.items():
        assert got[g]["rows"] == want["rows"] == once[g]["rows"]
        assert got[g]["n_game"] == once[g]["n_game"] and abs(got[g]["n_game"] / want["n"] - 1) < 0.06
        assert all(abs(a - b) < 0.02 * 10_000 for a, b in zip(got[g]["q_hours"], want["q"]))


def test_quantiles_are_exact_by_default(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("x"))
    assert sketches.quantiles(df, "x", [0.5, 0.25]).first()["q"] == [500.0, 250.0]
    assert abs(sketches.quantiles(df, "x", [0.5], exact_rows=10).first()["q"][0] - 500) < 20
    assert sketches.quantiles(df.limit(0), "x", [0.5]).first()["q"] is None


def test_sketches_of_nulls(spark):
    df = spark.createDataFrame([("a", None, None), ("b", "x", 1.0)], "g string, k string, v double")
    got = {r["g"]: (r["n_k"], r["q_v"]) for r in sketches.estimates(sketches.sketch(df, ["g"], ["k"], ["v"]), ["g"]).collect()}
    assert got == {"a": (0, None), "b": (1, [1.0])}
