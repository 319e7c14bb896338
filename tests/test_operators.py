"""Operators on small tables: dedup, reports, statistics, samples, terms, features, models, sources."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import chunking, dedup, features, inference, models, reports, sampling, statistics, terms
from quillspark.sources import readers, writers
from quillspark.streaming import incremental


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_earliest_wins_null_dates_last_and_reruns_agree(spark):
    day = dt.date
    df = spark.createDataFrame([("a", day(2020, 1, 2), 1), ("a", day(2020, 1, 1), 2), ("b", None, 3), ("b", day(2021, 1, 1), 4), ("c", day(2020, 1, 1), 6), ("c", day(2020, 1, 1), 5), (None, None, 7)], "k string, d date, v int")
    got = dedup.keep_earliest(df, ["k"], "d", [F.col("v")])
    assert {r["k"]: r["v"] for r in got.collect()} == {"a": 2, "b": 4, "c": 5, None: 7}
    assert dedup.keep_earliest(got, ["k"], "d", [F.col("v")]).exceptAll(got).isEmpty()
    assert tuple(dedup.accounting(df, ["k"]).first()) == (7, 4, 3)


def test_matched_means_in_the_table_not_a_payload(spark):
    users = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "u string, is_toxic boolean")
    profiles = spark.createDataFrame([("a", None), ("b", True)], "u string, has_ban boolean")
    out = {r["is_toxic"]: r for r in reports.ban_rates(reports.with_profiles(users, profiles, "u")).collect()}
    assert (out[True]["n_matched"], out[True]["n_banned"], out[True]["ban_pct_all"]) == (2, 1, 50.0)
    assert (out[False]["n_matched"], out[False]["ban_pct_matched"]) == (0, None)


def test_a_game_counts_once_for_each_tag_and_coverage_adds_up(spark):
    counts = spark.createDataFrame([(1, 10, 2), (2, 5, 5), (3, 1, 0)], "g int, n int, n_toxic int")
    tags = spark.createDataFrame([(1, ["x", "x", "y"]), (2, ["x", ""]), (3, [])], "g int, tags array<string>")
    assert rows(reports.tag_toxicity(counts, tags, "g").select("tag", "n_reviews", "n_toxic")) == [("x", 15, 7), ("y", 10, 2)]
    c = reports.tag_coverage(counts, tags, "g").first()
    assert (c["games_with_tags"], c["games_without"], c["reviews_with_tags"], c["reviews_without"]) == (2, 1, 15, 1)


def test_correlations_against_numpy(spark):
    rng = random.Random(3)
    pairs = [(float(rng.randint(0, 5)), float(rng.randint(0, 5))) for _ in range(200)]
    got = statistics.correlations(spark.createDataFrame(pairs + [(None, 1.0)], "x double, y double"), "x", "y").first()
    x, y = np.array(pairs).T

    def rank(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    assert got["n"] == 200
    assert got["pearson"] == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert got["spearman"] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])
    assert statistics.correlations(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double"), "x", "y").first()["pearson"] is None


def brute_ap(y, s):
    total, out = sum(y), 0.0
    last = 0.0
    for t in sorted(set(s), reverse=True):
        tp = sum(a for a, b in zip(y, s) if b >= t)
        n = sum(b >= t for b in s)
        out += (tp / total - last) * tp / n
        last = tp / total
    return out


def test_ranking_and_threshold_against_brute_force(spark):
    rng = random.Random(5)
    data = [(rng.randint(0, 1), round(rng.random(), 1)) for _ in range(150)]
    df = spark.createDataFrame(data, "y int, s double")
    y, s = zip(*data)
    m = statistics.ranking_metrics(df, "y", "s").first()
    roc = sum((a > b) + (a == b) / 2 for i, a in zip(y, s) if i for j, b in zip(y, s) if not j) / (sum(y) * (len(y) - sum(y)))
    assert m["auc_pr"] == pytest.approx(brute_ap(y, s)) and m["auc_roc"] == pytest.approx(roc)
    single = statistics.ranking_metrics(spark.createDataFrame([(1, 0.5), (1, 0.2)], "y int, s double"), "y", "s").first()
    assert single["auc_pr"] is None and single["auc_roc"] is None

    def f1(t):
        tp = sum(a and b >= t for a, b in data)
        fp = sum((not a) and b >= t for a, b in data)
        fn = sum(a and b < t for a, b in data)
        tn = sum((not a) and b < t for a, b in data)
        return ((2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0) + (2 * tn / (2 * tn + fp + fn) if tn + fp + fn else 0)) / 2

    grid = sorted(set(np.quantile(s, [0.01 + 0.989 * i / 49 for i in range(50)])))
    want = max(grid, key=lambda t: (round(f1(t), 12), -t))
    got = statistics.best_threshold(df, "y", "s", grid=50).first()
    assert got["threshold"] == pytest.approx(want) and got["f1_macro"] == pytest.approx(f1(want))


@pytest.mark.parametrize(("unanimous", "randolph"), [(20, 1.0), (14, 0.6), (5, 0.0)])
def test_randolph_identity(spark, unanimous, randolph):
    """With 20 items, 3 raters and 2 categories Randolph's kappa is (u - 5) / 15."""
    votes = [("b", i, (i % 2 if i < unanimous else int(r == 0))) for i in range(20) for r in range(3)]
    got = statistics.kappas(spark.createDataFrame(votes, "b string, i int, v int"), "b", "i", "v").first()
    assert got["kappa_randolph"] == pytest.approx(randolph) and not got["forced"]


def test_kappa_of_one_category_is_forced(spark):
    got = statistics.kappas(spark.createDataFrame([("b", 1, 0), ("b", 1, 0)], "b string, i int, v int"), "b", "i", "v").first()
    assert (got["kappa_randolph"], got["kappa_fleiss"], got["forced"]) == (1.0, 1.0, True)


def test_majorities_and_ties(spark):
    votes = [("b", i, int(i < 10)) for i in range(20) for _ in range(3)]
    got = statistics.majorities(spark.createDataFrame(votes, "b string, i int, v int"), "b", "i", "v").first()
    assert (got["majority"], got["n_unanimous"]) == ("tie", 20)
    missing = spark.createDataFrame([(1, 1), (1, 1), (1, None), (2, 1), (2, 0), (2, None), (3, 0), (3, 0), (3, 1)], "i int, v int")
    assert rows(statistics.resolve_missing(missing, "i", "v", fill=True)) == [(1, 1)] * 3 + [(3, 0), (3, 0), (3, 1)]
    assert statistics.resolve_missing(missing, "i", "v", fill=False).count() == 3


def test_folds_blocks_and_draws(spark):
    df = spark.createDataFrame([(str(i), int(i % 10 == 0)) for i in range(200)], "k string, y int")
    by = sampling.folds(df, "y", "k", 5).groupBy("fold").agg(F.sum("y").alias("p"), F.count("*").alias("n")).collect()
    assert {(r["p"], r["n"]) for r in by} == {(4, 40)}
    blocks = sampling.blocks(df, "y", "k", 4, 20, "s")
    assert blocks.select("k").distinct().count() == blocks.count() == 80
    draws = sampling.balanced_draws(df, "y", "k", 3, "s").groupBy("draw").agg(F.avg("y").alias("m")).collect()
    assert [r["m"] for r in draws] == [0.5] * 3
    assert sampling.sample_rows(df, "k", 500, "s").count() == 200
    assert sampling.oversampled(df, "y").groupBy("y").count().collect()[0]["count"] == 180


def test_tf_idf_against_plain_python(spark):
    docs = {1: "aa bb bb cc", 2: "aa cc", 3: "", 4: "dd aa"}
    label = {1: 1, 2: 0, 3: 1, 4: 0}
    df = spark.createDataFrame([(k, v, label[k]) for k, v in docs.items()], "id int, t string, y int")
    tf = terms.term_frequencies(df.select("id", terms.tokens(F.col("t"), ["zz"]).alias("w")), "id", "w")
    vocab = terms.vocabulary(terms.term_counts(tf), 4, min_df=1, max_df=0.9, max_features=3)
    kept = [r["term"] for r in vocab.orderBy("idx").collect()]
    assert kept == ["aa", "bb", "cc"]
    idf = {t: math.log(5 / (1 + sum(t in d.split() for d in docs.values()))) + 1 for t in kept}
    want = {}
    for k, d in docs.items():
        v = {t: d.split().count(t) * idf[t] for t in kept if t in d.split()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        want |= {(k, t): x / norm for t, x in v.items()}
    w = terms.weights(tf, vocab, "id")
    assert {(r["id"], r["term"]): pytest.approx(r["w"]) for r in w.collect()} == want
    means = {r["term"]: r for r in terms.class_means(w, df, "id", "y").collect()}
    assert means["bb"]["toxic"] == pytest.approx(want[1, "bb"] / 2)  # document 3 counts, though it is empty


def test_ordering_claims(spark):
    m = spark.createDataFrame([("a", "x", 0.2), ("b", "x", 0.1)], "tag string, term string, mean double")
    claims = [("x", "a", "b"), ("x", "b", "a"), ("y", "a", "b")]
    assert [c[3] for c in terms.ordering_claims(m, claims)] == ["holds", "contradicted", "skipped"]


def records_read(spark):
    """Records that each stage of the session so far has read from files."""
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()
    found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {s.stageId(): s.inputRecords() for s in (found.apply(i) for i in range(found.size()))}


def test_roles_guard_the_features(spark):
    df = spark.createDataFrame([("k", 0.5, 1, 3)], "review_id string, toxicity double, y_review int, len_words int")
    assert features.model_columns(df, features.REVIEW_ROLES) == ["len_words"]
    assert {r["role"] for r in features.role_table(df, "t", features.REVIEW_ROLES).collect()} == {"key", "FORBIDDEN", "label", "feature"}
    raw = df.withColumns({c: F.lit(1) for c in ("user_url", "game_id", "review_date")})
    with pytest.raises(ValueError, match="user_url, game_id, review_date"):
        features.model_columns(raw, features.REVIEW_ROLES)


def test_profiles_read_the_table(spark):
    df = spark.createDataFrame([("k", 0.5, None), ("l", None, None)], "`a.b` string, toxicity double, x int")
    assert [tuple(r) for r in features.column_profile(df).collect()] == [("a.b", "string", 2), ("toxicity", "double", 1), ("x", "int", 0)]
    assert [tuple(r) for r in features.column_profile(df.limit(0)).collect()] == [("a.b", "string", 0), ("toxicity", "double", 0), ("x", "int", 0)]
    assert [tuple(r) for r in features.role_table(df, "t", features.REVIEW_ROLES).collect()][1:] == [("t", "toxicity", "double", "FORBIDDEN", 1), ("t", "x", "int", "unlisted", 0)]


@pytest.mark.parametrize(("name", "least"), [("fea_05_column_roles", 5_000), ("src_08_schema_probe", 1_000)])
def test_roles_and_schemas_come_from_rows_that_spark_reads(spark, name, least):
    from quillspark.plans import registry

    before = records_read(spark)
    assert registry.queries()[name](spark, "/root/testdata/sf0.001").collect()
    assert sum(n for stage, n in records_read(spark).items() if stage not in before) >= least


def test_feature_tables_have_roles(spark):
    from quillspark.plans import modelling

    reviews = modelling._resolved(spark, "/root/testdata/sf0.001")
    assert not {"user_url", "game_id", "review_date"} & set(features.model_columns(reviews, features.REVIEW_ROLES))
    profiles = modelling._user_profiles(spark, "/root/testdata/sf0.001")
    users = features.modeling_labels(features.user_features(reviews, profiles, "2024-06-30"))
    assert "user_key" not in features.model_columns(users, features.USER_ROLES)


def test_vector_means_with_none_left(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], 0), ("a", [3.0, 4.0], 1), ("b", [5.0, 6.0], 1)], "u string, v array<double>, y int")
    got = {r["u"]: (r["n"], r["vec"]) for r in features.vector_mean(df, "u", "v", F.col("y") == 0).collect()}
    assert got == {"a": (1, [1.0, 2.0]), "b": (0, None)}


def test_out_of_fold_scores_every_row_once(spark):
    df = spark.createDataFrame([(str(i), i % 2, float(i % 2 + (i % 7) / 10), None if i % 9 == 0 else "c%d" % (i % 20)) for i in range(80)], "k string, y int, x double, c string")
    out = models.out_of_fold(sampling.folds(df, "y", "k", 2), "k", "y", "fold", "logreg", ["x"], ["c"])
    assert out.select("k").distinct().count() == out.count() == 80
    assert statistics.ranking_metrics(out, "y", "score").first()["auc_roc"] > 0.9
    with pytest.raises(ValueError):
        models.clean_population(spark.createDataFrame([(1, 0)], "n_reviews int, n_toxic int"))


def test_external_models_fail_softly(spark):
    df = spark.createDataFrame([(1, "you idiot and the others of this"), (2, "12 34"), (3, None)], "id int, t string")

    def broken(x):
        raise RuntimeError("down")

    got = {r["id"]: (r["review_lang"], r["detection_confidence"]) for r in inference.detect_language(df, "t").collect()}
    assert got[1][0] == "en" and got[2] == got[3] == ("und", 0.0)
    assert {r[0] for r in df.select(inference.toxicity(F.col("t"), broken)).collect()} == {-1.0}
    assert inference.ask(df, "t", "s", chat=lambda s, u: broken(u)).first()["_raw"].startswith("ERR:")
    cached = inference.score_with_cache(df, spark.createDataFrame([(1, 0.5)], "id int, score double"), "id", "t")
    assert {r["id"]: r["detoxify_score"] for r in cached.collect()} == {1: 0.5, 2: 0.0, 3: 0.0}
    patched = inference.patch_scores(cached, "t", "detoxify_score", "IDIOT")
    assert patched.where("id = 1").first()["detoxify_score"] > 0.6


def test_layouts_and_writers(spark, tmp_path):
    df = spark.createDataFrame([("en", 1), ("fr", 2)], "review_lang string, x int")
    hive, flat, plain = (str(tmp_path / n) for n in ("hive", "flat", "plain"))
    df.write.partitionBy("review_lang").parquet(hive)
    df.write.parquet(flat)
    df.where("x = 1").drop("review_lang").write.parquet(f"{plain}/en")
    for root in (hive, flat, plain):
        assert [r["x"] for r in readers.language_layout(spark, root, "en").collect()] == [1]
    assert readers.languages(spark, hive) == readers.languages(spark, flat) == ["en", "fr"]
    assert len(readers.list_parquet(spark, flat)[0]) >= 1
    out = str(tmp_path / "out")
    writers.publish(df, out)
    writers.publish(df.limit(1), out)
    assert spark.read.parquet(out).count() == 1
    assert writers.part_once(df, str(tmp_path / "parts"), "a") and not writers.part_once(df, str(tmp_path / "parts"), "a")
    assert writers.report(df.agg(F.count("*").alias("n")), str(tmp_path / "r.json")) == {"n": 2}
    assert writers.manifest(spark, flat).count() >= 1
    (tmp_path / "x.json").write_text('[{"a": 1}, {"a": 2}]')
    assert readers.json_array(spark, str(tmp_path / "x.json")).count() == 2
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nnot json\n')
    assert readers.json_lines(spark, str(tmp_path / "x.jsonl"), "a int").count() == 1
    (tmp_path / "x.csv").write_text("a,b\n1,x\n")
    assert readers.csv(spark, str(tmp_path / "x.csv")).first()["a"] == 1
    spark.createDataFrame([("u", "t")], "review_url string, review_text string").write.parquet(str(tmp_path / "d/reviews"))
    assert len(readers.discover(spark, str(tmp_path / "d"))["reviews"]) >= 1
    leaks = writers.findings(spark.createDataFrame([("gh_secret", "b")], "note string, user_key string"), {"key": "gh_[a-z]+"}, ("user_key",))
    assert rows(leaks) == [("note", "key", 1), ("user_key", "blocked name", 1)]


def test_ingestion_adds_only_new_files(spark, tmp_path):
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    df = spark.createDataFrame([("a", 0.8, 0.0), ("a", 0.1, 0.0)], "k string, perspective double, detoxify double")
    df.write.parquet(source)
    for _ in range(2):
        incremental.ingest(incremental.new_files(spark, source, df.schema), sink, mark)
        assert spark.read.parquet(sink).count() == 2
    df.write.mode("append").parquet(source)
    incremental.ingest(incremental.new_files(spark, source, df.schema), sink, mark)
    assert spark.read.parquet(sink).count() == 4
    counts = incremental.latest_counts(spark, incremental.running_counts(incremental.new_files(spark, source, df.schema), "k"), "k_counts")
    assert rows(counts) == [("a", 4, 2)]


def test_chunks_follow_the_budget(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([50, 20, 60, 10, 100])], "i int, t int")
    assert [r["chunk"] for r in chunking.chunk_by_budget(df.withColumn("g", F.lit(1)), "i", "t", 70, "g").orderBy("i").collect()] == [0, 0, 1, 1, 2]


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("range_rows", [80, 1, 1000])
def test_running_sums_in_ranges(spark, descending, range_rows):
    from quillspark.operators.ordering import running_sums

    rng = random.Random(8)
    data = [(g, v, rng.randint(0, 9)) for g in ("a", None) for v in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(data, "g string, v int, x int")
    got = {(r["g"], r["v"]): r["s"] for r in running_sums(df, "v", {"s": "x"}, ["g"], descending, range_rows=range_rows).collect()}
    before = lambda a, b: b >= a if descending else b <= a
    assert got == {(g, v): sum(x for h, w, x in data if h == g and before(v, w)) for g, v, _ in data}


def test_thinned_distribution(spark):
    df = spark.range(1, 1001).select((F.col("id") % 500).alias("x"))
    out = reports.ecdf(df, "x", points=50).orderBy("value").collect()
    assert 50 <= len(out) <= 52 and out[0]["value"] == 0 and out[-1]["share"] == 1.0


@pytest.mark.parametrize("n", [0, 1, 37, 199, 200, 500])
@pytest.mark.parametrize("ordered", [1, 50_000])
def test_samples_are_the_first_by_md5(spark, n, ordered, monkeypatch):
    from quillspark.functions.hashing import md5_number
    from quillspark.operators import sampling

    monkeypatch.setattr(sampling, "ORDERED_ROWS", ordered)
    df = spark.range(200).select(F.col("id").cast("string").alias("k"))
    want = df.orderBy(md5_number(F.col("k"), "s"), "k").limit(n)
    assert sorted(sampling.sample_rows(df, "k", n, "s").collect()) == sorted(want.collect())


@pytest.mark.parametrize("range_rows", [3, 100_000])
def test_exact_quantiles_against_numpy(spark, monkeypatch, range_rows):
    from quillspark.operators import ordering

    monkeypatch.setattr(ordering.running_sums, "__defaults__", (*ordering.running_sums.__defaults__[:-1], range_rows))
    rng = random.Random(2)
    values = [round(rng.random() * 20) / 4 for _ in range(157)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    assert ordering.exact_quantiles(df, "v", shares).first()["q"] == pytest.approx(np.quantile(values, shares).tolist())
    assert ordering.exact_quantiles(df.limit(0), "v", shares).first()["q"] is None
    assert ordering.exact_quantiles(df.where("v = 1"), "v", [0.5]).first()["q"] == [1.0]
