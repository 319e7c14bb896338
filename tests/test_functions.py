"""Traps of the scalar functions: nulls, sentinels, accents, ties, invalid dates."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import hashing, labels, parsing, text


def one(df):
    return df.first()[0]


@pytest.mark.parametrize(
    ("p", "d", "toxic", "source", "valid"),
    [
        (0.7, 0.0, 1, "persp", True), (0.0, 0.9, 1, "detox", True), (0.69, 0.89, 0, "none", True), (None, 0.95, 1, "detox", False),
        (0.8, None, 1, "persp", False), (None, None, 0, "none", False), (-1.0, 0.5, 0, "none", False), (1.2, 0.1, 1, "persp", False), (0.7, 0.9, 1, "both", True),
    ],
)
def test_labels(spark, p, d, toxic, source, valid):
    df = spark.createDataFrame([(p, d)], "p double, d double")
    row = df.select(labels.toxic(F.col("p"), F.col("d")), labels.label_source(F.col("p"), F.col("d")), labels.valid_scores(F.col("p"), F.col("d"))).first()
    assert tuple(row) == (toxic, source, valid)


@pytest.mark.parametrize(
    ("raw", "iso"),
    [("16 de maio de 2022", "2022-05-16"), ("1 de MARÇO de 2021", "2021-03-01"), ("31 de fevereiro de 2020", None), ("", None), (None, None), ("soon", None)],
)
def test_portuguese_dates(spark, raw, iso):
    assert one(spark.createDataFrame([(raw,)], "t string").select(parsing.portuguese_date(F.col("t")))) == iso


def test_sentinels_in_every_column(spark):
    df = spark.createDataFrame([("-1", -1, -1.0, "a"), ("", 2, 0.5, "-1")], "a string, b int, c double, d string")
    assert [tuple(r) for r in parsing.nullify_sentinels(df).collect()] == [(None, None, None, "a"), (None, 2, 0.5, None)]


@pytest.mark.parametrize(
    ("url", "kind", "key"),
    [("https://h/profiles/7656", "profiles", "7656"), ("https://h/id/name/x", "vanity", "v:name"), ("https://h/other", "outro", None), (None, "outro", None)],
)
def test_urls(spark, url, kind, key):
    row = spark.createDataFrame([(url,)], "u string").select(parsing.url_type(F.col("u")), parsing.group_key(F.col("u"))).first()
    assert tuple(row) == (kind, key)


def test_text_features(spark):
    rows = [(None,), ("",), ("   ",), ("ÉABC hey!! WHAT? brrrr é😀",)]
    out = [r.asDict() for r in spark.createDataFrame(rows, "t string").select(*(c.alias(n) for n, c in text.surface_features(F.col("t")).items())).collect()]
    assert [r["len_words"] for r in out] == [0, 0, 0, 5]
    last = out[3]
    assert (last["len_chars"], last["upper_word_count"], last["rrun_count"], last["excl_count"], last["ques_count"]) == (25, 2, 1, 2, 1)


def test_cleaning_keeps_accents_for_detection_and_folds_them_for_terms(spark):
    df = spark.createDataFrame([("Análise de Acesso Antecipado É bom! http://x.y 12 maçã_1",)], "t string")
    assert one(df.select(text.for_detection(F.col("t")))) == "É bom maçã"
    assert one(df.select(text.for_terms(F.col("t")))) == "e bom maca"
    assert one(df.select(text.without_boilerplate(F.lit("PRODUTO RECEBIDO DE GRAÇA ok")))) == "ok"


@pytest.mark.parametrize(
    ("answer", "label", "score", "worst"),
    [
        ('{"label": "toxic", "user_toxicity_score": 80, "worst_review": 2}', 1, 0.8, 2),
        ('Sure {"label": "non-toxic", "user_toxicity_score": 250} ok', 0, 1.0, -1),
        ("nontoxic", 0, 0.0, -1), ("", None, 0.0, -1), ("ERR:timeout", None, 0.0, -1), (None, None, 0.0, -1), ("Toxic.", 1, 1.0, -1),
    ],
)
def test_answers(spark, answer, label, score, worst):
    t = F.col("t")
    row = spark.createDataFrame([(answer,)], "t string").select(parsing.answer_label(t), parsing.answer_score(t, parsing.answer_label(t)), parsing.answer_worst(t)).first()
    assert tuple(row) == (label, score, worst)


def test_tags(spark):
    df = spark.createDataFrame([(" a , ,b",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(parsing.split_tags(F.col("t"))).collect()] == [["a", "b"], None, []]


def test_splits_are_stable_and_disjoint(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k")).withColumn("s", hashing.split_name(F.col("k")))
    shares = {r["s"]: r["n"] for r in df.groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert set(shares) == {"train", "val", "test"} and 650 < shares["train"] < 750
    assert df.exceptAll(df).isEmpty()
    assert one(spark.createDataFrame([(None,)], "k string").select(hashing.split_name(F.col("k")))) in shares


def test_prompt(spark):
    df = spark.createDataFrame([(["a", "b"], 5)], "t array<string>, n int")
    got = one(df.select(text.prompt(F.col("t"), F.col("n"), 2, "Judge.")))
    assert got == 'User\'s reviews (5 total, showing 2 at random):\n[0] """a"""\n[1] """b"""\n... and 3 more reviews not shown.\nJudge.'
