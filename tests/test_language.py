"""The fitted language model against a plain one, its gate, its words and its accuracy on documents held out."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.functions.hashing import md5_bucket
from quillspark.operators import language

SF = "/root/testdata/sf0.001"
ROWS = [
    ("the cat and the dog are in the house of the king", "en"), ("this is the end of all that we know of the world", "en"),
    ("le chat et le chien sont dans la maison du roi", "fr"), ("la fin de tout ce que nous savons du monde", "fr"),
    ("der hund und die katze sind in dem haus des herrn", "de"), (None, "de"), ("12345 !!", "de"), ("no language is known for this long text", None),
]


def grams(word):
    padded = f" {word} "
    return [padded[i : i + k] for k in (1, 2, 3) for i in range(len(padded) - k + 1)]


def plain_model(rows):
    counts = {}
    for text, lang in rows:
        clean = re.sub("[^a-z ]", "", text or "").strip()
        if lang and len(clean) >= 20:
            counts.setdefault(lang, Counter()).update(g for w in clean.split() for g in grams(w))
    every = {g for c in counts.values() for g in c}
    return {lang: {g: round(1000 * math.log((c[g] + 0.5) / (sum(c.values()) + 0.5 * len(every)))) for g in every} for lang, c in counts.items()}


@pytest.fixture(scope="module")
def model(spark):
    return language.fit(spark.createDataFrame(ROWS, "t string, l string"), "t", "l", most_words=5)


def test_model_equals_a_plain_one(spark, model):
    want = plain_model(ROWS)
    assert model.languages == ("de", "en", "fr") == tuple(sorted(want))
    got = {r["gram"]: [r[f"s{i}"] for i in range(3)] for r in model.grams.collect()}
    assert got == {g: [want[x][g] for x in model.languages] for g in want["en"]}
    assert model.words.count() == 5


def test_scores_don_t_depend_on_stored_words(spark, model):
    texts = [(i, t) for i, t in enumerate(["the end of the house", "der hund des herrn und zzzz", "la maison qqqqq wwwww xxxxx"])]
    df = spark.createDataFrame(texts, "k int, t string")
    want = plain_model(ROWS)
    plain = {i: [sum(want[x].get(g, 0) for w in t.split() for g in grams(w)) for x in model.languages] for i, t in texts}
    assert {r["k"]: r["scores"] for r in language.language_scores(df, "k", "t", model).collect()} == plain
    found = {r["k"]: (r["review_lang"], r["detection_confidence"]) for r in language.detect(df, "k", "t", model).collect()}
    assert [found[i][0] for i in range(3)] == ["en", "de", "fr"]
    assert found[0][1] == pytest.approx(1 / sum(math.exp((s - max(plain[0])) / 1000) for s in plain[0]))


def test_gate_and_edge_cases(spark, model):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (4, "1234567890 " * 9), (None, "the house of the king of it"), (5, "жжжжж жжжжж жжжжж жжжжжж")], "k int, t string")
    found = {r["k"]: (r["review_lang"], r["detection_confidence"]) for r in language.detect(df, "k", "t", model).collect()}
    assert {k: v for k, v in found.items() if k in (1, 2, 3, 4)} == {k: ("und", 0.0) for k in (1, 2, 3, 4)}
    assert found[None][0] == "en" and found[5][0] in model.languages
    assert language.detect(df.limit(0), "k", "t", model).count() == 0
    with pytest.raises(ValueError):
        language.fit(df.where("k = 1").withColumn("l", F.lit("en")).limit(0), "t", "l")


def test_saved_model_is_the_same(spark, model, tmp_path):
    model.save(f"{tmp_path}/m")
    again = language.LanguageModel.load(spark, f"{tmp_path}/m")
    assert again.languages == model.languages and again.grams.exceptAll(model.grams).isEmpty() and again.words.exceptAll(model.words).isEmpty()


def test_accuracy_on_documents_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    held_out = md5_bucket(F.col("doc_id"), 3) == 0
    model = language.fit(docs.where(~held_out), "text", "lang")
    found = language.detect(docs.where(held_out), "doc_id", "text", model).join(docs.select("doc_id", "lang"), "doc_id")
    got = language.accuracy(found, "lang").first()
    assert got["n_decided"] > 50 and got["accuracy"] > 0.97


def test_no_python_and_one_shuffle(spark, model, tmp_path):
    model.save(f"{tmp_path}/plan")
    model = language.LanguageModel.load(spark, f"{tmp_path}/plan")
    df = spark.createDataFrame([(1, "the house of the king of it")], "k int, t string")
    plan = language.detect(df, "k", "t", model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and plan.count("BroadcastHashJoin") == 2 and plan.count("Exchange hashpartitioning") == 1
