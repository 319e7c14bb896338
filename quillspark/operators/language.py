"""Language detection by a fitted model of character n-grams, scored with joins and sums alone.

The model is naive Bayes over the n-grams of words with a space at either end: for each kept n-gram
a whole number for each language, the rounded 1000-fold of its smoothed log-probability, so sums don't
depend on the order of rows. Frequent words have their sums stored; only other words are cut into
n-grams when texts are scored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import MIN_LETTERS, for_detection

SIZES = (1, 2, 3)
#: Most n-grams and stored words (those of most occurrences), and most numbers of the stored words by languages, which bounds
#: what is broadcast; weight of an n-gram never seen.
MOST_GRAMS, MOST_WORDS, MOST_NUMBERS, SMOOTHING = 60_000, 300_000, 12_000_000, 0.5
#: Most languages, each a column of the scores.
MOST_LANGUAGES = 256


@dataclass(frozen=True)
class LanguageModel:
    """languages in order; grams(gram, s0, s1, ...) and words(word, w0, w1, ...) with a column for each language."""

    languages: tuple[str, ...]
    grams: DataFrame
    words: DataFrame

    def save(self, path: str) -> None:
        spark = self.grams.sparkSession
        spark.createDataFrame(list(enumerate(self.languages)), "place int, lang string").coalesce(1).write.parquet(f"{path}/languages")
        self.grams.write.parquet(f"{path}/grams")
        self.words.write.parquet(f"{path}/words")

    @staticmethod
    def load(spark: SparkSession, path: str) -> LanguageModel:
        languages = tuple(r["lang"] for r in spark.read.parquet(f"{path}/languages").orderBy("place").collect())
        return LanguageModel(languages, spark.read.parquet(f"{path}/grams"), spark.read.parquet(f"{path}/words"))


def detection_words(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """(columns, _word): lower-case words of the cleaned, cut texts; one null word for a text of too few letters."""
    clean = df.select(*columns, for_detection(F.col(text)).alias("_clean"))  # its own step, so that it is computed once
    words = F.when(F.length("_clean") >= MIN_LETTERS, F.split(F.lower("_clean"), " "))
    return clean.select(*columns, F.explode_outer(words).alias("_word"))


def word_grams(word: Column, sizes: Sequence[int] = SIZES) -> Column:
    """All n-grams of the word with a space at either end."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))

    def of(k: int) -> Column:
        starts = F.length(padded) - k + 1
        cut = F.transform(F.sequence(F.lit(1), starts), lambda i: F.substring(padded, i, F.lit(k)))
        return F.when(starts >= 1, cut).otherwise(F.array().cast("array<string>"))

    return F.concat(*map(of, sizes))


def fit(labelled: DataFrame, text: str, lang: str, *, most_grams: int = MOST_GRAMS, most_words: int = MOST_WORDS, smoothing: float = SMOOTHING) -> LanguageModel:
    """The model of the labelled texts, of which rows without language or with too few letters don't count.

    Kept are the most_grams n-grams of most occurrences (ties in their order); without any language
    in the input it is a ValueError.
    """
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    words = detection_words(known, text, lang).where("_word IS NOT NULL").groupBy(F.col(lang).alias("lang"), F.col("_word").alias("word")).agg(F.count("*").alias("n"))
    found = sorted(r["lang"] for r in known.select(F.col(lang).alias("lang")).distinct().limit(MOST_LANGUAGES + 1).collect())
    if not 0 < len(found) <= MOST_LANGUAGES:
        raise ValueError(f"from 1 to {MOST_LANGUAGES} languages are needed")
    languages = tuple(found)
    counted = words.select("lang", "n", F.explode(word_grams(F.col("word"))).alias("gram")).groupBy("gram").agg(*(F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(languages)))
    total = sum((F.col(f"n{i}") for i in range(len(languages))), F.lit(0))
    kept = counted.withColumn("n", total).orderBy(F.desc("n"), "gram").limit(most_grams)
    sums = kept.agg(F.count("*").alias("kinds"), *(F.sum(f"n{i}").alias(f"t{i}") for i in range(len(languages)))).first()
    log_odds = lambda i: F.round(1000 * F.log((F.col(f"n{i}") + smoothing) / ((sums[f"t{i}"] or 0) + smoothing * sums["kinds"]))).cast("long")
    grams = kept.select("gram", *(log_odds(i).alias(f"s{i}") for i in range(len(languages))))
    common = words.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(min(most_words, MOST_NUMBERS // len(languages))).select("word")
    cut = common.select("word", F.explode(word_grams(F.col("word"))).alias("gram")).join(F.broadcast(grams), "gram", "left")
    stored = cut.groupBy("word").agg(*(F.coalesce(F.sum(f"s{i}"), F.lit(0)).alias(f"w{i}") for i in range(len(languages))))
    return LanguageModel(languages, grams, stored)


def language_scores(df: DataFrame, key: str, text: str, model: LanguageModel) -> DataFrame:
    """(key, scores): for each key the sum of its n-grams' values, by language; null for too few letters."""
    n = len(model.languages)
    rows = detection_words(df, text, key)
    stored = F.broadcast(model.words.withColumnRenamed("word", "_of"))  # at most MOST_WORDS words and MOST_NUMBERS numbers
    known = rows.join(stored, F.col("_word") == F.col("_of"), "left")
    grams = F.when(F.col("_of").isNull() & F.col("_word").isNotNull(), word_grams(F.col("_word")))
    table = F.broadcast(model.grams.withColumnRenamed("gram", "_part"))
    cut = known.select(key, "_word", *(f"w{i}" for i in range(n)), F.explode_outer(grams).alias("_gram")).join(table, F.col("_gram") == F.col("_part"), "left")
    sums = cut.groupBy(key).agg(F.count("_word").alias("_n"), *(F.sum(F.coalesce(f"w{i}", f"s{i}", F.lit(0))).alias(f"s{i}") for i in range(n)))
    return sums.select(key, F.when(F.col("_n") > 0, F.array(*(F.col(f"s{i}") for i in range(n)))).alias("scores"))


def decided(scores: Column, languages: Sequence[str]) -> tuple[Column, Column]:
    """The language of the highest score (ties: the first), and its share of all likelihoods."""
    best = F.array_max(scores)
    name = F.when(scores.isNotNull(), F.get(F.array(*map(F.lit, languages)), F.array_position(scores, best).cast("int") - 1))
    share = 1 / F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.exp((x - best) / 1000))
    return name, share


def detect(df: DataFrame, key: str, text: str, model: LanguageModel, *, lang: str = "review_lang", confidence: str = "detection_confidence") -> DataFrame:
    """(key, lang, confidence) of every key of df; und and 0 for a null text or one of too few letters.

    Keys should be unique: texts of one key are judged together. No Python runs, texts are read once, and
    what goes through the one shuffle is a row of sums for each key and task.
    """
    name, share = decided(F.col("scores"), model.languages)
    return language_scores(df, key, text, model).select(key, F.coalesce(name, F.lit("und")).alias(lang), F.coalesce(share, F.lit(0.0)).alias(confidence))


def accuracy(detected: DataFrame, truth: str, found: str = "review_lang") -> DataFrame:
    """One row (n, n_decided, n_right, accuracy): of the rows with a known language, those decided and those right."""
    known = detected.where(F.col(truth).isNotNull())
    sure = F.col(found) != "und"
    right = sure & (F.col(found) == F.col(truth))
    return known.agg(F.count("*").alias("n"), F.count_if(sure).alias("n_decided"), F.count_if(right).alias("n_right"), F.coalesce(F.count_if(right) / F.nullif(F.count_if(sure), F.lit(0)), F.lit(0.0)).alias("accuracy"))
