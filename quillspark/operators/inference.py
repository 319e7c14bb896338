"""Pluggable external models: detectors, scorers, encoders and chat, with deterministic stand-ins offline."""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import MIN_LETTERS, cut, for_detection, matches, without_boilerplate

Detector = Callable[[str], tuple[str, float]]
Scorer = Callable[[list[str]], list[float]]
Encoder = Callable[[list[str]], list[list[float]]]
Chat = Callable[[str, str], str]

#: Common short words, by which the stand-in detector tells languages apart.
MARKERS = {
    "en": ("the", "and", "of", "to", "in", "that", "with", "for", "are", "this"),
    "fr": ("le", "la", "les", "de", "des", "et", "que", "pour", "dans", "qui"),
    "de": ("der", "die", "das", "und", "von", "mit", "ein", "sich", "auf", "nicht"),
    "es": ("el", "los", "las", "de", "que", "y", "para", "una", "como", "por"),
    "pt": ("o", "os", "as", "que", "de", "e", "para", "uma", "com", "não"),
}


def marker_detector(text: str) -> tuple[str, float]:
    """Stand-in detector: the language with the most marker words, und without any."""
    words = text.lower().split()
    counts = {lang: sum(w in marks for w in words) for lang, marks in MARKERS.items()}
    best = max(sorted(counts), key=counts.get)
    total = sum(counts.values())
    return (best, counts[best] / total) if total else ("und", 0.0)


def detect_language(df: DataFrame, text: str, detector: Detector = marker_detector, lang: str = "review_lang", confidence: str = "detection_confidence") -> DataFrame:
    """df with the detected language and confidence; und and 0 for too few letters or a detector that fails."""

    @F.pandas_udf("struct<lang string, conf double>")
    def detect(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            rows = []
            for t in s:
                try:
                    rows.append(detector(t) if t else ("und", 0.0))
                except Exception:  # a third-party detector's own errors
                    rows.append(("und", 0.0))
            yield pd.DataFrame(rows, columns=["lang", "conf"])

    clean = for_detection(F.col(text))
    got = detect(F.when(F.length(clean) >= MIN_LETTERS, clean))
    return df.withColumn("_got", got).withColumns({lang: F.coalesce("_got.lang", F.lit("und")), confidence: F.coalesce("_got.conf", F.lit(0.0))}).drop("_got")


def word_scorer(texts: list[str]) -> list[float]:
    """Stand-in scorer: grows with rude words, from 0 to below 1."""
    rude = re.compile(r"\b(idiot|stupid|worthless|pathetic|scum|trash|moron|loser)\b", re.I)
    return [1 - math.exp(-len(rude.findall(t))) for t in texts]


def toxicity(text: Column, scorer: Scorer = word_scorer, batch: int = 32) -> Column:
    """The scorer's value of the cleaned, cut text, batch by batch; -1 for each text of a batch that fails."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            out: list[float] = []
            for i in range(0, len(s), batch):
                part = [t or "" for t in s.iloc[i : i + batch]]
                try:
                    out += scorer(part)
                except Exception:  # a third-party model's own errors
                    out += [-1.0] * len(part)
            yield pd.Series(out)

    return score(cut(without_boilerplate(text), "scoring"))


def score_with_cache(df: DataFrame, cache: DataFrame, key: str, text: str, out: str = "detoxify_score", exclude: str | None = None, scorer: Scorer = word_scorer) -> DataFrame:
    """df with scores: those of the cache(key, score) where it has them, the scorer's for the rest.

    Rows whose text matches `exclude` are scored anew. Keys of the cache must be unique.
    """
    known = df.join(cache.select(key, F.col("score").alias("_cached")), key, "left")
    if exclude:
        known = known.withColumn("_cached", F.when(~matches(F.col(text), exclude), F.col("_cached")))
    hit = known.where(F.col("_cached").isNotNull()).withColumn(out, F.col("_cached"))
    miss = known.where(F.col("_cached").isNull()).withColumn(out, toxicity(F.col(text), scorer))
    return hit.unionByName(miss).drop("_cached")


def patch_scores(df: DataFrame, text: str, score: str, pattern: str, scorer: Scorer = word_scorer) -> DataFrame:
    """df with the rows whose text matches scored anew, all others as they are; write it to a new path, then swap."""
    hit = matches(F.col(text), pattern)
    again = df.where(hit).withColumn(score, toxicity(F.col(text), scorer))
    return df.where(~hit).unionByName(again)


def hashed_encoder(size: int = 64) -> Encoder:
    """Stand-in encoder: words hashed to signed counts, at unit length."""

    def encode(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * size
            for w in t.lower().split():
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
                v[h % size] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out

    return encode


def embed(text: Column, encoder: Encoder | None = None, batch: int = 64) -> Column:
    encode = encoder or hashed_encoder()

    @F.pandas_udf("array<float>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            out: list[list[float]] = []
            for i in range(0, len(s), batch):
                out += encode([t or "" for t in s.iloc[i : i + batch]])
            yield pd.Series(out)

    return run(text)


def rule_chat(system: str, user: str) -> str:
    """Stand-in chat: calls a user toxic if the word scorer does."""
    s = word_scorer([user])[0]
    return '{"label": "%s", "user_toxicity_score": %d, "worst_review": -1}' % ("toxic" if s > 0.5 else "nontoxic", round(100 * s))


def ask(df: DataFrame, prompt: str, system: str, chat: Chat = rule_chat, retries: int = 3, wait_s: float = 0.0, out: str = "_raw") -> DataFrame:
    """df with the chat's answer to each prompt; after the last try that fails, ERR: and the error."""

    @F.pandas_udf("string")
    def call(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in prompts:
            got = []
            for p in s:
                for i in range(retries):
                    try:
                        got.append(chat(system, p))
                        break
                    except Exception as e:  # a remote service's own errors
                        if i + 1 == retries:
                            got.append(f"ERR:{e}")
                        else:
                            time.sleep(wait_s * (i + 1))
            yield pd.Series(got, dtype=object)

    return df.withColumn(out, call(F.col(prompt)))


def judge_pairs(narratives: DataFrame, judges: Sequence[str], done: DataFrame | None = None) -> DataFrame:
    """Each narrative(user_key, generator) with each judge but its own generator, without the pairs done."""
    each = narratives.withColumn("judge", F.explode(F.array(*map(F.lit, judges)))).where("judge <> generator")
    return each.join(done.select("user_key", "generator", "judge"), ["user_key", "generator", "judge"], "left_anti") if done is not None else each
