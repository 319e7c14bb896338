"""Toxicity labels from two scores, score validity, and small categorical columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The inclusive thresholds of the union label.
PERSPECTIVE, DETOXIFY = 0.7, 0.9


def valid_score(score: Column) -> Column:
    """True for a score in [0, 1]; false for any other and for null."""
    return F.coalesce(score.between(0, 1), F.lit(False))


def valid_scores(perspective: Column, detoxify: Column) -> Column:
    return valid_score(perspective) & valid_score(detoxify)


def toxic(perspective: Column, detoxify: Column, p: float = PERSPECTIVE, d: float = DETOXIFY) -> Column:
    """1 if either score reaches its threshold, else 0, also for null scores."""
    return F.when((perspective >= p) | (detoxify >= d), 1).otherwise(0)


def label_source(perspective: Column, detoxify: Column, p: float = PERSPECTIVE, d: float = DETOXIFY) -> Column:
    """both, detox, persp or none, by which scores reach their thresholds."""
    return F.when((detoxify >= d) & (perspective >= p), "both").when(detoxify >= d, "detox").when(perspective >= p, "persp").otherwise("none")


def count_bucket(n: Column) -> Column:
    return F.when(n <= 1, "1").when(n <= 4, "2-4").when(n <= 9, "5-9").otherwise(">=10")


def confusion_cell(truth: Column, predicted: Column) -> Column:
    return F.when((truth == 1) & (predicted == 1), "TP").when((truth == 0) & (predicted == 1), "FP").when((truth == 1) & (predicted == 0), "FN").otherwise("TN")


def detector_agrees(detected: Column, declared: Column) -> Column:
    """The detector found the declared language, or none at all."""
    return F.coalesce((detected == declared) | (detected == "und"), F.lit(False))


def language_agrees(detected: Column, declared: Column, languages: list[str]) -> Column:
    return F.coalesce(detected.isin(languages) & (detected == declared), F.lit(False))
