"""A toxicity scorer fitted on labelled texts: hashed words and pairs, logistic regression, isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.hashing import md5_bucket
from quillspark.functions.text import cut, without_boilerplate

#: Cells of hashed words, and of hashed pairs of words.
WORD_CELLS, PAIR_CELLS = 1 << 15, 1 << 16
#: One in so many labelled rows, by the md5 of their key, calibrates and isn't fitted on.
CALIBRATION = 5
#: What a text that can't be scored gets.
FAILED = -1.0


def _text(column: str) -> Column:
    return F.lower(cut(without_boilerplate(F.coalesce(F.col(column), F.lit(""))), "scoring"))


@dataclass(frozen=True)
class ToxicityModel:
    """A linear model of the cleaned, cut text, and the map from its probability to a calibrated one."""

    linear: PipelineModel
    calibration: IsotonicRegressionModel

    def transform(self, df: DataFrame, text: str, out: str = "detoxify_score") -> DataFrame:
        """df with the score of its text, from 0 to 1; FAILED for a null text. Everything runs in the JVM."""
        made = {c: f"_tox_{c}" for c in ("text", "raw")}
        scored = self.linear.transform(df.withColumn(made["text"], _text(text)))
        raw = scored.withColumn(made["raw"], F.get(vector_to_array("_tox_probability"), F.lit(1)))
        calibrated = self.calibration.transform(raw)
        score = F.when(F.col(text).isNull(), F.lit(FAILED)).otherwise(F.least(F.greatest(F.col("_tox_calibrated"), F.lit(0.0)), F.lit(1.0)))
        return calibrated.select(*df.columns, score.alias(out))

    def save(self, path: str) -> None:
        self.linear.write().overwrite().save(f"{path}/linear")
        self.calibration.write().overwrite().save(f"{path}/calibration")

    @staticmethod
    def load(path: str) -> ToxicityModel:
        return ToxicityModel(PipelineModel.load(f"{path}/linear"), IsotonicRegressionModel.load(f"{path}/calibration"))


def fit(labelled: DataFrame, key: str, text: str, label: str, *, penalty: float = 0.005) -> ToxicityModel:
    """The model of labelled texts: four fifths of them, by the md5 of their key, fit the linear part, the rest calibrate.

    Rows without text or label don't count. Features are the presence of hashed words and pairs;
    the penalty on absolute weights leaves out what hardly tells anything.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(_text(text).alias("_tox_text"), F.col(label).cast("double").alias("_tox_y"), md5_bucket(F.col(key), CALIBRATION, "calibration").alias("_tox_part"))
    stages = [
        RegexTokenizer(inputCol="_tox_text", outputCol="_tox_words", pattern=r"[\p{L}\p{N}]+", gaps=False),
        NGram(n=2, inputCol="_tox_words", outputCol="_tox_pairs"),
        HashingTF(inputCol="_tox_words", outputCol="_tox_word_cells", numFeatures=WORD_CELLS, binary=True),
        HashingTF(inputCol="_tox_pairs", outputCol="_tox_pair_cells", numFeatures=PAIR_CELLS, binary=True),
        VectorAssembler(inputCols=["_tox_word_cells", "_tox_pair_cells"], outputCol="_tox_features"),
        LogisticRegression(featuresCol="_tox_features", labelCol="_tox_y", probabilityCol="_tox_probability", rawPredictionCol="_tox_margin", predictionCol="_tox_called", maxIter=60, regParam=penalty, elasticNetParam=1.0),
    ]
    linear = Pipeline(stages=stages).fit(rows.where(F.coalesce("_tox_part", F.lit(1)) != 0))
    held = linear.transform(rows.where("_tox_part = 0")).withColumn("_tox_raw", F.get(vector_to_array("_tox_probability"), F.lit(1)))
    calibration = IsotonicRegression(featuresCol="_tox_raw", labelCol="_tox_y", predictionCol="_tox_calibrated").fit(held)
    return ToxicityModel(linear, calibration)


def calibration_error(scored: DataFrame, truth: str, score: str, bins: int = 10) -> DataFrame:
    """One row (n, ece): the mean gap of score and truth over bins of equal width, by their rows; scores below 0 don't count."""
    kept = scored.where((F.col(score) >= 0) & F.col(truth).isNotNull())
    place = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    cells = kept.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg(score) - F.avg(F.col(truth))).alias("gap"))
    return cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))
