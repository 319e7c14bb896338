"""User-level models with Spark ML: preprocessing inside folds, feature arms, out-of-fold scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.kernels import RandomFourierFeatures
from quillspark.operators.learners import TreeLearner
from quillspark.operators.sampling import sample_rows
from quillspark.operators.trees import BoostingParams, ForestParams

#: Most categories that one-hot encoding keeps; the rest are "other".
MOST_CATEGORIES = 14


def classifier(name: str, n_features: int, seed: int = 7):
    """logreg, svm, forest, boosted, mlp, hist_boosted, extra_trees or rbf. Vendor boosters have no counterpart here."""
    columns = {"featuresCol": "features", "labelCol": "label"}
    fourier = RandomFourierFeatures(featuresCol="features", outputCol="fourier", size=256, seed=seed)
    made = {
        "logreg": lambda: LogisticRegression(maxIter=50, regParam=0.01, **columns),
        "svm": lambda: LinearSVC(maxIter=30, regParam=0.01, **columns),
        "forest": lambda: RandomForestClassifier(numTrees=50, maxDepth=6, seed=seed, **columns),
        "boosted": lambda: GBTClassifier(maxIter=20, maxDepth=3, seed=seed, **columns),
        "hist_boosted": lambda: TreeLearner(BoostingParams(rounds=20)),
        "extra_trees": lambda: TreeLearner(ForestParams(seed=seed)),
        "rbf": lambda: Pipeline(stages=[fourier, LinearSVC(maxIter=50, regParam=0.001, featuresCol="fourier", labelCol="label")]),
        "mlp": lambda: MultilayerPerceptronClassifier(layers=[n_features, 16, 2], maxIter=50, seed=seed, **columns),
    }
    return made[name]()


def frequent_or_other(df: DataFrame, column: str, most: int = MOST_CATEGORIES) -> list[str]:
    rows = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(most).collect()
    return [r[column] for r in rows]


def pipeline(train: DataFrame, model: str, numeric: Sequence[str], categorical: Sequence[str] = (), vector: str | None = None) -> tuple[Pipeline, Mapping[str, Column]]:
    """Median imputation and scaling of numbers, one-hot of frequent categories, and a vector as it is.

    What is learned from data is learned from `train` alone; the mapping has the columns to add to a
    table before it goes through the pipeline.
    """
    added: dict[str, Column] = {f"_{c}": F.col(c).cast("double") for c in numeric}
    for c in categorical:
        keep = frequent_or_other(train, c)
        added[f"_{c}"] = F.when(F.col(c).isin(keep), F.col(c)).otherwise("other") if keep else F.lit("other")
    if vector:
        added["_vector"] = array_to_vector(F.col(vector).cast("array<double>"))
    nums = [f"_{c}" for c in numeric]
    stages: list = []
    parts = []
    if nums:
        stages += [Imputer(inputCols=nums, outputCols=[f"{c}i" for c in nums], strategy="median"), VectorAssembler(inputCols=[f"{c}i" for c in nums], outputCol="_nums"), StandardScaler(inputCol="_nums", outputCol="_scaled", withMean=True)]
        parts.append("_scaled")
    for c in categorical:
        stages += [StringIndexer(inputCol=f"_{c}", outputCol=f"_{c}x", handleInvalid="keep"), OneHotEncoder(inputCol=f"_{c}x", outputCol=f"_{c}v", handleInvalid="keep")]
        parts.append(f"_{c}v")
    if vector:
        parts.append("_vector")
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    stages.append(classifier(model, len(numeric)))
    return Pipeline(stages=stages), added


def score(scored: DataFrame) -> Column:
    """The positive class's probability, or the margin where there is none."""
    column = "probability" if "probability" in scored.columns else "rawPrediction"
    return F.get(vector_to_array(column), F.lit(1))


def out_of_fold(df: DataFrame, key: str, label: str, fold: str, model: str, numeric: Sequence[str], categorical: Sequence[str] = (), vector: str | None = None, train_cap: int | None = None) -> DataFrame:
    """(key, y, score, fold): each fold scored by a model trained on the others (at most train_cap rows)."""
    data = df.withColumn("label", F.col(label).cast("double"))
    out = None
    for k in sorted(r[fold] for r in data.select(fold).distinct().collect()):
        train = data.where(F.col(fold) != k)
        train = sample_rows(train, key, train_cap, f"fold{k}") if train_cap else train
        steps, added = pipeline(train, model, numeric, categorical, vector)
        scored = steps.fit(train.withColumns(added)).transform(data.where(F.col(fold) == k).withColumns(added))
        part = scored.select(F.col(key), F.col("label").cast("int").alias("y"), score(scored).alias("score"), F.col(fold))
        out = part if out is None else out.unionByName(part)
    return out


def arms(df: DataFrame, key: str, fold: str, labels: Sequence[str], arms_: Mapping[str, Mapping], models: Sequence[str]) -> DataFrame:
    """Out-of-fold scores of every label, feature arm and model, in one long table."""
    out = None
    for label in labels:
        for arm, columns in arms_.items():
            for model in models:
                part = out_of_fold(df, key, label, fold, model, **columns).withColumns({"label": F.lit(label), "arm": F.lit(arm), "model": F.lit(model)})
                out = part if out is None else out.unionByName(part)
    return out


def clean_population(users: DataFrame, least_positives: int = 50, two: bool = False) -> DataFrame:
    """Users with a non-toxic review (and with two reviews or more), if enough of them are positive."""
    kept = users.where("n_reviews - n_toxic >= 1" + (" AND n_reviews >= 2" if two else ""))
    n = kept.where("n_toxic >= 1").count()
    if n < least_positives:
        raise ValueError(f"only {n} positives; {least_positives} are needed")
    return kept
