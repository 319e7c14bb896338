"""The tree ensembles as estimators of Spark ML, so that they stand in pipelines as any classifier does."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import trees
from quillspark.operators.trees import BoostingParams, Boosted, ExtraTrees, ForestParams


class Scorer(Model):
    """Adds `probability`, a vector of both classes' shares."""

    def __init__(self, ensemble: Boosted | ExtraTrees, features: str) -> None:
        super().__init__()
        self.ensemble, self.features = ensemble, features

    def _transform(self, dataset: DataFrame) -> DataFrame:
        p = self.ensemble.score(vector_to_array(self.features))
        return dataset.withColumn("_p", p).withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))).drop("_p")


class TreeLearner(Estimator):
    """Fits boosted or extremely randomised trees, by the kind of params, to vectors `features` and 0/1 labels `label`."""

    def __init__(self, params: BoostingParams | ForestParams, features: str = "features", label: str = "label") -> None:
        super().__init__()
        self.of, self.features, self.label = params, features, label

    def _fit(self, dataset: DataFrame) -> Scorer:
        rows = dataset.select(F.col(self.label).alias("y"), vector_to_array(self.features).alias("x"))
        n = rows.agg(F.max(F.size("x")).alias("n")).first()["n"] or 0
        grown = trees.boost if isinstance(self.of, BoostingParams) else trees.extra_trees
        return Scorer(grown(rows, "y", "x", n_features=n, params=self.of), self.features)
