"""Kernel machines by random Fourier features: an approximate Gaussian kernel in front of a linear machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.hashing import md5_number

#: Rows of which the width of the kernel is taken; all others are only transformed.
WIDTH_ROWS = 1000


def directions(n_features: int, size: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequencies and shifts of the features, from the seed alone."""
    rng = np.random.default_rng([seed, n_features, size])
    return rng.normal(0.0, 1.0 / width, (n_features, size)), rng.uniform(0.0, 2 * np.pi, size)


def fourier(x: np.ndarray, size: int, width: float, seed: int) -> np.ndarray:
    """Features whose inner products approximate exp(-|x - y|^2 / (2 width^2)), within about 1 / sqrt(size)."""
    w, shift = directions(x.shape[1], size, width, seed)
    return np.sqrt(2.0 / size) * np.cos(x @ w + shift)


class _FourierParams(HasFeaturesCol, HasOutputCol, HasSeed):
    size = Param(Params._dummy(), "size", "number of features", TypeConverters.toInt)
    width = Param(Params._dummy(), "width", "width of the kernel; 0: half of the squared rows' median distance", TypeConverters.toFloat)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(size=256, width=0.0, seed=7, featuresCol="features", outputCol="fourier")


def median_width(rows: np.ndarray) -> float:
    """The median distance of different rows; 1 where there is none."""
    squares = (rows * rows).sum(axis=1)
    distances = np.maximum(squares[:, None] + squares[None, :] - 2 * rows @ rows.T, 0)[np.triu_indices(len(rows), 1)]
    far = distances[distances > 1e-12]
    return float(np.sqrt(np.median(far))) if len(far) else 1.0


class RandomFourierFeatures(Estimator, _FourierParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits the width by the median distance among WIDTH_ROWS rows, the first by the md5 of their values and the seed."""

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", outputCol: str = "fourier", size: int = 256, width: float = 0.0, seed: int = 7) -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> RandomFourierModel:
        width = self.getOrDefault("width")
        if width <= 0:
            values = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x")).where("x IS NOT NULL")
            chance = md5_number(F.array_join(F.transform("x", lambda v: v.cast("string")), ","), str(self.getSeed()))
            rows = values.orderBy(chance).limit(WIDTH_ROWS).collect()  # a bounded sample
            width = median_width(np.array([r["x"] for r in rows])) if rows else 1.0
        model = RandomFourierModel()
        return model._set(featuresCol=self.getFeaturesCol(), outputCol=self.getOutputCol(), size=self.getOrDefault("size"), seed=self.getSeed(), width=width)


class RandomFourierModel(Model, _FourierParams, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the features as a vector, a matrix product a batch; what defines them are the seed, size and width."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        size, width, seed = self.getOrDefault("size"), self.getOrDefault("width"), self.getSeed()

        @F.pandas_udf("array<double>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield pd.Series(list(fourier(np.vstack(s), size, width, seed)) if len(s) else [], dtype=object)

        return dataset.withColumn(self.getOutputCol(), array_to_vector(run(vector_to_array(self.getFeaturesCol()))))
