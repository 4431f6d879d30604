"""Random Fourier features as a stage of pyspark.ml."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.sources.store import workers_know


class FourierFeatures(Transformer):
    """cos(w x + b) for random w of normal components with deviation 1 / width: products of these features are near the Gaussian kernel of that width.

    w and b depend on the seed and the number of components alone, so batches
    and streams get the same features. The input's own components go along.
    """

    def __init__(self, input_column: str, output_column: str, features: int, width: float, seed: int = 0):
        super().__init__()
        self.input_column, self.output_column, self.features, self.width, self.seed = input_column, output_column, features, width, seed

    def drawn(self, components: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng([self.seed, components])
        return rng.normal(size=(self.features, components)) / self.width, rng.uniform(0, 2 * np.pi, self.features)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        workers_know(dataset.sparkSession)
        first = dataset.select(F.size(vector_to_array(self.input_column)).alias("n")).first()
        if first is None:
            return dataset.withColumn(self.output_column, F.col(self.input_column))
        w, b = self.drawn(first.n)
        scale = np.sqrt(2 / self.features)

        @F.pandas_udf("array<double>")
        def features(x: pd.Series) -> pd.Series:
            x = np.stack(x.to_numpy())
            return pd.Series(list(np.hstack([np.cos(x @ w.T + b) * scale, x])))

        return dataset.withColumn(self.output_column, array_to_vector(features(vector_to_array(F.col(self.input_column)))))
