"""Summaries of embedding clouds as a pipeline stage."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topospark.operators import metrics
from topospark.plans import pipeline


class WitnessFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Clouds ``(cloud_id, point_id, coords, intensity)`` to ``(cloud_id, vector)``.

    The names of the features and their order are fixed by the first call and kept with the stage.
    """

    mode = Param(Params._dummy(), "mode", "fast or regular", TypeConverters.toString)
    method = Param(Params._dummy(), "method", "landmark method", TypeConverters.toString)
    dim = Param(Params._dummy(), "dim", "number of coordinates", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)
    keys = Param(Params._dummy(), "keys", "names of the features in order", TypeConverters.toListString)

    def __init__(self, mode: str = "fast", method: str = "random", dim: int = 3, seed: int = 42) -> None:
        super().__init__()
        self._setDefault(keys=[], mode="fast", method="random", dim=3, seed=42)
        self._set(mode=mode, method=method, dim=dim, seed=seed)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        summaries = pipeline.embedding_summaries(dataset, get(self.mode), get(self.method), get(self.dim), get(self.seed))
        if not get(self.keys):
            found = summaries.select(F.explode(F.map_keys("summary")).alias("key")).distinct().orderBy("key").collect()  # at most 24 names
            self._set(keys=[row.key for row in found])
        return metrics.to_vector(summaries, get(self.keys))
