"""The selector and the nearest-neighbour classifier as Estimators and Models of Spark ML, for Pipeline and CrossValidator.

Features are a column of vectors or of arrays. The neighbour model is its training table; saved, it is a folder with the
parameters and that table."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasOutputCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modeloom.operators import neighbors, selection
from modeloom.sources.shared import written


def as_array(frame: DataFrame, column: str) -> Column:
    return F.col(column).cast("array<double>") if isinstance(frame.schema[column].dataType, T.ArrayType) else vector_to_array(column)


class _SelectorParams(HasFeaturesCol, HasLabelCol, HasOutputCol):
    count = Param(Params._dummy(), "count", "how many features stay", TypeConverters.toInt)
    method = Param(Params._dummy(), "method", "F (variance and correlation) or MI (neighbours' information)", TypeConverters.toString)

    def getCount(self) -> int:
        return self.getOrDefault(self.count)

    def getMethod(self) -> str:
        return self.getOrDefault(self.method)


class RelevanceSelector(Estimator, _SelectorParams, DefaultParamsReadable, DefaultParamsWritable):
    """Ranks features by relevance less redundancy and keeps the first `count`."""

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", labelCol: str = "label", outputCol: str = "selected", count: int = 10, method: str = "F"):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", outputCol="selected", count=10, method="F")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> RelevanceSelectorModel:
        rows = dataset.select(F.monotonically_increasing_id().alias("row_id"), F.col(self.getLabelCol()).cast("int").alias("label"), as_array(dataset, self.getFeaturesCol()).alias("f"))
        first = rows.select(F.size("f")).first()
        every = list(range(first[0])) if first else []
        chosen = every if self.getCount() >= len(every) else selection.rank(written(rows), self.getMethod(), self.getCount())
        return self._copyValues(RelevanceSelectorModel(chosen=[int(i) for i in chosen]))


class RelevanceSelectorModel(Model, _SelectorParams, DefaultParamsReadable, DefaultParamsWritable):
    chosen = Param(Params._dummy(), "chosen", "feature numbers in order of choice", TypeConverters.toListInt)

    def __init__(self, chosen: list[int] | None = None):
        super().__init__()
        if chosen is not None:
            self._set(chosen=chosen)

    def getChosen(self) -> list[int]:
        return self.getOrDefault(self.chosen)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        own = as_array(dataset, self.getFeaturesCol())
        return dataset.withColumn(self.getOutputCol(), array_to_vector(F.transform(F.array(*map(F.lit, self.getChosen())), lambda i: F.get(own, i))))


class _NeighbourParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    k = Param(Params._dummy(), "k", "how many neighbours vote", TypeConverters.toInt)
    metric = Param(Params._dummy(), "metric", "of distances", TypeConverters.toString)
    weights = Param(Params._dummy(), "weights", "uniform, distance or squared_inverse", TypeConverters.toString)

    def getK(self) -> int:
        return self.getOrDefault(self.k)

    def getMetric(self) -> str:
        return self.getOrDefault(self.metric)

    def getWeights(self) -> str:
        return self.getOrDefault(self.weights)


class NeighbourClassifier(Estimator, _NeighbourParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, featuresCol: str = "features", labelCol: str = "label", predictionCol: str = "prediction", k: int = 2, metric: str = "euclidean", weights: str = "uniform"):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", k=2, metric="euclidean", weights="uniform")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> NeighbourClassifierModel:
        rows = dataset.select(F.monotonically_increasing_id().alias("row_id"), F.col(self.getLabelCol()).cast("int").alias("label"), as_array(dataset, self.getFeaturesCol()).alias("f"))
        return self._copyValues(NeighbourClassifierModel(written(rows)))


class NeighbourClassifierModel(Model, _NeighbourParams, MLReadable, MLWritable):
    def __init__(self, rows: DataFrame | None = None):
        super().__init__()
        self.rows = rows

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Rows keep their columns; one that meets no training row has a null prediction."""
        asked = written(dataset.withColumn("__id", F.monotonically_increasing_id()))
        tests = asked.select(F.col("__id").alias("row_id"), F.lit(None).cast("int").alias("label"), F.lit(0).alias("fold"), as_array(asked, self.getFeaturesCol()).alias("f"))
        both = tests.unionByName(self.rows.select("row_id", "label", F.lit(1).alias("fold"), "f")).withColumn("task", F.lit(0))
        voted = neighbors.vote(neighbors.neighbours(both, self.getK(), self.getMetric(), by="task"), self.getWeights())
        told = voted.select(F.col("test_id").alias("__id"), F.col("predicted").cast("double").alias(self.getPredictionCol()))
        return asked.join(told, "__id", "left").drop("__id")

    def copy(self, extra=None) -> NeighbourClassifierModel:
        that = super().copy(extra)
        that.rows = self.rows
        return that

    def write(self) -> MLWriter:
        return _NeighbourWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _NeighbourReader(cls)


class _NeighbourWriter(MLWriter):
    def __init__(self, model: NeighbourClassifierModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.rows.write.parquet(f"{path}/rows")


class _NeighbourReader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> NeighbourClassifierModel:
        said = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.kind(self.sparkSession.read.parquet(f"{path}/rows"))
        model._resetUid(said["uid"])
        DefaultParamsReader.getAndSetParams(model, said)
        return model
