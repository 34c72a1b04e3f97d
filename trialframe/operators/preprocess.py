"""Exact preprocessing as pipeline stages.

``ExactImputeScale`` fits, per feature, the interpolated median of the present
values and then mean and population deviation of the imputed ones; its model
fills and scales. The parameters of all folds come from one aggregate over
(fold, feature), so a cross-validation reads the rows once for them. Models
are saved and loaded like any other pipeline stage.

NaN marks a missing component. A feature without any value in training is
filled with 0 and left unscaled, as is one that does not vary.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCol, HasLabelCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.operators.prep import fit_impute_scale

SCALED = "_scaled"


def given_defaults(stage: Params, given: dict) -> None:
    """Sets a stage's parameters: the defaults of its constructor, then what it was called with."""
    wanted = inspect.signature(type(stage).__init__).parameters
    stage._setDefault(**{k: v.default for k, v in wanted.items() if k != "self" and v.default is not None})
    stage._set(**{k: v for k, v in given.items() if v is not None})


def components(col: str) -> Column:
    """The components of a vector, NaN as null."""
    return F.transform(vector_to_array(col), lambda x: F.when(~F.isnan(x), x))


def literal_array(values: Sequence[float]) -> Column:
    """A constant array; one literal whatever its length."""
    return F.from_json(F.lit(json.dumps([float(v) for v in values])), "array<double>")


def fold_parameters(df: DataFrame, features: str, fold: str | None = None, folds: Sequence[int] = ()) -> DataFrame:
    """(fold, feature, median, mean, scale): for each of ``folds`` fitted on
    the rows of all others. Without a fold column, one fold 0 fitted on all."""
    used = F.array(F.lit(0)) if fold is None else F.filter(F.array(*[F.lit(k) for k in folds]), lambda k: k != F.col(fold))
    rows = df.select(F.explode(used).alias("fold"), components(features).alias("_x"))
    long = rows.select("fold", F.posexplode("_x").alias("feature", "value"))
    p = fit_impute_scale(long, F.lit(True), ["fold", "feature"])
    return p.select("fold", "feature", *[F.coalesce(c, F.lit(d)).alias(c) for c, d in (("median", 0.0), ("mean", 0.0), ("scale", 1.0))])


class ExactImputeScaleModel(Model, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    medians = Param(Params._dummy(), "medians", "median of each feature", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "mean of each imputed feature", TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "population deviation of each imputed feature", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, medians=None, means=None, scales=None):
        super().__init__()
        given_defaults(self, self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        median, mean, scale = (literal_array(self.getOrDefault(p)) for p in (self.medians, self.means, self.scales))
        x = F.transform(components(self.getInputCol()), lambda v, i: (F.coalesce(v, F.get(median, i)) - F.get(mean, i)) / F.get(scale, i))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(x))


class ExactImputeScale(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """M10 M11 as a pipeline stage."""

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol=SCALED):
        super().__init__()
        given_defaults(self, self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ExactImputeScaleModel:
        return _models(fold_parameters(dataset, self.getInputCol()), self.getInputCol(), self.getOutputCol())[0]


def _models(parameters: DataFrame, input_col: str, output_col: str) -> dict[int, ExactImputeScaleModel]:
    rows = parameters.orderBy("fold", "feature").collect()  # one for each fold and feature
    out = {}
    for k in sorted({r["fold"] for r in rows}):
        mine = [r for r in rows if r["fold"] == k]
        out[k] = ExactImputeScaleModel(
            inputCol=input_col, outputCol=output_col, medians=[r["median"] for r in mine], means=[r["mean"] for r in mine],
            scales=[r["scale"] for r in mine],
        )
    return out


def fold_models(df: DataFrame, features: str, fold: str, folds: Sequence[int], output_col: str = SCALED) -> dict[int, ExactImputeScaleModel]:
    """The stage of each fold, fitted on the rows of the others, all from one pass."""
    return _models(fold_parameters(df, features, fold, folds), features, output_col)


class ImputeScalePCA(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Exact imputation and scaling, then k principal components. The
    scaled features have mean 0, so MLlib's PCA is centred."""

    k = Param(Params._dummy(), "k", "number of components", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="pca", k=10):
        super().__init__()
        given_defaults(self, self._input_kwargs)

    def _fit(self, dataset: DataFrame):
        from pyspark.ml import PipelineModel

        scaler = ExactImputeScale(inputCol=self.getInputCol(), outputCol=SCALED).fit(dataset)
        pca = PCA(k=self.getOrDefault(self.k), inputCol=SCALED, outputCol=self.getOutputCol()).fit(scaler.transform(dataset))
        return PipelineModel([scaler, pca])


# ------------------------------------------------------------------ E7
class MajorityClassModel(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    value = Param(Params._dummy(), "value", "the predicted label", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, value=0.0):
        super().__init__()
        given_defaults(self, self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn("prediction", F.lit(self.getOrDefault(self.value)))


class MajorityClass(Estimator, HasFeaturesCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """The most frequent label of the training rows, the smallest on ties."""

    @keyword_only
    def __init__(self, *, labelCol="label"):
        super().__init__()
        given_defaults(self, self._input_kwargs)

    def setFeaturesCol(self, value: str) -> MajorityClass:
        return self._set(featuresCol=value)

    def _fit(self, dataset: DataFrame) -> MajorityClassModel:
        y = F.col(self.getLabelCol()).cast("double")
        best = dataset.where(y.isNotNull()).groupBy(y.alias("y")).count().orderBy(F.desc("count"), "y").first()
        return MajorityClassModel(value=best["y"] if best else 0.0)


class HoldOut(Transformer, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """A validation flag for early stopping: about one in ``every`` rows, by a
    hash of the features, the same wherever the row is."""

    every = Param(Params._dummy(), "every", "one in so many rows", TypeConverters.toInt)
    source = Param(Params._dummy(), "source", "the vector that is hashed", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, outputCol="_valid", every=10, source="features"):
        super().__init__()
        given_defaults(self, self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        h = F.xxhash64(vector_to_array(self.getOrDefault(self.source)))
        return dataset.withColumn(self.getOutputCol(), F.pmod(h, F.lit(self.getOrDefault(self.every))) == 0)
