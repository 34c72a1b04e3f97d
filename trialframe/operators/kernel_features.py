"""Kernel support vector machines on explicit feature maps (E5).

A map z with z(x) . z(y) ~ k(x, y) turns a kernel machine into a linear one
that MLlib fits in a distributed way. The random matrices come from a counter
hash of a seed, so a saved stage holds the seed and not the matrix, and every
task builds the same one. A batch is one matrix product per task.

* ``rbf``, exp(-gamma |x - y|^2): ``features`` / 2 random frequencies, a cosine
  and a sine each (Rahimi & Recht 2007). The product is unbiased, with standard
  deviation at most (1 - k^2) / sqrt(features).
* ``poly``, (gamma x . y + coef0)^degree: tensor sketch (Pham & Pagh 2013), the
  circular convolution of ``degree`` count sketches, computed by FFT. Unbiased,
  with variance at most (2 + 3^degree) / features of the squared product of
  k(x, x) and k(y, y).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCol, HasLabelCol, HasOutputCol, HasWeightCol
from pyspark.ml.regression import LinearRegression
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.operators.preprocess import given_defaults

FEATURES = 1024
MAPPED = "_kernel"


def _draws(seed: int, stream: int, n: int) -> np.ndarray:
    """n 64-bit draws of a counter-based generator."""
    return np.random.Philox(key=[seed & (2**64 - 1), stream]).random_raw(n)


def _uniform(seed: int, stream: int, n: int) -> np.ndarray:
    """In (0, 1]."""
    return ((_draws(seed, stream, n) >> np.uint64(11)) + np.uint64(1)).astype(np.float64) / float(1 << 53)


def normals(seed: int, n: int) -> np.ndarray:
    """n standard normal numbers (Box-Muller)."""
    return np.sqrt(-2 * np.log(_uniform(seed, 1, n))) * np.cos(2 * np.pi * _uniform(seed, 2, n))


def fourier(x: np.ndarray, features: int, gamma: float, seed: int) -> np.ndarray:
    """(row, feature) map of the Gaussian kernel."""
    half = features // 2
    w = normals(seed, half * x.shape[1]).reshape(x.shape[1], half) * np.sqrt(2 * gamma)
    angle = x @ w
    return np.concatenate([np.cos(angle), np.sin(angle)], axis=1) / np.sqrt(half)


def tensor_sketch(x: np.ndarray, features: int, gamma: float, coef0: float, degree: int, seed: int) -> np.ndarray:
    """(row, feature) map of the polynomial kernel."""
    x = np.sqrt(gamma) * x
    if coef0:
        x = np.concatenate([x, np.full((len(x), 1), np.sqrt(coef0))], axis=1)
    product = np.ones((len(x), features // 2 + 1), dtype=complex)
    for k in range(degree):
        bucket = (_draws(seed, 3 + 2 * k, x.shape[1]) % np.uint64(features)).astype(np.int64)
        sign = np.where(_draws(seed, 4 + 2 * k, x.shape[1]) >> np.uint64(63), 1.0, -1.0)
        sketch = np.zeros((len(x), features))
        np.add.at(sketch.T, bucket, (x * sign).T)
        product *= np.fft.rfft(sketch, axis=1)
    z = np.fft.irfft(product, n=features, axis=1)
    z = np.where(np.abs(z) > 1e-9 * np.sqrt((z * z).sum(1, keepdims=True)), z, 0.0)
    # a component that is empty or constant but for its rounding would be blown up to unit variance by a fit
    return z.astype(np.float32).astype(np.float64)


class KernelFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """The feature map as a pipeline stage."""

    kernel = Param(Params._dummy(), "kernel", "rbf or poly", TypeConverters.toString)
    gamma = Param(Params._dummy(), "gamma", "scale of the products", TypeConverters.toFloat)
    coef0 = Param(Params._dummy(), "coef0", "constant of the polynomial", TypeConverters.toFloat)
    degree = Param(Params._dummy(), "degree", "degree of the polynomial", TypeConverters.toInt)
    features = Param(Params._dummy(), "features", "length of the map, even", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the map", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol=MAPPED, kernel="rbf", gamma=1.0, coef0=0.0, degree=3, features=FEATURES, seed=42):
        super().__init__()
        given_defaults(self, self._input_kwargs)

    def mapped(self, x: np.ndarray) -> np.ndarray:
        p = {q.name: self.getOrDefault(q) for q in (self.kernel, self.gamma, self.coef0, self.degree, self.features, self.seed)}
        if p["kernel"] == "rbf":
            return fourier(x, p["features"], p["gamma"], p["seed"])
        if p["kernel"] == "poly":
            return tensor_sketch(x, p["features"], p["gamma"], p["coef0"], p["degree"], p["seed"])
        raise ValueError(f"unknown kernel {p['kernel']!r}")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        stage = self.copy()
        n = self.getOrDefault(self.features)

        def run(vectors: pa.Array) -> pa.Array:
            if not len(vectors):
                return pa.array([], pa.list_(pa.float64()))
            z = stage.mapped(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1))
            return pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * n), pa.array(z.ravel()))

        z = F.arrow_udf(run, "array<double>")(vector_to_array(self.getInputCol()))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(z))


def gamma_scale(df: DataFrame, features: str) -> float:
    """1 / (number of features * population variance of all components)."""
    x = vector_to_array(features)
    total = lambda f: F.sum(F.aggregate(x, F.lit(0.0), lambda a, v: a + f(v)))
    r = df.agg(total(lambda v: v).alias("s"), total(lambda v: v * v).alias("q"), F.sum(F.size(x)).alias("n"), F.max(F.size(x)).alias("d")).first()
    if not r["n"]:
        return 1.0
    var = r["q"] / r["n"] - (r["s"] / r["n"]) ** 2
    return 1.0 / (r["d"] * var) if var > 0 else 1.0


class _KernelMachine(Estimator, HasFeaturesCol, HasLabelCol, HasWeightCol, DefaultParamsReadable, DefaultParamsWritable):
    C = Param(Params._dummy(), "C", "inverse of the penalty", TypeConverters.toFloat)
    kernel, gamma, coef0 = KernelFeatures.kernel, KernelFeatures.gamma, KernelFeatures.coef0
    degree, features, seed = KernelFeatures.degree, KernelFeatures.features, KernelFeatures.seed
    maxIter = Param(Params._dummy(), "maxIter", "iterations of the linear fit", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self, *, featuresCol="features", labelCol="label", weightCol=None, C=1.0, kernel="rbf", gamma=0.0, coef0=0.0, degree=3,
        features=FEATURES, seed=42, maxIter=100,
    ):
        """gamma 0 stands for 1 / (number of features * their variance)."""
        super().__init__()
        given_defaults(self, self._input_kwargs)

    def setFeaturesCol(self, value: str):
        return self._set(featuresCol=value)

    def _linear(self, penalty: float):
        raise NotImplementedError

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        names = ("kernel", "coef0", "degree", "features", "seed")
        chosen = {k: self.getOrDefault(self.getParam(k)) for k in names}
        gamma = self.getOrDefault(self.gamma) or gamma_scale(dataset, self.getFeaturesCol())
        stage = KernelFeatures(inputCol=self.getFeaturesCol(), outputCol=MAPPED, gamma=gamma, **chosen)
        penalty = 1 / (self.getOrDefault(self.C) * max(1, dataset.count()))
        return PipelineModel([stage, self._linear(penalty).fit(stage.transform(dataset))])


class KernelSVC(_KernelMachine):
    """Support vector classifier: C * sum of hinge losses + |w|^2 / 2."""

    def _linear(self, penalty: float) -> LinearSVC:
        weight = {"weightCol": self.getWeightCol()} if self.isSet(self.weightCol) else {}
        return LinearSVC(
            featuresCol=MAPPED, labelCol=self.getLabelCol(), regParam=penalty, standardization=False,
            maxIter=self.getOrDefault(self.maxIter), **weight,
        )


class KernelRidge(_KernelMachine):
    """Regression in the kernel's space with squared loss: MLlib has no
    epsilon-insensitive one, so this stands in for support vector regression."""

    def _linear(self, penalty: float) -> LinearRegression:
        return LinearRegression(
            featuresCol=MAPPED, labelCol=self.getLabelCol(), regParam=penalty, elasticNetParam=0.0,
            standardization=False, maxIter=self.getOrDefault(self.maxIter), solver="l-bfgs",
        )
