"""MLlib models, out-of-fold predictions, tuning, importances and recursive
feature elimination (E1-E9, E12, E22, M12, M13, M17 but for k-NN, K4). The search over
families (E10, E11, K5) is in ``search``.

Fitting is distributed by MLlib; the driver only orchestrates the fold /
model / elimination loops (what ``CrossValidator`` itself does) and holds
bounded model parameters (coefficients, importances: one value per feature).
Predictions are always a long ``(row_id, model, fold, y_true, score)`` table
joined by key, never concatenated by position.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark import keyword_only
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasWeightCol
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.operators import metrics, preprocess
from trialframe.operators.joins import attach
from trialframe.operators.kernel_features import KernelRidge, KernelSVC
from trialframe.operators.preprocess import HoldOut, MajorityClass, given_defaults

FEATURES = "features"


def assemble(df: DataFrame, cols: Sequence[str], out: str = FEATURES) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def array_features(df: DataFrame, col: str, n: int, out: str = FEATURES) -> DataFrame:
    """Array column -> vector of its first ``n`` components (M15 output or an
    embedding); null components become NaN."""
    nan = F.lit(float("nan"))
    x = F.transform(F.slice(col, 1, n), lambda v: F.coalesce(v.cast("double"), nan))
    return df.withColumn(out, array_to_vector(x))


# ------------------------------------------------------------------ E12
# fixed values: the hidden layers of the four network shapes
NETWORKS = {"mlp": [100, 50], "mlp_deep": [200, 100, 50, 25], "mlp_wide": [300], "mlp_funnel": [256, 128, 64, 32, 16]}
# fixed values: the boosting parameter sets (rounds, rate, depth) that stop early
BOOSTED = {"boosted_leafwise": (1000, 0.05, 4), "boosted_symmetric": (1000, 0.1, 6)}


class EarlyStoppedGBT(Estimator, HasFeaturesCol, HasLabelCol, HasWeightCol, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees that stop when the error on a tenth of the training
    rows, held out by hash, improves by less than ``tol``."""

    maxIter = Param(Params._dummy(), "maxIter", "most rounds", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "learning rate", TypeConverters.toFloat)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a tree", TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "least improvement", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of the trees", TypeConverters.toInt)
    regression = Param(Params._dummy(), "regression", "a numeric target", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, labelCol="label", featuresCol=FEATURES, weightCol=None, maxIter=1000, stepSize=0.05, maxDepth=5, tol=0.001, seed=42, regression=False):
        super().__init__()
        given_defaults(self, self._input_kwargs)

    def setFeaturesCol(self, value: str) -> EarlyStoppedGBT:
        return self._set(featuresCol=value)

    def _fit(self, dataset: DataFrame):
        flagged = HoldOut(outputCol="_valid", source=self.getFeaturesCol()).transform(dataset)
        given = {p: self.getOrDefault(self.getParam(p)) for p in ("labelCol", "featuresCol", "maxIter", "stepSize", "maxDepth", "seed")}
        weight = {"weightCol": self.getWeightCol()} if self.isSet(self.weightCol) else {}
        kind = GBTRegressor if self.getOrDefault(self.regression) else GBTClassifier
        return kind(validationIndicatorCol="_valid", validationTol=self.getOrDefault(self.tol), **given, **weight).fit(flagged)


def classifiers(label: str = "label", seed: int = 42, n_features: int | None = None,
                weight: str | None = None) -> dict[str, Callable[[], object]]:
    """Registry of classifier factories by name (E1-E7). Parameter sets
    follow the reference's defaults where MLlib has the same knob."""
    w = {"weightCol": weight} if weight else {}
    reg: dict[str, Callable[[], object]] = {
        "dummy": lambda: MajorityClass(labelCol=label),
        "logistic": lambda: LogisticRegression(labelCol=label, maxIter=100, **w),
        "ridge": lambda: LogisticRegression(labelCol=label, maxIter=100, regParam=1.0, elasticNetParam=0.0, **w),
        "random_forest": lambda: RandomForestClassifier(labelCol=label, numTrees=100, maxDepth=10, seed=seed, **w),
        "decision_tree": lambda: DecisionTreeClassifier(labelCol=label, maxDepth=5, seed=seed, **w),
        "gradient_boosting": lambda: GBTClassifier(labelCol=label, maxIter=100, stepSize=0.1, maxDepth=5, seed=seed, **w),
        "naive_bayes": lambda: NaiveBayes(labelCol=label, modelType="gaussian", **w),
        "linear_svm": lambda: LinearSVC(labelCol=label, maxIter=100, **w),
        "svm_rbf": lambda: KernelSVC(labelCol=label, kernel="rbf", seed=seed, **w),
        "svm_poly": lambda: KernelSVC(labelCol=label, kernel="poly", degree=3, seed=seed, **w),
    }
    for name, (rounds, rate, depth) in BOOSTED.items():
        reg[name] = lambda rounds=rounds, rate=rate, depth=depth: EarlyStoppedGBT(
            labelCol=label, maxIter=rounds, stepSize=rate, maxDepth=depth, seed=seed, **w)
    if n_features:
        for name, hidden in NETWORKS.items():
            reg[name] = lambda hidden=hidden: MultilayerPerceptronClassifier(
                labelCol=label, layers=[n_features, *hidden, 2], maxIter=200, seed=seed)
    return reg


def regressors(label: str = "label", seed: int = 42) -> dict[str, Callable[[], object]]:
    """The same for a numeric target; a network has no regressor in MLlib."""
    reg: dict[str, Callable[[], object]] = {
        "ridge": lambda: LinearRegression(labelCol=label, regParam=1.0, elasticNetParam=0.0),
        "linear": lambda: LinearRegression(labelCol=label),
        "random_forest": lambda: RandomForestRegressor(labelCol=label, numTrees=100, maxDepth=10, seed=seed),
        "decision_tree": lambda: DecisionTreeRegressor(labelCol=label, maxDepth=5, seed=seed),
        "gradient_boosting": lambda: GBTRegressor(labelCol=label, maxIter=100, stepSize=0.1, maxDepth=5, seed=seed),
        "svm_rbf": lambda: KernelRidge(labelCol=label, kernel="rbf", seed=seed),
        "svm_poly": lambda: KernelRidge(labelCol=label, kernel="poly", degree=3, seed=seed),
    }
    for name, (rounds, rate, depth) in BOOSTED.items():
        reg[name] = lambda rounds=rounds, rate=rate, depth=depth: EarlyStoppedGBT(
            labelCol=label, maxIter=rounds, stepSize=rate, maxDepth=depth, seed=seed, regression=True)
    return reg


def positive_score(pred: DataFrame, model) -> DataFrame:
    """Probability of class 1 if the model has one, else the raw margin /
    predicted class (E8: proba column else class)."""
    if "probability" in pred.columns:
        return pred.withColumn("score", vector_to_array("probability")[1])
    if "rawPrediction" in pred.columns:
        return pred.withColumn("score", vector_to_array("rawPrediction")[1])
    return pred.withColumn("score", F.col("prediction").cast("double"))


# ------------------------------------------------------------------ E8/E9
def fold_numbers(df: DataFrame, fold: str) -> list[int]:
    return sorted(r[0] for r in df.select(fold).distinct().collect())  # k small ints


def out_of_fold(df: DataFrame, label: str, fold: str, models: dict[str, Callable[[], object]],
                row_id: str = "row_id", group: str | None = None, scale: bool = True) -> DataFrame:
    """Fit every model on all folds but one, score the held-out fold; one
    long table for all (model, fold). Medians and scales are those of the
    training rows of the fold, exact, and shared by its models. Every fold's
    pipeline is kept in the returned ``fitted`` attribute (T16: none is dropped)."""
    folds = fold_numbers(df, fold)
    stages = preprocess.fold_models(df, FEATURES, fold, folds) if scale else {}
    parts, fitted = [], {}
    keep = [row_id, fold, label] + ([group] if group else [])
    for k in folds:
        ready = stages[k].transform(df) if scale else df
        train, held = ready.where(F.col(fold) != k).persist(), ready.where(F.col(fold) == k)
        try:
            for name, make in models.items():
                est = make().setFeaturesCol(preprocess.SCALED if scale else FEATURES)
                m = est.fit(train)
                fitted[(name, k)] = PipelineModel([stages[k], m] if scale else [m])
                p = positive_score(m.transform(held), m)
                parts.append(p.select(*keep, F.lit(name).alias("model"), "score", F.col("prediction").cast("double").alias("predicted")))
        finally:
            train.unpersist()
    out = reduce(DataFrame.unionByName, parts).withColumnRenamed(label, "y_true")
    out.fitted = fitted  # type: ignore[attr-defined]
    return out


def side_by_side(predictions: DataFrame, names: Sequence[str], row_id: str = "row_id", value: str = "score") -> DataFrame:
    """One row per row id and a column for each model, joined by key."""
    own = [F.max(F.when(F.col("model") == m, F.col(value))).alias(m) for m in names]
    return predictions.groupBy(row_id).agg(*own)


def prediction_scores(pred: DataFrame, by: Sequence[str], regression: bool = False) -> DataFrame:
    """Scores of a long table of predictions per ``by``: accuracy, f1, mcc and
    tie-aware AUC, or r2, rmse and mae."""
    if regression:
        return metrics.regression_metrics(pred, by, "y_true", "predicted").select(*by, "r2", "rmse", "mae")
    conf = metrics.from_confusion(metrics.confusion(pred, by, pred="predicted")).select(*by, "accuracy", "f1", "mcc")
    return attach(conf, metrics.roc_auc(pred, list(by)), list(by), "left")


def split_scores(df: DataFrame, label: str, models: dict[str, Callable[[], object]], part: str = "split", fold: str = "fold",
                 row_id: str = "row_id", regression: bool = False) -> DataFrame:
    """(model, part, metric, value): each model fitted on the rows with
    ``part`` train and scored on train and test, and the mean and population
    deviation of its scores over the folds of the training rows."""
    train = df.where(F.col(part) == "train")
    stage = preprocess.ExactImputeScale(inputCol=FEATURES).fit(train)
    ready, known = stage.transform(df), stage.transform(train).persist()
    parts = []
    try:
        for name, make in models.items():
            m = make().setFeaturesCol(preprocess.SCALED).fit(known)
            p = positive_score(m.transform(ready), m)
            parts.append(p.select(part, F.col(label).alias("y_true"), F.lit(name).alias("model"), "score", F.col("prediction").alias("predicted")))
    finally:
        known.unpersist()
    split = prediction_scores(reduce(DataFrame.unionByName, parts), ["model", part], regression)
    names = [c for c in split.columns if c not in ("model", part)]
    held = prediction_scores(out_of_fold(train, label, fold, models, row_id), ["model", fold], regression).unpivot(["model"], names, "metric", "v")
    spread = held.groupBy("model", "metric").agg(F.avg("v").alias("cv_mean"), F.stddev_pop("v").alias("cv_std")).unpivot(["model", "metric"], ["cv_mean", "cv_std"], "part", "value")
    once = split.unpivot(["model", part], names, "metric", "value").withColumnRenamed(part, "part")
    return once.unionByName(spread)


# ------------------------------------------------------------------ E10/E11
def tune(df: DataFrame, label: str, fold: str, estimator, grid: dict, metric: str = "areaUnderROC",
         parallelism: int = 4):
    """Grid (or sampled grid) search with the given fold column; returns
    (best_model, rows of (params, mean metric))."""
    b = ParamGridBuilder()
    for param, values in grid.items():
        b = b.addGrid(getattr(estimator, param), list(values))
    maps = b.build()
    ev = BinaryClassificationEvaluator(labelCol=label, metricName=metric)
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=ev, foldCol=fold,
                        parallelism=parallelism)
    m = cv.fit(df)
    rows = [({p.name: v for p, v in pm.items()}, float(s)) for pm, s in zip(maps, m.avgMetrics)]
    return m, rows


# ------------------------------------------------------------------ E22/M13
def importances(model, names: Sequence[str]) -> list[tuple[str, float]]:
    """(feature, importance) from a tree model (bounded: one per feature)."""
    imp = model.featureImportances.toArray()
    return [(n, float(v)) for n, v in zip(names, imp)]


def cv_auc(df: DataFrame, label: str, fold: str, make, cols: Sequence[str]) -> float:
    """Mean held-out AUC over folds for a feature subset."""
    d = assemble(df, cols, "_fs")
    ev = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction")
    scores = []
    for k in sorted(r[0] for r in d.select(fold).distinct().collect()):
        m = make().setFeaturesCol("_fs").fit(d.where(F.col(fold) != k))
        scores.append(ev.evaluate(m.transform(d.where(F.col(fold) == k))))
    return sum(scores) / len(scores)


def _eliminate(train: DataFrame, cols: Sequence[str], make, step: float, min_features: int):
    """(features, model) from all of ``cols`` down to ``min_features``, each
    round without the ``step`` share (at least one) of least importance."""
    cur = list(cols)
    while True:
        m = make().setFeaturesCol("_fs").fit(assemble(train, cur, "_fs"))
        yield list(cur), m
        if len(cur) <= min_features:
            return
        ranked = sorted(importances(m, cur), key=lambda t: (t[1], t[0]))
        n_drop = min(max(1, int(len(cur) * step)), len(cur) - min_features)
        drop = {n for n, _ in ranked[:n_drop]}
        cur = [c for c in cur if c not in drop]


def rfecv(df: DataFrame, label: str, fold: str, cols: Sequence[str], make, step: float = 0.25,
          min_features: int = 5) -> list[tuple[int, float, list[str]]]:
    """Recursive elimination with CV. The elimination is run on each
    fold's training rows and scored on its held-out rows, which so have no say
    in the features; the mean AUC per number of features is the CV score.
    Returns (n_features, cv_auc, features) per round, the features those of an
    elimination on all rows; the caller keeps the best number."""
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())  # k small ints
    ev = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="score", metricName="areaUnderROC")
    scores: dict[int, list[float]] = {}
    for k in folds:
        held = df.where(F.col(fold) == k)
        for cur, m in _eliminate(df.where(F.col(fold) != k), cols, make, step, min_features):
            p = positive_score(m.transform(assemble(held, cur, "_fs")), m)
            scores.setdefault(len(cur), []).append(ev.evaluate(p.select(label, "score")))
    return [(len(cur), sum(scores[len(cur)]) / len(folds), cur) for cur, _ in _eliminate(df, cols, make, step, min_features)]


# ------------------------------------------------------------------ M12
def pca_scores(df: DataFrame, k: int, in_col: str = FEATURES, out: str = "pca"):
    """Impute and scale exactly, then k principal components; returns the
    transformed frame and the explained-variance share of each component."""
    m = preprocess.ImputeScalePCA(inputCol=in_col, outputCol=out, k=k).fit(df)
    return m.transform(df).drop(preprocess.SCALED), [float(v) for v in m.stages[-1].explainedVariance.toArray()]
