"""Preprocessing stages, kernel maps, out-of-fold tables, family search and
multi-channel convolution features against direct computation."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from trialframe.operators import kernel_features as kf
from trialframe.operators import models, preprocess, rocket, search, split


def frame(spark, n=240, d=5, seed=1, gaps=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * np.arange(1, d + 1) + 3
    y = ((x[:, 0] - 3) ** 2 + rng.normal(size=n) * 0.2 > 0.5).astype(float)
    if gaps:
        x[rng.random((n, d)) < 0.1] = np.nan
        x[:, d - 1] = np.nan  # a feature without any value
        x[:, d - 2] = 7.0  # one that does not vary
    rows = [(i, [None if np.isnan(v) else float(v) for v in x[i]], float(y[i]), float(np.nansum(x[i])), i % 3) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, x array<double>, y double, t double, fold int")
    return models.array_features(df, "x", d).drop("x"), x, y


def expected(x):
    med = np.array([0.0 if np.isnan(c).all() else np.nanmedian(c) for c in x.T])
    filled = np.where(np.isnan(x), med, x)
    sd = filled.std(0)
    return med, filled.mean(0), np.where(sd == 0, 1, sd)


def test_fold_parameters_equal_direct_ones(spark):
    df, x, _ = frame(spark)
    got = preprocess.fold_models(df, "features", "fold", [0, 1, 2])
    for k, m in got.items():
        med, mean, scale = expected(x[np.arange(len(x)) % 3 != k])
        for have, want in ((m.medians, med), (m.means, mean), (m.scales, scale)):
            assert np.allclose(m.getOrDefault(have), want, atol=1e-12)


def test_stage_scales_and_is_saved_and_loaded(spark, tmp_path):
    df, x, _ = frame(spark)
    fitted = Pipeline(stages=[preprocess.ExactImputeScale(inputCol="features", outputCol="s")]).fit(df)
    fitted.write().save(str(tmp_path / "m"))
    med, mean, scale = expected(x)
    want = (np.where(np.isnan(x), med, x) - mean) / scale
    for m in (fitted, PipelineModel.load(str(tmp_path / "m"))):
        got = m.transform(df).orderBy("row_id").select(vector_to_array("s")).collect()
        assert np.allclose(np.array([r[0] for r in got]), want, atol=1e-9)


def test_principal_components_of_imputed_features(spark):
    df, x, _ = frame(spark)
    p, shares = models.pca_scores(df, 2)
    med, mean, scale = expected(x)
    z = (np.where(np.isnan(x), med, x) - mean) / scale
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(shares, (s**2 / (s**2).sum())[:2])
    got = np.array([r[0] for r in p.orderBy("row_id").select(vector_to_array("pca")).collect()])
    assert np.allclose(np.abs(got), np.abs((u * s)[:, :2]), atol=1e-6)


def test_empty_and_tied_majority(spark):
    df, _, _ = frame(spark, n=4)
    assert models.MajorityClass(labelCol="y").fit(df.limit(0)).getOrDefault("value") == 0.0
    tied = spark.createDataFrame([(1.0,), (0.0,), (None,), (None,), (None,)], "y double")
    m = models.MajorityClass(labelCol="y").fit(tied)
    assert m.getOrDefault("value") == 0.0 and m.transform(tied).first()["prediction"] == 0.0


@pytest.mark.parametrize("features", [256, 4096])
def test_gaussian_map_within_its_error(features):
    x = np.random.default_rng(2).normal(size=(40, 6))
    z = kf.fourier(x, features, 0.3, 7)
    exact = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(2))
    error = z @ z.T - exact
    assert np.allclose(np.diag(error), 0)
    assert (np.abs(error) <= 5 * (1 - exact**2) / np.sqrt(features) + 1e-9).all()
    seeds = np.mean([kf.fourier(x, 64, 0.3, s) @ kf.fourier(x, 64, 0.3, s).T for s in range(300)], axis=0)
    assert np.abs(seeds - exact).max() < 5 / np.sqrt(64 * 300)


@pytest.mark.parametrize("degree,coef0", [(2, 0.0), (3, 0.0), (3, 1.0)])
def test_polynomial_map_within_its_error(degree, coef0):
    x = np.random.default_rng(3).normal(size=(30, 6))
    exact = (0.2 * x @ x.T + coef0) ** degree
    z = kf.tensor_sketch(x, 8192, 0.2, coef0, degree, 5)
    size = np.sqrt(np.outer(np.diag(exact), np.diag(exact)))
    assert (np.abs(z @ z.T - exact) <= 5 * np.sqrt((2 + 3**degree) / 8192) * size).all()
    mean = np.mean([kf.tensor_sketch(x, 256, 0.2, coef0, degree, s) @ kf.tensor_sketch(x, 256, 0.2, coef0, degree, s).T for s in range(200)], axis=0)
    assert (np.abs(mean - exact) <= 5 * np.sqrt((2 + 3**degree) / 256 / 200) * size).all()


def test_kernel_machine_learns_what_a_line_cannot(spark, tmp_path):
    df, x, y = frame(spark, gaps=False)
    for k in ("rbf", "poly"):
        m = models.KernelSVC(labelCol="y", featuresCol="features", kernel=k, gamma=0.0 if k == "rbf" else 1.0, coef0=0.0 if k == "rbf" else 1.0, degree=2, maxIter=30, C=10.0)
        scaled = preprocess.ExactImputeScale(inputCol="features", outputCol="s").fit(df).transform(df)
        fitted = m.setFeaturesCol("s").fit(scaled)
        fitted.write().overwrite().save(str(tmp_path / k))
        both = [models.positive_score(f.transform(scaled), f).orderBy("row_id").select("score", "prediction").toPandas() for f in (fitted, PipelineModel.load(str(tmp_path / k)))]
        assert np.allclose(both[0]["score"], both[1]["score"])
        assert (both[0]["prediction"] == y).mean() > 0.8
    gamma = kf.gamma_scale(df, "features")
    assert np.isclose(gamma, 1 / (x.shape[1] * x.var()))


def test_every_family_scores_every_row_once(spark):
    df, _, _ = frame(spark, n=90)
    reg = models.classifiers("y", n_features=5)
    some = {k: reg[k] for k in ("dummy", "naive_bayes", "mlp")}
    some["boosted"] = lambda: models.EarlyStoppedGBT(labelCol="y", maxIter=5, maxDepth=2, stepSize=0.3)
    out = models.out_of_fold(df, "y", "fold", some)
    got = out.toPandas()
    assert got.groupby("model")["row_id"].agg(["count", "nunique"]).to_numpy().tolist() == [[90, 90]] * len(some)
    assert np.isfinite(got["score"]).all() and set(got["predicted"]) <= {0.0, 1.0}
    assert len(out.fitted) == 3 * len(some)
    names = {"dummy", "logistic", "gradient_boosting", "random_forest", "svm_rbf", "svm_poly", "boosted_leafwise", "boosted_symmetric", "mlp_deep", "mlp_wide", "mlp_funnel"}
    assert names <= set(reg)


def test_early_stopping_stops(spark):
    df, _, _ = frame(spark, n=200, gaps=False)
    long = models.EarlyStoppedGBT(labelCol="y", maxIter=40, maxDepth=3, stepSize=0.5, tol=0.01).fit(df)
    assert long.getNumTrees < 40


def test_regressors_run_and_split_scores(spark):
    df, _, _ = frame(spark, n=120, gaps=False)
    df = df.withColumn("split", F.when(F.col("row_id") % 4 == 0, "test").otherwise("train"))
    reg = models.regressors("t")
    some = {k: reg[k] for k in ("linear", "svm_rbf")}
    got = models.split_scores(df, "t", some, regression=True).toPandas()
    assert set(got["model"]) == set(some) and set(got["part"]) == {"train", "test", "cv_mean", "cv_std"}
    r2 = got[(got.part == "train") & (got.metric == "r2")].set_index("model")["value"]
    assert r2["linear"] > 0.95 and np.isfinite(got["value"]).all()
    kinds = models.split_scores(df, "y", {"dummy": models.classifiers("y")["dummy"]}).toPandas()
    share = df.where("split = 'test'").agg(F.avg((F.col("y") == 1).cast("double"))).first()[0]
    acc = kinds[(kinds.part == "test") & (kinds.metric == "accuracy")]["value"].item()
    assert np.isclose(acc, max(share, 1 - share))


def test_draws_are_distinct_and_fixed():
    grids = {"a": {"p": [1, 2, 3], "q": [4, 5]}, "b": {"r": [0]}}
    every = search.draws(grids, None)
    assert len(every) == len({c.name for c in every}) == 7
    some = search.draws(grids, 3, seed=5)
    assert some == search.draws(grids, 3, seed=5) and set(some) <= set(every) and len(some) == 4
    assert some != search.draws(grids, 3, seed=6)


RANKS = """
WITH c AS (SELECT rung, candidate, sum(CASE WHEN predicted = 1 AND y_true = 1 THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN predicted = 1 AND y_true = 0 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN predicted = 0 AND y_true = 1 THEN 1 ELSE 0 END) AS fn
  FROM p GROUP BY ALL),
f AS (SELECT rung, candidate, CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1 FROM c),
a AS (SELECT x.rung, x.candidate, avg(CASE WHEN x.score > z.score THEN 1.0 WHEN x.score = z.score THEN 0.5 ELSE 0 END) AS auc
  FROM p x JOIN p z ON x.rung = z.rung AND x.candidate = z.candidate AND x.y_true = 1 AND z.y_true = 0 GROUP BY ALL)
SELECT rung, candidate, row_number() OVER (PARTITION BY rung ORDER BY {metric} DESC, candidate) AS rank
FROM f JOIN a USING (rung, candidate)"""


@pytest.mark.parametrize("metric", ["f1", "auc"])
def test_ranking_is_reproduced_from_the_predictions(spark, tmp_path, metric):
    df, _, _ = frame(spark)
    families = {
        "dummy": lambda: models.MajorityClass(labelCol="y"),
        "tree": lambda **p: models.DecisionTreeClassifier(labelCol="y", seed=1, **p),
        "bayes": lambda: models.NaiveBayes(labelCol="y", modelType="gaussian"),
    }
    first, found = search.automatic(df, "y", "fold", families, {"tree": {"maxDepth": [1, 2, 5]}}, metric, top_models=2, n_iter=2, rungs=2, eta=2)
    assert {r[0] for r in first.select("candidate").distinct().collect()} == set(families)
    found.predictions.write.parquet(os.path.join(tmp_path, "p"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW p AS SELECT * FROM read_parquet('{tmp_path}/p/*.parquet')")
    want = {(a, b): c for a, b, c in con.execute(RANKS.format(metric=metric)).fetchall()}
    got = {(r["rung"], r["candidate"]): r["rank"] for r in found.ranking.collect()}
    assert got == want
    last = [r["candidate"] for r in found.ranking.where("rung = 1 AND rank = 1").collect()]
    assert last == [found.best.name]
    kept = {r["candidate"] for r in found.ranking.where("rung = 0 AND kept").collect()}
    assert kept == {c for r, c in got if r == 1}
    n = found.predictions.groupBy("rung", "candidate").count().collect()
    assert {r["count"] for r in n if r["rung"] == 1} == {240} and all(r["count"] < 180 for r in n if r["rung"] == 0)


def test_search_of_regressors(spark):
    df, _, _ = frame(spark, n=90)
    families = {"ridge": lambda **p: models.LinearRegression(labelCol="t", **p), "tree": lambda: models.DecisionTreeRegressor(labelCol="t")}
    some = [search.Candidate("tree"), *search.draws({"ridge": {"regParam": [0.0, 100.0]}}, None)]
    found = search.successive_halving(df, "t", "fold", families, some, "r2", rungs=1, regression=True)
    assert found.best.name == 'ridge {"regParam": 0.0}'


# ------------------------------------------------------------------ M14 M15
def brute_features(x, p):
    """One recording (C, L) by plain loops."""
    kernels, out, j = rocket._kernels(), [], 0
    channels, length = x.shape
    for di, (dil, cnt) in enumerate(zip(p.dilations, p.counts)):
        for k, w in enumerate(kernels):
            on = [c for c in range(channels) if p.channels[di * len(kernels) + k, c]]
            half = 4 * int(dil)
            values = []
            for t in range(length):
                if (di + k) % 2 and not half <= t < length - half:
                    continue
                total = 0.0
                for c in on:
                    for i in range(9):
                        at = t + (i - 4) * int(dil)
                        if 0 <= at < length:
                            total += float(w[i]) * float(x[c, at])
                values.append(total)
            for b in p.biases[j : j + cnt]:
                out.append(np.mean([v > b for v in values]) if values else 0.0)
            j += cnt
    return np.array(out)


@pytest.mark.parametrize("channels", [1, 4])
def test_features_equal_a_plain_convolution(spark, channels):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(6, channels, 40)), 2).astype(np.float32)
    cols = [f"c{c}" for c in range(channels)]
    rows = [(i, *[[float(v) for v in x[i, c]] for c in range(channels)]) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} array<double>" for c in cols))
    p = rocket.fit(df, cols, "id", 40, n_features=84 * 5)
    assert p.n_features == 84 * 5 and p.channels.shape == (84 * len(p.dilations), channels) and (p.channels.sum(1) >= 1).all()
    got = rocket.transform(df, cols, p, ["id"]).orderBy("id").collect()
    for r in got:
        # float32 sums can differ in the last digit, which moves a position across a bias at most
        assert (np.abs(np.array(r["rocket"]) - brute_features(x[r["id"]], p)) <= 1.01 / 8).all()
        assert np.mean(np.abs(np.array(r["rocket"]) - brute_features(x[r["id"]], p)) > 1e-6) < 0.02


def test_channel_subsets_have_all_sizes():
    s = rocket.channel_subsets(2000, 6, 1)
    assert set(s.sum(1)) == {1, 2, 3, 4, 5, 6} and (s == rocket.channel_subsets(2000, 6, 1)).all()
    sizes = pd.Series(s.sum(1)).value_counts()
    assert sizes[1] > sizes[4] and (rocket.channel_subsets(50, 1, 1) == 1).all()


def test_stacked_series(spark):
    rows = [("a", 2, 5.0), ("a", 0, 1.0), ("a", 1, None), ("b", 0, 4.0), (None, 0, 9.0)]
    df = spark.createDataFrame(rows, "rec string, pos int, v double")
    got = {r["rec"]: r["series"] for r in rocket.stack_series(df, ["rec"], "pos", "v", 3).collect()}
    assert got == {"a": [1.0, None, 5.0], "b": [4.0, None, None], None: [9.0, None, None]}
    with pytest.raises(Exception, match="longer than 2"):
        rocket.stack_series(df, ["rec"], "pos", "v", 2).collect()
    x = rocket.stack_series(df, ["rec"], "pos", "v", 9)
    p = rocket.fit(x.where("rec is not null"), "series", "rec", 9, n_features=84)
    assert rocket.transform(x, "series", p, ["rec"]).count() == 3


def test_splits_used_by_the_models(spark):
    df = spark.range(100).withColumnRenamed("id", "row_id")
    assert split.kfold(df, "row_id", 3).groupBy("fold").count().count() == 3
