"""Model queries over the equal-length series stand-in (embeddings: a
64-step series per recording, binary target = label % 2). Iterative and
randomised fits have no SQL oracle; folds, preprocessing and the models with a
closed form have, and so has the configuration grid (J16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialframe.operators import metrics, models, preprocess, rocket, search, split
from trialframe.plans.q_folds import h_sql
from trialframe.plans.registry import register
from trialframe.session import cut_lineage
from trialframe.sources.tables import table

SEED = 42
N = 64
K = 3


def series_rows(spark, sf):
    e = table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    return e.select("vec_id", F.col("embedding").alias("series"),
                    (F.col("label") % 2).cast("double").alias("y"))


def model_frame(spark, sf):
    """Vector features + stratified fold per recording."""
    d = models.array_features(series_rows(spark, sf), "series", N).select("vec_id", "y", models.FEATURES)
    d = split.stratified_kfold(d, "vec_id", "y", K, SEED)
    return cut_lineage(d.withColumnRenamed("vec_id", "row_id"))


CHANNELS = ["series", "steps", "total"]


def channel_rows(spark, sf):
    """Three channels of each recording: the values, their differences and
    their running sum."""
    s = series_rows(spark, sf).withColumn("series", F.transform("series", lambda x: x.cast("double")))
    steps = F.transform("series", lambda x, i: x - F.when(i == 0, x).otherwise(F.get("series", i - 1)))
    total = F.transform("series", lambda x, i: F.aggregate(F.slice("series", 1, i + 1), F.lit(0.0), lambda a, v: a + v))
    return s.withColumns({"steps": steps, "total": total})


@register("ts_random_conv_features")
def q_rocket(spark, sf):
    """About 10,000 random-convolution (MiniROCKET-style) PPV features
    of each recording over subsets of its channels; biases fit on 90 % of the
    recordings, by hash."""
    s = channel_rows(spark, sf)
    known = s.where(split.hash32("vec_id", SEED) % 10 != 0)
    params = rocket.fit(known, CHANNELS, "vec_id", N, n_features=9996, seed=SEED)
    r = rocket.transform(s, CHANNELS, params, ["vec_id", "y"])
    return r.select("vec_id", "y", F.size("rocket").alias("n_features"), "rocket")


@register("pca_scores")
def q_pca(spark, sf):
    """Imputed, standardised features (ddof 0) -> 5 principal components
    (signs are arbitrary) and the explained-variance share they cover."""
    p, ev = models.pca_scores(gappy_frame(spark, sf), 5)
    arr = models.vector_to_array("pca")
    return p.select(F.col("row_id").alias("vec_id"), *[F.round(arr[i], 6).alias(f"pc{i + 1}") for i in range(5)],
                    F.lit(round(sum(ev), 6)).alias("explained"))


# every 13th component is missing, so that imputation has something to do
GAP = 13


def gappy_frame(spark, sf):
    """The recordings with gaps, as vectors with a stratified fold."""
    e = series_rows(spark, sf)
    x = F.transform("series", lambda v, i: F.when((F.col("vec_id") + i + 1) % GAP != 0, v.cast("double")))
    d = models.array_features(e.withColumn("series", x), "series", N).select("vec_id", "y", models.FEATURES)
    d = split.stratified_kfold(d, "vec_id", "y", K, SEED)
    return cut_lineage(d.withColumnRenamed("vec_id", "row_id"))


_GAPPY_SQL = f"""
e AS (SELECT vec_id, CAST(label % 2 AS DOUBLE) AS y, embedding,
        CAST((row_number() OVER (PARTITION BY label % 2 ORDER BY {h_sql('vec_id')}, vec_id) - 1) % {K} AS INTEGER) AS fold FROM embeddings),
l AS (SELECT vec_id, y, e.fold, CAST(i - 1 AS INTEGER) AS feature, CASE WHEN (vec_id + i) % {GAP} <> 0 THEN CAST(embedding[i] AS DOUBLE) END AS x
      FROM e, unnest(range(1, {N} + 1)) AS r(i)),
used AS (SELECT CAST(k AS INTEGER) AS fold, l.feature, l.x, l.y FROM l, unnest(range(0, {K})) AS r(k) WHERE l.fold <> k),
med AS (SELECT fold, feature, quantile_cont(x, 0.5) AS median FROM used GROUP BY ALL),
st AS (SELECT fold, feature, any_value(median) AS median, avg(coalesce(x, median)) AS mean, stddev_pop(coalesce(x, median)) AS sd
       FROM used JOIN med USING (fold, feature) GROUP BY ALL)"""


@register("fold_preprocessing", f"""
WITH {_GAPPY_SQL}
SELECT fold, feature, round(median, 9) AS median, round(mean, 9) AS mean, round(CASE WHEN sd = 0 THEN 1 ELSE sd END, 9) AS scale FROM st""")
def q_fold_preprocessing(spark, sf):
    """The exact imputation and scaling parameters of every fold,
    fitted on the rows of the other folds in one pass."""
    d = gappy_frame(spark, sf)
    p = preprocess.fold_parameters(d, models.FEATURES, "fold", range(K))
    return p.select("fold", "feature", *[F.round(c, 9).alias(c) for c in ("median", "mean", "scale")])


@register("closed_form_oof", f"""
WITH {_GAPPY_SQL},
n AS (SELECT k AS fold, y, count(*) AS n FROM e, unnest(range(0, {K})) AS r(k) WHERE e.fold <> k GROUP BY ALL),
major AS (SELECT fold, arg_min(y, -n + y / 10) AS y FROM n GROUP BY fold),
g AS (SELECT u.fold, u.feature, u.y, avg((coalesce(x, median) - mean) / sd) AS mu, var_pop((coalesce(x, median) - mean) / sd) AS v
      FROM used u JOIN st USING (fold, feature) GROUP BY ALL),
ll AS (SELECT l.vec_id, g.y AS c, sum(-0.5 * ln(2 * pi() * v) - pow((coalesce(l.x, median) - mean) / sd - mu, 2) / (2 * v)) AS s
       FROM l JOIN st USING (fold, feature) JOIN g USING (fold, feature) GROUP BY ALL),
joint AS (SELECT vec_id, c, s + ln(n) AS s FROM ll JOIN e USING (vec_id) JOIN n ON n.fold = e.fold AND n.y = c),
p AS (SELECT vec_id, 1 / (1 + exp(sum(CASE WHEN c = 0 THEN s ELSE -s END))) AS score FROM joint GROUP BY vec_id)
SELECT vec_id AS row_id, 'naive_bayes' AS model, fold, y AS y_true, round(score, 4) AS score, CAST(score > 0.5 AS DOUBLE) AS predicted FROM e JOIN p USING (vec_id)
UNION ALL SELECT vec_id, 'dummy', fold, e.y, major.y, major.y FROM e JOIN major USING (fold)""")
def q_closed_form(spark, sf):
    """Out-of-fold scores of the two models that have a closed
    form, Gaussian naive Bayes and the majority class, on imputed and scaled folds."""
    d = gappy_frame(spark, sf)
    reg = models.classifiers("y", SEED)
    o = models.out_of_fold(d, "y", "fold", {m: reg[m] for m in ("naive_bayes", "dummy")})
    return o.select("row_id", "model", "fold", "y_true", F.round("score", 4).alias("score"), "predicted")


@register("kernel_svm_oof", f"""
WITH {_GAPPY_SQL}, m AS (SELECT unnest(['svm_rbf', 'svm_poly']) AS model)
SELECT vec_id AS row_id, model, fold, y AS y_true, true AS scored FROM e, m""")
def q_kernel_svm(spark, sf):
    """E5: every row is scored once, out of its fold, by a Gaussian and a cubic
    support vector machine (the margins are those of a randomised map; only
    that they are there is compared)."""
    d = gappy_frame(spark, sf)
    made = {k: (lambda k=k: models.KernelSVC(labelCol="y", kernel=k.removeprefix("svm_"), features=256, maxIter=20, seed=SEED)) for k in ("svm_rbf", "svm_poly")}
    o = models.out_of_fold(d, "y", "fold", made)
    # the sign of a margin is its class
    scored = (F.abs("score") < float("inf")) & ((F.col("score") > 0) == (F.col("predicted") == 1))
    return o.select("row_id", "model", "fold", "y_true", scored.alias("scored"))


def _split_frame(spark, sf):
    """The sum of a recording as the target, its first component as the feature."""
    e = table(spark, sf, "embeddings", "vec_id", "embedding")
    x = F.transform("embedding", lambda v: v.cast("double"))
    d = e.select("vec_id", F.aggregate(x, F.lit(0.0), lambda a, v: a + v).alias("y"), F.slice(x, 1, 1).alias("x"))
    d = models.array_features(d, "x", 1).select("vec_id", "y", models.FEATURES)
    d = d.withColumn("split", F.when(split.hash32("vec_id", SEED) % 5 == 0, "test").otherwise("train"))
    d = d.withColumn("fold", (split.hash32("vec_id", SEED + 1) % 5).cast("int"))
    return cut_lineage(d.withColumnRenamed("vec_id", "row_id"))


_REGR = "regr_slope(y, x) AS slope, regr_intercept(y, x) AS b0"
_SCORES = "1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)) AS r2, sqrt(avg(pow(y - p, 2))) AS rmse, avg(abs(y - p)) AS mae"


@register("split_scores", f"""
WITH d AS (SELECT vec_id, list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))) AS y, CAST(embedding[1] AS DOUBLE) AS x,
  CASE WHEN {h_sql('vec_id')} % 5 = 0 THEN 'test' ELSE 'train' END AS split, {h_sql('vec_id', SEED + 1)} % 5 AS fold FROM embeddings),
f AS (SELECT {_REGR} FROM d WHERE split = 'train'),
once AS (SELECT split AS part, {_SCORES} FROM (SELECT d.*, b0 + slope * x AS p FROM d, f) GROUP BY split),
ff AS (SELECT k AS fold, {_REGR} FROM d, unnest(range(0, 5)) AS r(k) WHERE split = 'train' AND fold <> k GROUP BY k),
held AS (SELECT fold, {_SCORES} FROM (SELECT d.*, b0 + slope * x AS p FROM d JOIN ff USING (fold) WHERE split = 'train') GROUP BY fold),
h AS (UNPIVOT held ON r2, rmse, mae INTO NAME metric VALUE v)
SELECT 'linear' AS model, part, metric, round(value, 6) AS value FROM (
  SELECT part, metric, value FROM (UNPIVOT once ON r2, rmse, mae INTO NAME metric VALUE value)
  UNION ALL SELECT 'cv_mean', metric, avg(v) FROM h GROUP BY metric
  UNION ALL SELECT 'cv_std', metric, stddev_pop(v) FROM h GROUP BY metric)""")
def q_split_scores(spark, sf):
    """One split, scores of train and test, and mean and deviation
    of the cross-validated scores, for a linear regression."""
    d = _split_frame(spark, sf)
    s = models.split_scores(d, "y", {"linear": models.regressors("y")["linear"]}, regression=True)
    return s.select("model", "part", "metric", F.round("value", 6).alias("value"))


GRIDS = {
    "logistic": {"regParam": [0.0, 0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5]},
    "random_forest": {"numTrees": [10, 20], "maxDepth": [3, 6]},
    "naive_bayes": {"smoothing": [0.5, 1.0]},
}
FAMILIES = {
    "dummy": lambda: models.MajorityClass(labelCol="y"),
    "logistic": lambda **p: models.LogisticRegression(labelCol="y", maxIter=30, **p),
    "random_forest": lambda **p: models.RandomForestClassifier(labelCol="y", seed=SEED, **p),
    "naive_bayes": lambda **p: models.NaiveBayes(labelCol="y", modelType="gaussian", **p),
}


@register("family_search")
def q_family_search(spark, sf):
    """The two best families of four, tuned by random draws and
    successive halving, ranked by AUC in each rung."""
    d = model_frame(spark, sf)
    _, found = search.automatic(d, "y", "fold", FAMILIES, GRIDS, "auc", top_models=2, n_iter=3, rungs=2, eta=2)
    return found.ranking.select("rung", "candidate", *[F.round(c, 6).alias(c) for c in ("accuracy", "f1", "mcc", "auc")], "rank", "kept")


def _oof(spark, sf):
    d = model_frame(spark, sf)
    reg = models.classifiers("y", SEED)
    chosen = {"logistic": reg["logistic"], "naive_bayes": reg["naive_bayes"],
              "random_forest": lambda: models.RandomForestClassifier(labelCol="y", numTrees=50, maxDepth=8, seed=SEED)}
    return models.out_of_fold(d, "y", "fold", chosen, row_id="row_id", scale=True)


@register("oof_predictions")
def q_oof(spark, sf):
    """Out-of-fold scores for every (model, fold) in one long table."""
    return _oof(spark, sf).select("row_id", "model", "fold", "y_true", F.round("score", 6).alias("score"))


@register("oof_model_auc")
def q_oof_auc(spark, sf):
    """E16 on real out-of-fold predictions, per model."""
    return metrics.roc_auc(_oof(spark, sf), "model").select("model", F.round("auc", 6).alias("auc"))


@register("tuned_model")
def q_tuned(spark, sf):
    """Grid search over the logistic penalty with the fold column."""
    d = model_frame(spark, sf)
    est = models.LogisticRegression(labelCol="y", maxIter=50)
    _, rows = models.tune(d, "y", "fold", est, {"regParam": [0.0, 0.01, 0.1, 1.0]}, parallelism=2)
    best = max(r[1] for r in rows)
    data = [(float(p["regParam"]), round(s, 6), int(s == best)) for p, s in rows]
    return spark.createDataFrame(data, "reg_param double, mean_auc double, is_best int")


@register("feature_importance")
def q_importance(spark, sf):
    """Random-forest importances, top 20."""
    d = model_frame(spark, sf)
    m = models.RandomForestClassifier(labelCol="y", numTrees=50, maxDepth=8, seed=SEED).fit(d)
    imp = models.importances(m, [f"t{i}" for i in range(N)])
    df = spark.createDataFrame([(n, round(v, 6)) for n, v in imp], "feature string, importance double")
    return metrics.top_k(df, [], [F.desc("importance"), F.asc("feature")], 20)


@register("rfecv_selection")
def q_rfecv(spark, sf):
    """Recursive feature elimination with CV AUC per round."""
    d = series_rows(spark, sf)
    cols = [f"t{i}" for i in range(N)]
    d = d.select("vec_id", "y", *[F.col("series")[i].cast("double").alias(c) for i, c in enumerate(cols)])
    d = cut_lineage(split.stratified_kfold(d, "vec_id", "y", K, SEED))
    make = lambda: models.RandomForestClassifier(labelCol="y", numTrees=20, maxDepth=6, seed=SEED)
    rounds = models.rfecv(d, "y", "fold", cols, make, step=0.5, min_features=8)
    best = max(r[1] for r in rounds)
    return spark.createDataFrame([(n, round(a, 6), int(a == best), ",".join(f)) for n, a, f in rounds],
                                 "n_features int, cv_auc double, is_best int, features string")


TARGETS = ["quality", "toxic"]
COMPONENTS = [5, 10]


@register("variation_grid", f"""
WITH v AS (SELECT lang AS variation, count(*) AS n_rows FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT variation, target, CAST(n_components AS INTEGER) AS n_components, n_rows
FROM v, (SELECT unnest({TARGETS}) AS target), (SELECT unnest({COMPONENTS}) AS n_components)""")
def q_variation_grid(spark, sf):
    """Every (cohort variation, target, component count) to run, with
    the labelled rows each variation has. The axes are short literal lists
    expanded with explode on the per-variation rows (no join)."""
    lab = table(spark, sf, "labels", "doc_id")
    doc = table(spark, sf, "documents", "doc_id", "lang")
    v = lab.join(doc, "doc_id").groupBy(F.col("lang").alias("variation")).agg(F.count(F.lit(1)).alias("n_rows"))
    v = v.withColumn("target", F.explode(F.array(*[F.lit(t) for t in TARGETS])))
    v = v.withColumn("n_components", F.explode(F.array(*[F.lit(c) for c in COMPONENTS])))
    return v.select("variation", "target", "n_components", "n_rows")
