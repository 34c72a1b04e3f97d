"""Metric, fold-summary, comparison and significance queries
(E13-E28, A25, W9, K6, K8, J14, X22, X24).

Prediction stand-in: labelled documents, y_true = quality; two "models"
score each document: ``length`` = n/(n+5000) of its character count and
``source`` = its source number / 20. Run variations: ``all`` documents and
``en_only`` (a filtered cohort, like the band-filtered runs).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from trialframe.operators import metrics, significance, split, summary
from trialframe.plans.registry import register
from trialframe.session import cut_lineage
from trialframe.sources.tables import table

R6 = 6
SEED = 42
K = 5


MODELS = {"length": "s_len", "source": "s_src"}


def document_scores(spark, sf):
    """One row per labelled document with the score of each model."""
    lab = table(spark, sf, "labels", "doc_id", "quality")
    doc = table(spark, sf, "documents", "doc_id", "n_chars", "source", "lang")
    return lab.join(doc, "doc_id").select(
        F.col("doc_id").alias("row_id"), F.col("quality").cast("double").alias("y_true"), "lang",
        F.round(F.col("n_chars") / (F.col("n_chars") + 5000.0), 6).alias("s_len"),
        F.round(F.substring("source", 4, 8).cast("int") / 20.0, 6).alias("s_src"))


def by_model(scores):
    """A row for each model, exploded in place: the join below runs once."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("score")) for m, c in MODELS.items()]))
    d = scores.withColumn("_m", each)
    return d.withColumns({"model": F.col("_m.model"), "score": F.col("_m.score")}).drop("_m", *MODELS.values())


def by_variation(rows):
    """A row for each run variation that the document belongs to."""
    both = F.when(F.col("lang") == "en", F.array(F.lit("all"), F.lit("en_only"))).otherwise(F.array(F.lit("all")))
    return rows.withColumn("variation", F.explode(both))


def predictions(spark, sf):
    return by_model(document_scores(spark, sf)).select("row_id", "y_true", "lang", "model", "score")


PRED_SQL = """pr AS (SELECT d.doc_id AS row_id, CAST(l.quality AS DOUBLE) AS y_true, d.lang,
    round(d.n_chars / (d.n_chars + 5000.0), 6) AS s_len, round(CAST(substr(d.source, 4) AS INTEGER) / 20.0, 6) AS s_src
  FROM labels l JOIN documents d USING (doc_id)),
p AS (SELECT row_id, y_true, lang, 'length' AS model, s_len AS score FROM pr
      UNION ALL SELECT row_id, y_true, lang, 'source' AS model, s_src AS score FROM pr)"""

CONF_SQL = """SELECT model, count(*) FILTER (WHERE score >= 0.5 AND y_true = 1) AS tp,
  count(*) FILTER (WHERE score >= 0.5 AND y_true = 0) AS fp, count(*) FILTER (WHERE score < 0.5 AND y_true = 0) AS tn,
  count(*) FILTER (WHERE score < 0.5 AND y_true = 1) AS fn, count(*) AS n FROM p GROUP BY model"""


@register("confusion_metrics", f"""
WITH {PRED_SQL}, c AS ({CONF_SQL}),
m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS prec, coalesce(tp / nullif(tp + fn, 0), 0) AS rec FROM c)
SELECT model, tp, fp, tn, fn, n, round((tp + tn) / n, 6) AS accuracy, round(prec, 6) AS precision, round(rec, 6) AS recall,
  round(coalesce(2 * prec * rec / nullif(prec + rec, 0), 0), 6) AS f1,
  round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity, tp + fn AS support_pos, tn + fp AS support_neg
FROM m""")
def q_confusion(spark, sf):
    """E13 E14 (X13 threshold >= 0.5)."""
    r = metrics.from_confusion(metrics.confusion(predictions(spark, sf), "model"))
    dbl = ["accuracy", "precision", "recall", "f1", "specificity"]
    return r.select("model", "tp", "fp", "tn", "fn", "n", *[F.round(c, R6).alias(c) for c in dbl],
                    "support_pos", "support_neg")


@register("mcc", f"""
WITH {PRED_SQL}, c AS ({CONF_SQL})
SELECT model, round(coalesce((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) /
  nullif(sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc FROM c""")
def q_mcc(spark, sf):
    """Matthews correlation, 0 when undefined."""
    r = metrics.from_confusion(metrics.confusion(predictions(spark, sf), "model"))
    return r.select("model", F.round("mcc", R6).alias("mcc"))


SC_SQL = """sc AS (SELECT model, score, count(*) FILTER (WHERE y_true = 1) AS pos, count(*) FILTER (WHERE y_true = 0) AS neg
               FROM p GROUP BY 1, 2),
cu AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
              sum(pos) OVER (PARTITION BY model) AS bigp, sum(neg) OVER (PARTITION BY model) AS bign
       FROM sc WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@register("roc_auc", f"""
WITH {PRED_SQL}, {SC_SQL}
SELECT model, round(sum(pos * ((bign - fp) + neg / 2.0)) / (any_value(bigp) * any_value(bign)), 6) AS auc
FROM cu GROUP BY model""")
def q_roc_auc(spark, sf):
    """Tie-aware AUC from per-score counts."""
    r = metrics.roc_auc(predictions(spark, sf), "model")
    return r.select("model", F.round("auc", R6).alias("auc"))


@register("roc_curve", f"""
WITH {PRED_SQL}, {SC_SQL}
SELECT model, score AS threshold, round(fp / bign, 6) AS fpr, round(tp / bigp, 6) AS tpr FROM cu""")
def q_roc_curve(spark, sf):
    """(fpr, tpr) at every distinct threshold."""
    r = metrics.roc_curve(predictions(spark, sf), "model")
    return r.select("model", "threshold", F.round("fpr", R6).alias("fpr"), F.round("tpr", R6).alias("tpr"))


@register("pr_curve_ap", f"""
WITH {PRED_SQL}, {SC_SQL},
ap AS (SELECT model, sum(pos / bigp * (tp / (tp + fp))) AS ap FROM cu GROUP BY model)
SELECT model, score AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / bigp, 6) AS recall,
  round(bigp / (bigp + bign), 6) AS baseline, round(ap, 6) AS ap FROM cu JOIN ap USING (model)""")
def q_pr_curve_ap(spark, sf):
    """precision/recall per threshold, no-skill baseline and the
    step-wise average precision."""
    p = predictions(spark, sf)
    c = metrics.pr_curve(p, "model")
    ap = metrics.average_precision(p, "model")
    return c.join(ap, "model").select(
        "model", "threshold", *[F.round(x, R6).alias(x) for x in ["precision", "recall", "baseline", "ap"]])


@register("regression_metrics", """
WITH r AS (SELECT l_extendedprice AS y, l_quantity * p_retailprice AS yhat FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT round(avg((y - yhat) * (y - yhat)), 4) AS mse, round(sqrt(avg((y - yhat) * (y - yhat))), 4) AS rmse,
  round(avg(abs(y - yhat)), 4) AS mae, round(1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)), 6) AS r2,
  count(*) AS n FROM r""")
def q_regression_metrics(spark, sf):
    """Line price predicted as quantity x list price."""
    li = table(spark, sf, "lineitem", "l_partkey", "l_quantity", "l_extendedprice")
    pt = table(spark, sf, "part", "p_partkey", "p_retailprice")
    r = li.join(pt, li.l_partkey == pt.p_partkey).select(
        F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * F.col("p_retailprice")).alias("yhat"))
    m = metrics.regression_metrics(r, [], "y", "yhat")
    return m.select(F.round("mse", 4).alias("mse"), F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"),
                    F.round("r2", R6).alias("r2"), "n")


@register("residual_histogram", """
WITH r AS (SELECT l_extendedprice - l_quantity * p_retailprice AS e FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (SELECT min(e) AS lo, max(e) AS hi FROM r),
b AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((e - lo) / ((hi - lo) / 30)), 29) END AS INTEGER) AS bin
      FROM r, s)
SELECT bin, count(*) AS n FROM b GROUP BY bin""")
def q_residual_histogram(spark, sf):
    """E21 + A27: residuals in 30 equal bins."""
    li = table(spark, sf, "lineitem", "l_partkey", "l_quantity", "l_extendedprice")
    pt = table(spark, sf, "part", "p_partkey", "p_retailprice")
    r = metrics.residuals(li.join(pt, li.l_partkey == pt.p_partkey).withColumn(
        "yhat", F.col("l_quantity") * F.col("p_retailprice")), "l_extendedprice", "yhat", "e")
    return summary.histogram(r, "e", 30).select("bin", "n")


# ------------------------------------------------------------ fold metrics
def variations(spark, sf):
    return by_variation(predictions(spark, sf))


def fold_metrics(spark, sf):
    """Long (variation, model, fold, metric, value): accuracy and AUC per
    stratified fold (folds drawn per variation, same for every model). The
    fold is found on the document rows, the models are exploded after it, and
    one table of counts per score gives both metrics."""
    rows = by_variation(document_scores(spark, sf))
    rows = split.hash_position(rows, "row_id", SEED, ["variation", "y_true"], pos="_p")
    v = by_model(rows.withColumn("fold", (F.col("_p") % K).cast("int")))
    by = ["variation", "model", "fold"]
    both = metrics.accuracy_and_auc(metrics.score_counts(v, by), by)
    return both.unpivot(by, ["accuracy", "auc"], "metric", "value")


FOLD_SQL = f"""{PRED_SQL},
v AS (SELECT *, 'all' AS variation FROM p UNION ALL SELECT *, 'en_only' AS variation FROM p WHERE lang = 'en'),
r AS (SELECT DISTINCT variation, row_id, y_true FROM v),
fo AS (SELECT variation, row_id, CAST((row_number() OVER (PARTITION BY variation, y_true
        ORDER BY CAST(('0x' || substr(md5(concat(CAST(row_id AS VARCHAR), ':', '42')), 1, 8)) AS BIGINT), row_id) - 1) % {K}
        AS INTEGER) AS fold FROM r),
vf AS (SELECT v.*, fo.fold FROM v JOIN fo USING (variation, row_id)),
acc AS (SELECT variation, model, fold, 'accuracy' AS metric,
          count(*) FILTER (WHERE (score >= 0.5) = (y_true = 1)) / count(*) AS value FROM vf GROUP BY 1, 2, 3),
sc2 AS (SELECT variation, model, fold, score, count(*) FILTER (WHERE y_true = 1) AS pos,
          count(*) FILTER (WHERE y_true = 0) AS neg FROM vf GROUP BY 1, 2, 3, 4),
cu2 AS (SELECT *, sum(neg) OVER (PARTITION BY variation, model, fold ORDER BY score DESC
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
          sum(pos) OVER (PARTITION BY variation, model, fold) AS bigp, sum(neg) OVER (PARTITION BY variation, model, fold) AS bign
        FROM sc2),
auc AS (SELECT variation, model, fold, 'auc' AS metric,
          sum(pos * ((bign - fp) + neg / 2.0)) / nullif(any_value(bigp) * any_value(bign), 0) AS value FROM cu2 GROUP BY 1, 2, 3),
fm AS (SELECT * FROM acc UNION ALL SELECT * FROM auc),
fs AS (SELECT variation, model, metric, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max,
          count(value) AS n FROM fm GROUP BY 1, 2, 3)"""


def fold_summary(spark, sf):
    return metrics.fold_summary(fold_metrics(spark, sf), ["variation", "model", "metric"])


@register("fold_summary", f"""
WITH {FOLD_SQL}
SELECT variation, model, metric, round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min,
  round(max, 6) AS max, n FROM fs""")
def q_fold_summary(spark, sf):
    """A25 over (variation, model, metric): mean, population std, min, max."""
    s = fold_summary(spark, sf)
    return s.select("variation", "model", "metric", *[F.round(c, R6).alias(c) for c in ["mean", "std", "min", "max"]], "n")


@register("fold_side_summary", f"""
WITH {FOLD_SQL},
k AS (SELECT unnest(range(0, {K})) AS k),
x AS (SELECT model, k AS fold, CASE WHEN fold = k THEN 'test' ELSE 'train' END AS side, score, y_true FROM vf, k WHERE variation = 'all'),
e AS (SELECT model, side, fold, avg(CASE WHEN (score >= 0.5) = (y_true = 1) THEN 1.0 ELSE 0 END) AS accuracy, avg(abs(score - y_true)) AS mae,
        sqrt(avg(pow(score - y_true, 2))) AS rmse FROM x GROUP BY ALL)
SELECT model, side, metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, count(*) AS n
FROM (UNPIVOT e ON accuracy, mae, rmse INTO NAME metric VALUE v) GROUP BY model, side, metric""")
def q_fold_side_summary(spark, sf):
    """Metrics of the test and the train side of each fold; errors are
    kept negated, so that more is better for all, and flipped on output."""
    rows = split.hash_position(document_scores(spark, sf), "row_id", SEED, ["y_true"], pos="_p")
    rows = by_model(rows.withColumn("fold", (F.col("_p") % K).cast("int")))
    d = metrics.fold_sides(rows.select("model", "fold", "score", "y_true"), "fold", K)
    error = F.abs(F.col("score") - F.col("y_true"))
    right = ((F.col("score") >= 0.5) == (F.col("y_true") == 1)).cast("double")
    m = d.groupBy("model", "side", "fold").agg(F.avg(right).alias("accuracy"), (-F.avg(error)).alias("neg_mae"), (-F.sqrt(F.avg(error * error))).alias("neg_rmse"))
    long = m.unpivot(["model", "side", "fold"], ["accuracy", "neg_mae", "neg_rmse"], "metric", "value")
    s = metrics.flipped(metrics.fold_summary(long, ["model", "side", "metric"]))
    return s.select("model", "side", "metric", *[F.round(c, R6).alias(c) for c in ("mean", "std", "min", "max")], "n")


@register("variation_ranking", f"""
WITH {FOLD_SQL},
b AS (SELECT variation, arg_min(model, (-mean, model)) AS model, max(mean) AS auc FROM fs WHERE metric = 'auc' GROUP BY variation)
SELECT CAST(row_number() OVER (ORDER BY auc DESC, variation) AS INTEGER) AS rank, variation, model, round(auc, 6) AS auc,
  (SELECT bool_and(auc < 0.6) FROM b) AS all_below_06 FROM b""")
def q_variation_ranking(spark, sf):
    """K8: the best model of each variation, ranked by score over all
    variations, and whether all of them are below 0.6."""
    s = fold_summary(spark, sf).where(F.col("metric") == "auc").select("variation", "model", "mean")
    b = cut_lineage(metrics.best_per_group(s, "variation", "model", "mean"))
    below = b.agg(F.bool_and(F.col("mean") < 0.6)).scalar()
    r = metrics.top_k(b, [], [F.desc("mean"), F.asc("variation")], 2**31 - 1)
    return r.select("rank", "variation", "model", F.round("mean", R6).alias("auc"), below.alias("all_below_06"))


@register("predictions_side_by_side", f"""
WITH {PRED_SQL}
SELECT row_id, max(score) FILTER (WHERE model = 'length') AS length, max(score) FILTER (WHERE model = 'source') AS source FROM p GROUP BY row_id""")
def q_side_by_side(spark, sf):
    """The predictions of several models in one row per id, by key."""
    from trialframe.operators.models import side_by_side

    return side_by_side(predictions(spark, sf), ["length", "source"])


@register("metric_grades", f"""
WITH {FOLD_SQL}
SELECT variation, model, metric, round(cume_dist() OVER (PARTITION BY variation, metric ORDER BY mean), 6) AS rank_share,
  CASE WHEN count(mean) OVER (PARTITION BY variation, metric) < 2 THEN ''
       WHEN cume_dist() OVER (PARTITION BY variation, metric ORDER BY mean) >= 0.8 THEN 'excellent'
       WHEN cume_dist() OVER (PARTITION BY variation, metric ORDER BY mean) >= 0.6 THEN 'good'
       WHEN cume_dist() OVER (PARTITION BY variation, metric ORDER BY mean) >= 0.4 THEN 'fair'
       WHEN cume_dist() OVER (PARTITION BY variation, metric ORDER BY mean) >= 0.2 THEN 'poor' ELSE 'very_poor' END AS grade
FROM fs""")
def q_metric_grades(spark, sf):
    """Relative grade of each model's mean within (variation, metric)."""
    g = metrics.metric_grade(fold_summary(spark, sf), ["variation", "metric"], "mean")
    return g.select("variation", "model", "metric", F.round("rank_share", R6).alias("rank_share"), "grade")


@register("best_per_variation", f"""
WITH {FOLD_SQL}
SELECT variation, arg_min(model, (-mean, model)) AS model, round(max(mean), 6) AS auc,
  CAST(bool_and(mean < 0.6) AS INTEGER) AS all_below_06,
  CASE WHEN max(mean) < 0.5 THEN 'poor' WHEN max(mean) < 0.6 THEN 'fair' ELSE 'good' END AS band
FROM fs WHERE metric = 'auc' GROUP BY variation""")
def q_best_per_variation(spark, sf):
    """Best model per variation by mean AUC (ties -> name), the
    'all below 0.6' flag and the score band."""
    s = fold_summary(spark, sf).where(F.col("metric") == "auc").select("variation", "model", "mean")
    b = metrics.best_per_group(s, "variation", "model", "mean")
    flags = s.groupBy("variation").agg(F.bool_and(F.col("mean") < 0.6).cast("int").alias("all_below_06"))
    from trialframe.functions.scalar import score_band

    return b.join(flags, "variation").select("variation", "model", F.round("mean", R6).alias("auc"),
                                             "all_below_06", score_band("mean").alias("band"))


@register("variation_delta", f"""
WITH {FOLD_SQL}
SELECT a.model, a.metric, round(a.mean, 6) AS mean_all, round(e.mean, 6) AS mean_en_only, round(e.mean - a.mean, 6) AS delta
FROM fs a JOIN fs e ON a.model = e.model AND a.metric = e.metric AND a.variation = 'all' AND e.variation = 'en_only'""")
def q_variation_delta(spark, sf):
    """Filtered-vs-all comparison per model and metric."""
    from trialframe.operators.joins import metric_delta

    s = fold_summary(spark, sf)
    d = metric_delta(s.where(F.col("variation") == "all"), s.where(F.col("variation") == "en_only"),
                     ["model", "metric"], ["mean"], ("_all", "_en_only"))
    return d.select("model", "metric", F.round("mean_all", R6).alias("mean_all"),
                    F.round("mean_en_only", R6).alias("mean_en_only"), F.round("mean_delta", R6).alias("delta"))


@register("score_table", f"""
WITH {FOLD_SQL}
SELECT variation, model, round(max(mean) FILTER (WHERE metric = 'accuracy'), 6) AS accuracy,
  round(max(mean) FILTER (WHERE metric = 'auc'), 6) AS auc FROM fs GROUP BY 1, 2""")
def q_score_table(spark, sf):
    """One row per (variation, model), one column per metric (pivot
    over an explicit metric list)."""
    s = fold_summary(spark, sf)
    w = metrics.wide_scores(s, ["variation", "model"], "metric", "mean", ["accuracy", "auc"])
    return w.select("variation", "model", F.round("accuracy", R6).alias("accuracy"), F.round("auc", R6).alias("auc"))


# ------------------------------------------------------------ significance
def test_rows(spark, sf):
    """The held-out 20 % (stratified, test size rounded up) of the rows."""
    p = predictions(spark, sf)
    rows = p.select("row_id", "y_true").distinct()
    t = split.train_test_split(rows, "row_id", 0.2, SEED, stratify="y_true").where(F.col("split") == "test")
    # read for the majority class, the counts and the curves
    return cut_lineage(p.join(t.select("row_id"), "row_id"))


# the tests of a model's counts, each built only where it is asked for
TESTS = {
    "p_binom_majority": lambda n, share: significance.binom_sf(F.col("n_correct"), n, share),
    "p_binom_chance": lambda n, share: significance.binom_sf(F.col("n_correct"), n, F.lit(0.5)),
    "p_perm": lambda n, share: significance.permutation_p(n, F.col("n_correct"), F.col("pos_true"), F.col("pos_pred")),
    "p_mcnemar": lambda n, share: significance.mcnemar_p(F.col("b"), F.col("c")),
    "p_mcnemar_positive": lambda n, share: significance.mcnemar_p(F.col("b_positive"), F.col("c_positive")),
}


def sig_table(spark, sf, tests=(), rows=None):
    t = (test_rows(spark, sf) if rows is None else rows).withColumn("pred", (F.col("score") >= 0.5).cast("double"))
    # majority class of the test labels as a scalar subquery (no driver round trip)
    maj = summary.mode_smallest(t.select("row_id", "y_true").distinct(), "y_true").select("mode").scalar()
    g = t.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("pred") == F.col("y_true")).alias("n_correct"),
        F.count_if(F.col("y_true") == 1).alias("pos_true"),
        F.count_if(F.col("pred") == 1).alias("pos_pred"),
        F.count_if(F.col("y_true") == maj).alias("n_majority"),
        F.count_if((F.col("pred") == F.col("y_true")) & (F.col("y_true") != maj)).alias("b"),
        F.count_if((F.col("pred") != F.col("y_true")) & (F.col("y_true") == maj)).alias("c"),
        # against the classifier that calls every row positive
        F.count_if((F.col("pred") == 0) & (F.col("y_true") == 0)).alias("b_positive"),
        F.count_if((F.col("pred") == 0) & (F.col("y_true") == 1)).alias("c_positive"),
    )
    n = F.col("n")
    maj_share = F.col("n_majority") / n
    return g.withColumns({
        "accuracy": F.col("n_correct") / n,
        "majority_acc": maj_share,
        "random_acc": maj_share * maj_share + (1 - maj_share) * (1 - maj_share),
        **{t: TESTS[t](n, maj_share) for t in tests},
    })


def _sig_sql():
    def binom(k, n, p):
        return (f"list_sum(list_transform(range({k}, {n} + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - "
                f"lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p}))))")

    def lgc(a, b):
        return f"(lgamma(({a}) + 1) - lgamma(({b}) + 1) - lgamma(({a}) - ({b}) + 1))"

    x0 = "CAST(ceil((n_correct - n + pos_pred + pos_true) / 2.0) AS BIGINT)"
    lo = "greatest(0, pos_pred - (n - pos_true))"
    hi = "least(pos_true, pos_pred)"
    hyper = (f"CASE WHEN {x0} <= {lo} THEN 1.0 WHEN {x0} > {hi} THEN 0.0 ELSE least(list_sum(list_transform("
             f"range({x0}, {hi} + 1), lambda x: exp({lgc('pos_true', 'x')} + {lgc('n - pos_true', 'pos_pred - x')} - "
             f"{lgc('n', 'pos_pred')}))), 1.0) END")

    def mcnemar(b, c):
        # Simpson's rule for the integral of the normal density up to the root of the statistic
        root, h = f"(abs({b} - {c}) - 1) / sqrt({b} + {c})", f"(abs(abs({b} - {c}) - 1) / sqrt({b} + {c}) / 2000)"
        area = (f"{h} / 3 * list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 "
                f"ELSE 2 END) * exp(-pow(i * {h}, 2) / 2)))")
        return f"CASE WHEN {b} + {c} = 0 THEN 1.0 WHEN abs({root}) > 8 THEN 0.0 ELSE 1 - {area} * 2 / sqrt(2 * pi()) END"

    return f"""{PRED_SQL},
rows_ AS (SELECT DISTINCT row_id, y_true FROM p),
c0 AS (SELECT y_true, count(*) AS nc FROM rows_ GROUP BY 1),
t0 AS (SELECT ceil((SELECT count(*) FROM rows_) * 0.2) AS draw),
a1 AS (SELECT y_true, nc, draw * nc / (SELECT count(*) FROM rows_) AS cont FROM c0, t0),
a2 AS (SELECT *, floor(cont) AS fl, cont - floor(cont) AS rem FROM a1),
a3 AS (SELECT *, row_number() OVER (ORDER BY rem DESC, y_true) - 1 AS rk, (SELECT draw FROM t0) - sum(fl) OVER () AS need FROM a2),
al AS (SELECT y_true, fl + CASE WHEN rk < need THEN 1 ELSE 0 END AS n_draw FROM a3),
ps AS (SELECT row_id, y_true, row_number() OVER (PARTITION BY y_true ORDER BY
         CAST(('0x' || substr(md5(concat(CAST(row_id AS VARCHAR), ':', '42')), 1, 8)) AS BIGINT), row_id) - 1 AS pos FROM rows_),
te AS (SELECT row_id FROM ps JOIN al USING (y_true) WHERE pos < n_draw),
t AS (SELECT p.*, CAST(score >= 0.5 AS DOUBLE) AS pred FROM p JOIN te USING (row_id)),
mj AS (SELECT arg_max(y_true, (n, -y_true)) AS maj FROM (SELECT y_true, count(*) AS n FROM (SELECT DISTINCT row_id, y_true FROM t) GROUP BY 1)),
g AS (SELECT model, count(*) AS n, count(*) FILTER (WHERE pred = y_true) AS n_correct,
        count(*) FILTER (WHERE y_true = 1) AS pos_true, count(*) FILTER (WHERE pred = 1) AS pos_pred,
        count(*) FILTER (WHERE y_true = maj) AS n_majority,
        count(*) FILTER (WHERE pred = y_true AND y_true <> maj) AS b,
        count(*) FILTER (WHERE pred <> y_true AND y_true = maj) AS c,
        count(*) FILTER (WHERE pred = 0 AND y_true = 0) AS b_positive,
        count(*) FILTER (WHERE pred = 0 AND y_true = 1) AS c_positive FROM t, mj GROUP BY model),
s AS (SELECT *, n_correct / n AS accuracy, n_majority / n AS maj_share,
        {binom('n_correct', 'n', 'n_majority / n')} AS p_binom_majority, {binom('n_correct', 'n', '0.5')} AS p_binom_chance,
        {hyper} AS p_perm, {mcnemar('b', 'c')} AS p_mcnemar, {mcnemar('b_positive', 'c_positive')} AS p_mcnemar_positive FROM g)"""


SIG_SQL = _sig_sql()


@register("binomial_mcnemar", f"""
WITH {SIG_SQL}
SELECT model, n, n_correct, round(accuracy, 6) AS accuracy, round(maj_share, 6) AS majority_acc,
  round(p_binom_majority, 6) AS p_binom_majority, round(p_binom_chance, 6) AS p_binom_chance,
  b, c, round(p_mcnemar, 6) AS p_mcnemar, b_positive, c_positive, round(p_mcnemar_positive, 6) AS p_mcnemar_positive,
  CASE WHEN p_binom_majority < 0.001 THEN '***' WHEN p_binom_majority < 0.01 THEN '**'
       WHEN p_binom_majority < 0.05 THEN '*' ELSE 'ns' END AS stars FROM s""")
def q_binomial_mcnemar(spark, sf):
    """E24 E26 X22 on the held-out rows: one-sided binomial tests against
    the majority share and 0.5, McNemar against the majority classifier and
    against the one that calls every row positive."""
    s = sig_table(spark, sf, ["p_binom_majority", "p_binom_chance", "p_mcnemar", "p_mcnemar_positive"])
    return s.select("model", "n", "n_correct", F.round("accuracy", R6).alias("accuracy"),
                    F.round("majority_acc", R6).alias("majority_acc"),
                    F.round("p_binom_majority", R6).alias("p_binom_majority"),
                    F.round("p_binom_chance", R6).alias("p_binom_chance"), "b", "c",
                    F.round("p_mcnemar", R6).alias("p_mcnemar"), "b_positive", "c_positive",
                    F.round("p_mcnemar_positive", R6).alias("p_mcnemar_positive"),
                    significance.stars(F.col("p_binom_majority")).alias("stars"))


@register("permutation_p", f"""
WITH {SIG_SQL} SELECT model, n_correct, pos_true, pos_pred, round(p_perm, 6) AS p_perm FROM s""")
def q_permutation_p(spark, sf):
    """E25, exact permutation p-value (hypergeometric tail)."""
    s = sig_table(spark, sf, ["p_perm"])
    return s.select("model", "n_correct", "pos_true", "pos_pred", F.round("p_perm", R6).alias("p_perm"))


@register("chance_baselines", f"""
WITH {SIG_SQL}
SELECT DISTINCT round(maj_share, 6) AS majority_acc,
  round(maj_share * maj_share + (1 - maj_share) * (1 - maj_share), 6) AS random_acc FROM s""")
def q_chance_baselines(spark, sf):
    """Majority-class accuracy and the expected accuracy of a random
    guess that follows the class distribution (sum of squared shares)."""
    s = sig_table(spark, sf)
    return s.select(F.round("majority_acc", R6).alias("majority_acc"),
                    F.round("random_acc", R6).alias("random_acc")).distinct()


@register("significance_report", f"""
WITH {SIG_SQL}, {SC_SQL.replace('FROM p GROUP', 'FROM t GROUP')},
au AS (SELECT model, sum(pos * ((bign - fp) + neg / 2.0)) / (any_value(bigp) * any_value(bign)) AS auc FROM cu GROUP BY model),
j AS (SELECT s.*, au.auc FROM s JOIN au USING (model))
SELECT count(*) FILTER (WHERE p_binom_majority < 0.05) AS n_significant, count(*) AS n_models,
  arg_min(model, (-auc, model)) AS best_model, round(max(auc), 6) AS best_auc,
  CASE WHEN count(*) FILTER (WHERE p_binom_majority < 0.05) = 0 THEN 'no model beats the majority baseline'
       WHEN max(auc) < 0.7 THEN 'significant, small effect' ELSE 'significant, reasonable effect' END AS verdict FROM j""")
def q_significance_report(spark, sf):
    """Significant-model count, best model by test AUC, verdict tier."""
    j = assessed(spark, sf, ["p_binom_majority"])
    n_sig = F.count_if(F.col("p_binom_majority") < 0.05)
    best = F.max("auc")
    return j.agg(
        n_sig.alias("n_significant"), F.count(F.lit(1)).alias("n_models"),
        F.min_by("model", F.struct(-F.col("auc"), F.col("model"))).alias("best_model"),
        F.round(best, R6).alias("best_auc"),
        F.when(n_sig == 0, "no model beats the majority baseline").when(best < 0.7, "significant, small effect")
        .otherwise("significant, reasonable effect").alias("verdict"))


def assessed(spark, sf, tests):
    """The given tests of each model and its AUC, from one table of held-out rows."""
    rows = test_rows(spark, sf)
    return sig_table(spark, sf, tests, rows).join(metrics.roc_auc(rows, "model"), "model")


@register("model_assessment", f"""
WITH {SIG_SQL}, {SC_SQL.replace('FROM p GROUP', 'FROM t GROUP')},
au AS (SELECT model, sum(pos * ((bign - fp) + neg / 2.0)) / (any_value(bigp) * any_value(bign)) AS auc FROM cu GROUP BY model)
SELECT model, round(auc, 6) AS auc, accuracy > maj_share AND p_binom_majority < 0.05 AS beats_majority, auc > 0.6 AS discriminates,
  CASE WHEN p_mcnemar_positive < 0.001 THEN '***' WHEN p_mcnemar_positive < 0.01 THEN '**' WHEN p_mcnemar_positive < 0.05 THEN '*' ELSE 'ns' END
    AS mcnemar_stars FROM s JOIN au USING (model)""")
def q_model_assessment(spark, sf):
    """Is a model significantly better than the majority class, does
    its AUC show discrimination, and how far is it from all-positive."""
    beats = (F.col("accuracy") > F.col("majority_acc")) & (F.col("p_binom_majority") < 0.05)
    return assessed(spark, sf, ["p_binom_majority", "p_mcnemar_positive"]).select("model", F.round("auc", R6).alias("auc"), beats.alias("beats_majority"),
                                      (F.col("auc") > 0.6).alias("discriminates"), significance.stars(F.col("p_mcnemar_positive")).alias("mcnemar_stars"))
