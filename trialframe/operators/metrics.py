"""Classification / regression metrics and fold summaries over *long*
prediction tables (E13-E21, A25, W9, K6, K8, E28, J14).

Ranking metrics never sort raw predictions: rows are first reduced to one
row per (group, distinct score) with positive/negative counts (a partially
aggregated groupBy), and cumulative counts come from the chunked scan over
that reduced table. AUC, ROC, PR and AP all derive from it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialframe.operators import ordered

def _by(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def confusion(df: DataFrame, by, y: str = "y_true", score: str = "score", thr: float = 0.5,
              pred: str | None = None) -> DataFrame:
    """Tp, fp, tn, fn, n per group; predicted class = score >= thr
    (X13) unless a ``pred`` column is given."""
    p = F.col(pred) if pred else (F.col(score) >= thr).cast("double")
    t = F.col(y)
    return df.groupBy(*_by(by)).agg(
        F.count_if((p == 1) & (t == 1)).alias("tp"), F.count_if((p == 1) & (t == 0)).alias("fp"),
        F.count_if((p == 0) & (t == 0)).alias("tn"), F.count_if((p == 0) & (t == 1)).alias("fn"),
        F.count(F.lit(1)).alias("n"))


def from_confusion(conf: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, f1 (zero division -> 0),
    specificity, MCC (0 when undefined), supports, row/total shares."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    z = F.lit(0.0)
    prec = F.coalesce(F.try_divide(tp, tp + fp), z)
    rec = F.coalesce(F.try_divide(tp, tp + fn), z)
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return conf.withColumns({
        "accuracy": (tp + tn) / F.col("n"),
        "precision": prec,
        "recall": rec,
        "f1": F.coalesce(F.try_divide(2 * prec * rec, prec + rec), z),
        "specificity": F.coalesce(F.try_divide(tn, tn + fp), z),
        "mcc": F.coalesce(F.try_divide(tp * tn - fp * fn, F.nullif(den, z)), z),
        "support_pos": F.col("tp") + F.col("fn"),
        "support_neg": F.col("tn") + F.col("fp"),
    })


def score_counts(df: DataFrame, by, y: str = "y_true", score: str = "score") -> DataFrame:
    """One row per (group, distinct score): positives and negatives."""
    return df.groupBy(*_by(by), score).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))


def _scan_desc(sc: DataFrame, by, score: str) -> DataFrame:
    """Cumulative pos/neg at scores >= s (thresholds high -> low)."""
    sc = ordered.range_chunked(sc.withColumn("_neg_s", -F.col(score)), ["_neg_s", *_by(by)])
    return ordered.scan(sc, _by(by), ["_neg_s"], F.col("_range"),
                        cumsum={"tp": "pos", "fp": "neg"},
                        totals={"P": ("sum", "pos"), "N": ("sum", "neg")}).drop("_neg_s", "_range")


def roc_auc(df: DataFrame, by, y: str = "y_true", score: str = "score") -> DataFrame:
    """Tie-aware ROC AUC (= Mann-Whitney with mid-ranks):
    sum_s pos(s) * (neg below s + neg(s)/2) / (P*N). Null for one class."""
    s = _scan_desc(score_counts(df, by, y, score), by, score)
    # negatives strictly below s = N - (negatives at scores >= s)
    contrib = F.col("pos") * ((F.col("N") - F.col("fp")) + F.col("neg") / 2.0)
    return s.groupBy(*_by(by)).agg(
        F.try_divide(F.sum(contrib), F.first("P") * F.first("N")).alias("auc"))


def accuracy_and_auc(counts: DataFrame, by, score: str = "score", thr: float = 0.5) -> DataFrame:
    """Accuracy at ``thr`` and tie-aware AUC per group from one table of
    ``score_counts``."""
    s = _scan_desc(counts, by, score)
    right = F.when(F.col(score) >= thr, F.col("pos")).otherwise(F.col("neg"))
    pairs = F.col("pos") * ((F.col("N") - F.col("fp")) + F.col("neg") / 2.0)
    return s.groupBy(*_by(by)).agg(
        (F.sum(right) / F.sum(F.col("pos") + F.col("neg"))).alias("accuracy"),
        F.try_divide(F.sum(pairs), F.first("P") * F.first("N")).alias("auc"))


def roc_curve(df: DataFrame, by, y: str = "y_true", score: str = "score") -> DataFrame:
    """One point per distinct threshold (score >= threshold)."""
    s = _scan_desc(score_counts(df, by, y, score), by, score)
    return s.select(*_by(by), F.col(score).alias("threshold"),
                    F.try_divide(F.col("fp"), F.col("N")).alias("fpr"),
                    F.try_divide(F.col("tp"), F.col("P")).alias("tpr"))


def pr_curve(df: DataFrame, by, y: str = "y_true", score: str = "score") -> DataFrame:
    """Precision / recall per distinct threshold and the no-skill
    baseline P / (P + N)."""
    s = _scan_desc(score_counts(df, by, y, score), by, score)
    return s.select(*_by(by), F.col(score).alias("threshold"),
                    (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                    F.try_divide(F.col("tp"), F.col("P")).alias("recall"),
                    (F.col("P") / (F.col("P") + F.col("N"))).alias("baseline"))


def average_precision(df: DataFrame, by, y: str = "y_true", score: str = "score") -> DataFrame:
    """AP = sum_n (R_n - R_{n-1}) P_n over descending thresholds (step,
    not trapezoid); R_n - R_{n-1} = pos(s) / P."""
    s = _scan_desc(score_counts(df, by, y, score), by, score)
    term = F.col("pos") / F.col("P") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return s.groupBy(*_by(by)).agg(F.sum(term).alias("ap"))


def regression_metrics(df: DataFrame, by, y: str, pred: str) -> DataFrame:
    """MSE, RMSE, MAE, R^2 = 1 - SSE / SST (one pass)."""
    e = F.col(y) - F.col(pred)
    g = df.groupBy(*_by(by)).agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
        F.sum(e * e).alias("_sse"), F.var_pop(y).alias("_var"), F.count(F.lit(1)).alias("n"))
    return g.withColumns({
        "rmse": F.sqrt("mse"),
        "r2": 1 - F.try_divide(F.col("_sse"), F.col("_var") * F.col("n")),
    }).drop("_sse", "_var")


def residuals(df: DataFrame, y: str, pred: str, out: str = "residual") -> DataFrame:
    """True - predicted."""
    return df.withColumn(out, F.col(y) - F.col(pred))


# ---------------------------------------------------------------- A25 W9 K6
def fold_summary(metrics_long: DataFrame, by, value: str = "value") -> DataFrame:
    """Mean, population std (ddof 0), min, max and count of a metric
    over folds x iterations; ``all_values`` sorted for reproducibility
    (bounded by folds x iterations)."""
    return metrics_long.groupBy(*_by(by)).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"),
        F.array_sort(F.collect_list(value)).alias("all_values"))


def fold_sides(rows: DataFrame, fold: str, k: int, side: str = "side") -> DataFrame:
    """Every row once for each fold, on the test side of its own fold and
    on the train side of the others."""
    d = rows.withColumn("_own", F.col(fold)).withColumn(fold, F.explode(F.array(*[F.lit(i) for i in range(k)])))
    return d.withColumn(side, F.when(F.col("_own") == F.col(fold), "test").otherwise("train")).drop("_own")


def flipped(summary: DataFrame, metric: str = "metric", prefix: str = "neg_") -> DataFrame:
    """Summaries of errors that are stored negated (``neg_rmse``), with
    their sign and name put right: mean, min and max change sign, min and max
    change places, the deviation stays."""
    neg = F.col(metric).startswith(prefix)
    sign = lambda c: F.when(neg, -F.col(c)).otherwise(F.col(c))
    return summary.withColumns({
        "mean": sign("mean"), "min": F.when(neg, -F.col("max")).otherwise(F.col("min")), "max": F.when(neg, -F.col("min")).otherwise(F.col("max")),
        metric: F.when(neg, F.substring(metric, len(prefix) + 1, 1000)).otherwise(F.col(metric)),
    })


def metric_grade(df: DataFrame, by, value: str, out: str = "grade") -> DataFrame:
    """Share of values <= x within ``by`` (cume_dist) -> grade at
    .8/.6/.4/.2; '' when fewer than 2 values. The window runs over the
    summary table (one row per model)."""
    w = Window.partitionBy(*_by(by))
    share = F.cume_dist().over(w.orderBy(value))
    n = F.count(value).over(w)
    return df.withColumns({"rank_share": share, out: (
        F.when(n < 2, "").when(share >= 0.8, "excellent").when(share >= 0.6, "good")
        .when(share >= 0.4, "fair").when(share >= 0.2, "poor").otherwise("very_poor"))})


def best_per_group(df: DataFrame, by, name: str, value: str) -> DataFrame:
    """K6: arg-max row by ``value`` per group, ties -> smallest name."""
    rest = [c for c in df.columns if c not in _by(by)]
    g = df.groupBy(*_by(by)).agg(
        F.min_by(F.struct(*rest), F.struct(-F.col(value), F.col(name))).alias("_r"))
    return g.select(*_by(by), *[F.col("_r")[c].alias(c) for c in rest])


def top_k(df: DataFrame, by, order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """K4/K5: top-k rows per group (a limit that IS the feature)."""
    w = Window.partitionBy(*_by(by)).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def wide_scores(metrics_long: DataFrame, index: Sequence[str], metric: str, value: str,
                metrics: Sequence[str]) -> DataFrame:
    """Long (model, metric, value) -> one row per model, one column per
    metric, with an explicit metric list (no distinct job)."""
    return metrics_long.groupBy(*index).pivot(metric, list(metrics)).agg(F.first(value))


def confusion_shares(conf: DataFrame, by) -> DataFrame:
    """The four cells of ``confusion`` as rows, with their share of the
    actual class and of all rows."""
    cells = [("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1)]
    each = F.explode(F.array(*[
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("count")) for c, a, p in cells
    ]))
    rows = conf.select(*_by(by), "tp", "fp", "tn", "fn", "n", each.alias("_c")).select(*_by(by), "tp", "fp", "tn", "fn", "n", "_c.*")
    actual = F.when(F.col("actual") == 1, F.col("tp") + F.col("fn")).otherwise(F.col("tn") + F.col("fp"))
    return rows.select(*_by(by), "actual", "predicted", "count", F.try_divide("count", actual).alias("row_share"),
                       (F.col("count") / F.col("n")).alias("total_share"))


def class_report(conf: DataFrame, by) -> DataFrame:
    """Precision, recall, f1 (zero division -> 0) and support of class 0
    and class 1, from ``confusion``."""
    z = F.lit(0.0)
    parts = F.explode(F.array(
        F.struct(F.lit(0).alias("cls"), F.col("tn").alias("hit"), F.col("fn").alias("wrong"), F.col("fp").alias("missed")),
        F.struct(F.lit(1).alias("cls"), F.col("tp").alias("hit"), F.col("fp").alias("wrong"), F.col("fn").alias("missed")),
    ))
    r = conf.select(*_by(by), parts.alias("_c")).select(*_by(by), "_c.*")
    r = r.withColumns({
        "precision": F.coalesce(F.try_divide(F.col("hit"), F.col("hit") + F.col("wrong")), z),
        "recall": F.coalesce(F.try_divide(F.col("hit"), F.col("hit") + F.col("missed")), z),
    })
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), z)
    return r.select(*_by(by), "cls", "precision", "recall", f1.alias("f1"), (F.col("hit") + F.col("missed")).alias("support"))
