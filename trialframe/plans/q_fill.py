"""Wide merges, name lists, many-signal summaries, status counts and class
reports (P5 F11 J5 A6 A28 E13 E14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialframe.functions import names
from trialframe.operators import clean, joins, metrics, summary
from trialframe.plans.q_metrics import CONF_SQL, PRED_SQL, predictions
from trialframe.plans.registry import register
from trialframe.sources.tables import table

R6 = 6

_PART_SQL = "SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean_value FROM events WHERE event_type = '{}' GROUP BY 1"


@register("wide_merge", f"""
WITH v AS ({_PART_SQL.format("view")}), c AS ({_PART_SQL.format("click")}), e AS ({_PART_SQL.format("error")})
SELECT user_id, v.n AS view_n, v.mean_value AS view_mean_value, c.n AS click_n, c.mean_value AS click_mean_value,
  e.n AS error_n, e.mean_value AS error_mean_value
FROM v FULL JOIN c USING (user_id) FULL JOIN e USING (user_id)""")
def q_wide_merge(spark, sf):
    """P5: per-source results merged on the shared key, columns prefixed."""
    ev = table(spark, sf, "events", "user_id", "event_type", "value")
    part = lambda t: ev.where(F.col("event_type") == t).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), R6).alias("mean_value"))
    return joins.wide_merge({f"{t}_": part(t) for t in ("view", "click", "error")}, ["user_id"])


@register("include_exclude_names", """
SELECT 'include' AS mode, event_type, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY 2
UNION ALL SELECT 'exclude', event_type, count(*) FROM events WHERE event_type NOT IN ('click', 'error') GROUP BY 2""")
def q_include_exclude(spark, sf):
    """the include list wins over the exclude list."""
    ev = table(spark, sf, "events", "event_type")
    count = lambda d, mode: d.groupBy(F.lit(mode).alias("mode"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    both = clean.include_exclude(ev, "event_type", ["view", "click"], ["click", "error"])
    return count(both, "include").unionByName(count(clean.include_exclude(ev, "event_type", exclude=["click", "error"]), "exclude"))


@register("recording_stats_join", """
WITH p AS (SELECT page_id, string_split(url, '/')[-1] AS base, 0 AS n FROM pages),
s AS (SELECT base, count(*) AS n, min(page_id) AS first_page FROM p GROUP BY 1 HAVING count(*) > 1)
SELECT p.page_id, p.base, s.n, s.first_page FROM p LEFT JOIN s USING (base)""")
def q_recording_stats_join(spark, sf):
    """Stats by base name joined to their rows; the clashing column comes
    from the stats, rows without stats stay (stats cover repeated names)."""
    p = table(spark, sf, "pages", "page_id", "url").select("page_id", names.base_name("url").alias("base"), F.lit(0).alias("n"))
    s = p.groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page")).where("n > 1")
    return joins.attach_stats(p, s, "base").select("page_id", "base", "n", "first_page")


SIGNALS = {
    "quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax",
    "net": "l_extendedprice * (1 - l_discount)", "gross": "l_extendedprice * (1 + l_tax)",
    "unit": "floor(l_extendedprice / l_quantity)", "discount_value": "l_extendedprice * l_discount",
    "tax_value": "l_extendedprice * l_tax", "line": "l_linenumber * 1.0",
}
_SIGNAL_SQL = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in SIGNALS.items())


@register("signal_summary", f"""
WITH s AS (SELECT l_suppkey, {_SIGNAL_SQL} FROM lineitem),
u AS (UNPIVOT s ON {", ".join(SIGNALS)} INTO NAME signal VALUE v)
SELECT l_suppkey, signal, count(v) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(min(v), 6) AS min,
  round(max(v), 6) AS max, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.25), 6) AS q25,
  round(quantile_cont(v, 0.75), 6) AS q75, round(max(v) - min(v), 6) AS range
FROM u GROUP BY 1, 2""")
def q_signal_summary(spark, sf):
    """Eight-number summary of ten signals per recording (supplier)."""
    li = table(spark, sf, "lineitem", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")
    d = li.select("l_suppkey", *[F.expr(e).cast("double").alias(n) for n, e in SIGNALS.items()])
    s = summary.signal_summary(d, ["l_suppkey"], list(SIGNALS))
    exact = ["min", "max", "median", "q25", "q75", "range"]
    return s.select("l_suppkey", "signal", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std")], *[F.round(c, R6).alias(c) for c in exact])


@register("status_counts", """
SELECT o_orderpriority, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY 1""")
def q_status_counts(spark, sf):
    """Rows per status."""
    s = summary.status_counts(table(spark, sf, "orders", "o_orderpriority"), ["o_orderpriority"])
    return s.withColumn("share", F.round("share", R6))


@register("confusion_shares", f"""
WITH {PRED_SQL}, c AS ({CONF_SQL}),
r AS (SELECT model, 0 AS actual, 0 AS predicted, tn AS count, tn + fp AS row, n FROM c
  UNION ALL SELECT model, 0, 1, fp, tn + fp, n FROM c UNION ALL SELECT model, 1, 0, fn, tp + fn, n FROM c
  UNION ALL SELECT model, 1, 1, tp, tp + fn, n FROM c)
SELECT model, actual, predicted, count, round(count / nullif(row, 0), 6) AS row_share, round(count / n, 6) AS total_share FROM r""")
def q_confusion_shares(spark, sf):
    """Counts with shares of the row and of the total."""
    c = metrics.confusion_shares(metrics.confusion(predictions(spark, sf), "model"), "model")
    return c.withColumns({s: F.round(s, R6) for s in ("row_share", "total_share")})


@register("class_report", f"""
WITH {PRED_SQL}, c AS ({CONF_SQL}),
r AS (SELECT model, 0 AS cls, tn AS hit, fn AS wrong, fp AS missed FROM c UNION ALL SELECT model, 1, tp, fp, fn FROM c),
q AS (SELECT *, coalesce(hit / nullif(hit + wrong, 0), 0) AS p, coalesce(hit / nullif(hit + missed, 0), 0) AS re FROM r)
SELECT model, cls, round(p, 6) AS precision, round(re, 6) AS recall,
  round(coalesce(2 * p * re / nullif(p + re, 0), 0), 6) AS f1, hit + missed AS support FROM q""")
def q_class_report(spark, sf):
    """Per-class precision, recall, f1 and support."""
    r = metrics.class_report(metrics.confusion(predictions(spark, sf), "model"), "model")
    return r.withColumns({s: F.round(s, R6) for s in ("precision", "recall", "f1")})
