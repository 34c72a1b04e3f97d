"""Ordered-series queries over the frame stand-in (events): recording =
(user_id, event_type), order = (ts, event_id), feature = value with every
7th event's value missing (W1-W19, A5-A11, A26, A27, F8, X16, X17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialframe.functions import scalar
from trialframe.operators import ordered, series, summary
from trialframe.operators.joins import attach
from trialframe.plans.registry import register
from trialframe.session import cut_lineage
from trialframe.sources.tables import frames, table

R6 = 6
REC = ["user_id", "event_type"]
ORDER = ["ts", "event_id"]


def chunk():
    """The chunk column of chunked frames."""
    return F.col(ordered.CHUNK)


def chunked(frames_):
    """Frames with a chunk for ordered scans: a day of a recording, or a range
    of a day that holds very many."""
    return ordered.even_chunks(frames_, REC, "ts")


F_SQL = """f AS (SELECT event_id, ts, user_id, event_type, props,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events)"""
W = "PARTITION BY user_id, event_type"
WO = f"{W} ORDER BY ts, event_id"
FILLED_SQL = f"""{F_SQL},
ff AS (SELECT event_id, ts, user_id, event_type, props, coalesce(
  last_value(value IGNORE NULLS) OVER ({WO} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(value IGNORE NULLS) OVER ({WO} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM f)"""
Z_SQL = f"""{FILLED_SQL},
z AS (SELECT *, (value - avg(value) OVER ({W})) / nullif(stddev_pop(value) OVER ({W}), 0) AS z FROM ff)"""


def filled(spark, sf):
    return series.fill_forward_backward(chunked(frames(spark, sf)), REC, ORDER, chunk(), ["value"])


def zscored(spark, sf):
    return series.zscore(filled(spark, sf), REC, ["value"], suffix="_z")


@register("fill_forward_backward", f"WITH {FILLED_SQL} SELECT event_id, user_id, event_type, value FROM ff")
def q_fill(spark, sf):
    return filled(spark, sf).select("event_id", "user_id", "event_type", "value")


@register("zscore_series", f"WITH {Z_SQL} SELECT event_id, user_id, event_type, round(z, 6) AS z FROM z")
def q_zscore(spark, sf):
    return zscored(spark, sf).select("event_id", "user_id", "event_type", F.round("value_z", R6).alias("z"))


# per-task resample length (stand-in for the 60 fps sample counts)
TASK_SAMPLES = {"view": 32, "click": 16, "purchase": 8, "signup": 24, "error": 12}


def task_lengths(spark):
    """Literal per-task lookup table (fixed, tiny: broadcast is safe)."""
    return F.broadcast(spark.createDataFrame(list(TASK_SAMPLES.items()), "event_type string, n_samples long"))


_TASK_VALUES = ", ".join(f"('{k}', {v})" for k, v in TASK_SAMPLES.items())


@register("resample_nearest", f"""
WITH {Z_SQL},
p AS (SELECT user_id, event_type, z, row_number() OVER ({WO}) - 1 AS p, count(*) OVER ({W}) AS l FROM z),
n AS (SELECT * FROM (VALUES {_TASK_VALUES}) t(event_type, n)),
g AS (SELECT p.*, n.n FROM p JOIN n USING (event_type))
SELECT user_id, event_type, i, round(z, 6) AS value
FROM (SELECT *, unnest(range((p * n + l - 1) // l, ((p + 1) * n + l - 1) // l)) AS i FROM g)""")
def q_resample(spark, sf):
    """W2 then W3 (z-score before resampling, T2) with per-task N."""
    z = zscored(spark, sf).join(task_lengths(spark), "event_type")
    r = series.resample_nearest(z, REC, ORDER, chunk(), ["value_z"], "n_samples")
    return r.select(*REC, "i", F.round("value_z", R6).alias("value"))


_V_SQL = f"""{F_SQL},
v0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM f WHERE value IS NOT NULL),
v1 AS (SELECT *, value / (k + 1) AS ratio,
   lag(value) OVER ({WO}) AS pv, lag(k) OVER ({WO}) AS pk, lag(value / (k + 1)) OVER ({WO}) AS pr,
   lag(epoch_us(ts)) OVER ({WO}) AS pts FROM v0),
v2 AS (SELECT *, (epoch_us(ts) - pts) / 1e6 AS dt FROM v1),
v AS (SELECT *,
   CASE WHEN pts IS NOT NULL AND dt > 0 THEN (value - pv) / dt ELSE 0.0 END AS va,
   CASE WHEN pts IS NOT NULL AND dt > 0 THEN (k - pk) / dt ELSE 0.0 END AS vb,
   CASE WHEN pts IS NOT NULL AND dt > 0 THEN (ratio - pr) / dt ELSE 0.0 END AS vc FROM v2),
t AS (SELECT *, sqrt(va * va + vb * vb + vc * vc) AS total, k / 100 AS size FROM v),
n AS (SELECT user_id, event_type, count(*) AS total_frames FROM events GROUP BY 1, 2)"""


@register("velocity_summary", f"""
WITH {_V_SQL}
SELECT user_id, event_type, n.total_frames, count(*) AS valid_detections,
  round(count(*) * 100.0 / n.total_frames, 6) AS detection_rate,
  round(CASE WHEN 30 > 0 THEN n.total_frames / 30.0 ELSE 0 END, 6) AS duration_s,
  round(avg(total), 6) AS vel_mean, round(stddev_samp(total), 6) AS vel_std,
  round(min(total), 6) AS vel_min, round(max(total), 6) AS vel_max,
  round(quantile_cont(total, 0.5), 6) AS vel_median, round(quantile_cont(total, 0.25), 6) AS vel_q25,
  round(quantile_cont(total, 0.75), 6) AS vel_q75, round(max(total) - min(total), 6) AS vel_range,
  count(*) FILTER (WHERE total > 100) AS high_movement,
  count(*) FILTER (WHERE total >= 20 AND total <= 100) AS moderate_movement,
  count(*) FILTER (WHERE total < 20) AS low_movement,
  count(*) FILTER (WHERE size >= 0.05 AND size <= 0.25) AS optimal_size,
  count(*) FILTER (WHERE size < 0.05) AS too_small, count(*) FILTER (WHERE size > 0.25) AS too_large,
  round(count(*) FILTER (WHERE size >= 0.05 AND size <= 0.25) * 100.0 / count(*), 6) AS optimal_pct
FROM t JOIN n USING (user_id, event_type) GROUP BY user_id, event_type, n.total_frames""")
def q_velocity_summary(spark, sf):
    """Velocities against the previous valid frame, their
    norm, then one aggregate per recording: eight-number summary, movement
    bands, size compliance, detection rate and duration."""
    fr = frames(spark, sf, "props").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    fr = fr.withColumn("ratio", F.col("value") / (F.col("k") + 1))
    totals = fr.groupBy(*REC).agg(F.count(F.lit(1)).alias("total_frames"))
    v = series.lag_velocity(chunked(fr), REC, ORDER, chunk(), "ts", ["value", "k", "ratio"],
                            valid=F.col("value").isNotNull())
    v = v.withColumns({"total": series.euclid("value_velocity", "k_velocity", "ratio_velocity"),
                       "size": F.col("k") / 100})
    # read for the summary and for the value counts of the quantiles
    return velocity_report(cut_lineage(v.select(*REC, "total", "size")), totals, fps=30.0)


def velocity_report(v, totals, fps: float):
    ok = (F.col("size") >= 0.05) & (F.col("size") <= 0.25)
    g = summary.eight_number(v, REC, "total", "vel_", extra=[
        F.count(F.lit(1)).alias("valid_detections"),
        F.count_if(F.col("total") > 100).alias("high_movement"),
        F.count_if((F.col("total") >= 20) & (F.col("total") <= 100)).alias("moderate_movement"),
        F.count_if(F.col("total") < 20).alias("low_movement"),
        F.count_if(ok).alias("optimal_size"),
        F.count_if(F.col("size") < 0.05).alias("too_small"),
        F.count_if(F.col("size") > 0.25).alias("too_large"),
    ])
    g = attach(g, totals, REC, "inner")
    g = g.withColumns({
        "detection_rate": F.col("valid_detections") * 100.0 / F.col("total_frames"),
        "duration_s": F.col("total_frames") / F.lit(fps) if fps > 0 else F.lit(0.0),
        "optimal_pct": F.col("optimal_size") * 100.0 / F.col("valid_detections"),
    })
    dbl = ["detection_rate", "duration_s", "vel_mean", "vel_std", "vel_min", "vel_max", "vel_median",
           "vel_q25", "vel_q75", "vel_range", "optimal_pct"]
    ints = ["total_frames", "valid_detections", "high_movement", "moderate_movement", "low_movement",
            "optimal_size", "too_small", "too_large"]
    return g.select(*REC, *ints, *[F.round(c, R6).alias(c) for c in dbl])


ROLL_WIDTH = 4  # stand-in recordings hold 3-24 frames; the reference uses 30


@register("rolling_centered", f"""
WITH {FILLED_SQL}
SELECT event_id, round(CASE WHEN count(value) OVER r = {ROLL_WIDTH} THEN avg(value) OVER r ELSE 0 END, 6) AS roll
FROM ff WINDOW r AS ({WO} ROWS BETWEEN {ROLL_WIDTH // 2} PRECEDING AND {ROLL_WIDTH - ROLL_WIDTH // 2 - 1} FOLLOWING)""")
def q_rolling(spark, sf):
    """Centred rolling mean, full windows only, edges -> 0."""
    d = ordered.scan(filled(spark, sf), REC, ORDER, chunk(), pos="pos")
    r = series.centred_rolling_mean(d, REC, "pos", "value", ROLL_WIDTH, out="roll")
    return r.select("event_id", F.round("roll", R6).alias("roll"))


@register("minmax", f"""
WITH {FILLED_SQL}
SELECT event_id, round((value - min(value) OVER ({W})) / nullif(max(value) OVER ({W}) - min(value) OVER ({W}), 0), 6)
  AS value_scaled FROM ff""")
def q_minmax(spark, sf):
    """W11."""
    m = series.minmax_scale(filled(spark, sf), REC, ["value"], suffix="_scaled")
    return m.select("event_id", F.round("value_scaled", R6).alias("value_scaled"))


@register("cumsum_clip", f"""
WITH {Z_SQL}
SELECT event_id, round(least(greatest(sum(z) OVER ({WO} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1), 1), 6)
  AS z_cum FROM z""")
def q_cumsum_clip(spark, sf):
    """Running sum of the z-scored series clipped to [-1, 1]."""
    c = series.cumsum_clip(zscored(spark, sf), REC, ORDER, chunk(), "value_z", -1.0, 1.0, out="z_cum")
    return c.select("event_id", F.round("z_cum", R6).alias("z_cum"))


@register("detrend_linear", f"""
WITH {FILLED_SQL},
p AS (SELECT *, CAST(row_number() OVER ({WO}) - 1 AS DOUBLE) AS t FROM ff)
SELECT event_id, round(value - avg(value) OVER ({W}), 6) AS value_detrend_const,
  round(value - (regr_slope(value, t) OVER ({W}) * t + regr_intercept(value, t) OVER ({W})), 6) AS value_detrend_linear
FROM p""")
def q_detrend(spark, sf):
    """Constant and linear detrend against the frame position."""
    d = ordered.scan(filled(spark, sf), REC, ORDER, chunk(), pos="t").withColumn("t", F.col("t").cast("double"))
    r = series.detrend(d, REC, "t", "value")
    return r.select("event_id", F.round("value_detrend_const", R6).alias("value_detrend_const"),
                    F.round("value_detrend_linear", R6).alias("value_detrend_linear"))


def _residual(y: str, *on: str) -> str:
    """y less its regression on a column that has mean 0 in the recording."""
    return f"{y} - " + " - ".join(f"coalesce(nullif(regr_slope({y}, {c}) OVER ({W}), CAST('nan' AS DOUBLE)), 0) * {c}" for c in on)


@register("detrend_cubic", f"""
WITH {FILLED_SQL},
p0 AS (SELECT *, CAST(row_number() OVER ({WO}) - 1 AS DOUBLE) AS t FROM ff),
p1 AS (SELECT *, (t - avg(t) OVER ({W})) / greatest(max(t) OVER ({W}), 1) AS u FROM p0),
p2 AS (SELECT *, u * u - avg(u * u) OVER ({W}) AS v, u * u * u - avg(u * u * u) OVER ({W}) AS w, value - avg(value) OVER ({W}) AS x0 FROM p1),
p3 AS (SELECT *, {_residual('v', 'u')} AS q2, {_residual('w', 'u')} AS w1, {_residual('x0', 'u')} AS x1 FROM p2),
p4 AS (SELECT *, {_residual('w1', 'q2')} AS q3, {_residual('x1', 'q2')} AS x2 FROM p3)
SELECT event_id, round({_residual('x2', 'q3')}, 6) + 0.0 AS value_detrend_cubic FROM p4""")
def q_detrend_cubic(spark, sf):
    """Cubic detrend against the frame position."""
    d = ordered.scan(filled(spark, sf), REC, ORDER, chunk(), pos="t")
    r = series.detrend_cubic(d, REC, "t", "value")
    return r.select("event_id", (F.round("value_detrend_cubic", R6) + 0.0).alias("value_detrend_cubic"))


@register("interval_histogram", f"""
SELECT CAST(floor(dt / 3600) AS BIGINT) AS dt_hours, count(*) AS n FROM (
  SELECT (epoch_us(ts) - lag(epoch_us(ts)) OVER ({WO})) / 1e6 AS dt FROM events)
WHERE dt IS NOT NULL GROUP BY 1""")
def q_interval_histogram(spark, sf):
    """Distribution of frame intervals (hour buckets)."""
    ev = table(spark, sf, "events", "event_id", "ts", "user_id", "event_type")
    d = series.intervals(chunked(ev), REC, ORDER, chunk(), "ts")
    return d.where(F.col("dt_s").isNotNull()).groupBy(
        F.floor(F.col("dt_s") / 3600).cast("long").alias("dt_hours")).agg(F.count(F.lit(1)).alias("n"))


@register("length_histogram", """
WITH l AS (SELECT event_type, user_id, count(*) AS len FROM events GROUP BY 1, 2),
s AS (SELECT event_type, min(len) AS lo, max(len) AS hi, avg(len) AS mean_len, quantile_cont(len, 0.5) AS median_len
      FROM l GROUP BY 1),
b AS (SELECT l.event_type, CASE WHEN hi = lo THEN 0 ELSE least(floor((len - lo) / ((hi - lo) / 20.0)), 19) END AS bin
      FROM l JOIN s USING (event_type))
SELECT b.event_type, CAST(bin AS INTEGER) AS bin, count(*) AS n, round(any_value(mean_len), 6) AS mean_len,
       round(any_value(median_len), 6) AS median_len
FROM b JOIN s USING (event_type) GROUP BY 1, 2""")
def q_length_histogram(spark, sf):
    """Recording length per task: mean, median and a 20-bin histogram."""
    ev = table(spark, sf, "events", "user_id", "event_type")
    lens = ev.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).cast("double").alias("len"))
    h = summary.histogram(lens, "len", 20, by=["event_type"])
    mid = summary.exact_quantiles(lens, ["event_type"], "len", {"median_len": 0.5})
    st = attach(lens.groupBy("event_type").agg(F.avg("len").alias("mean_len")), mid, "event_type")
    st = st.withColumns({c: F.round(c, R6) for c in ("mean_len", "median_len")})
    return attach(h, st, "event_type", "inner").select("event_type", "bin", "n", "mean_len", "median_len")


@register("score_histogram", """
WITH s AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer),
b AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((c_acctbal - lo) / ((hi - lo) / 20)), 19) END AS INTEGER) AS bin,
             lo, hi FROM customer, s)
SELECT bin, round(any_value(lo + bin * (hi - lo) / 20), 6) AS lo, round(any_value(lo + (bin + 1) * (hi - lo) / 20), 6) AS hi,
       count(*) AS n FROM b GROUP BY bin""")
def q_score_histogram(spark, sf):
    """20 equal-width bins of the score."""
    h = summary.histogram(table(spark, sf, "customer", "c_acctbal"), "c_acctbal", 20)
    return h.select("bin", F.round("lo", R6).alias("lo"), F.round("hi", R6).alias("hi"), "n")


@register("turn_order_check", """
WITH c AS (SELECT conv_id, turn, role, turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS step,
                  CAST(role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS rep
           FROM conversations)
SELECT conv_id, count(*) AS n, min(turn) AS first_value, CAST(coalesce(min(step) >= 0, true) AS INTEGER) AS monotonic,
  max(step) AS max_step, CAST(max(turn) - min(turn) + 1 = count(DISTINCT turn) AS INTEGER) AS contiguous,
  count(*) FILTER (WHERE rep = 1) AS n_role_repeats
FROM c GROUP BY conv_id""")
def q_turn_order(spark, sf):
    """Per conversation, turn order monotonic / gap-free, role repeats."""
    c = table(spark, sf, "conversations", "conv_id", "turn", "role")
    r = series.order_check(c, "conv_id", ["turn"], ordered.int_chunk("turn"), "turn", role="role")
    return r.select("conv_id", "n", "first_value", F.col("monotonic").cast("int").alias("monotonic"), "max_step",
                    F.col("contiguous").cast("int").alias("contiguous"), "n_role_repeats")


# stand-in tasks for the encoders: event type -> task of the fixed task list
EVENT_TASK = {"view": "calibration", "click": "plr", "purchase": "mab", "signup": "mckinnon", "error": "calibration"}


def _field_cols():
    """Stand-in field texts derived from the event's k digits."""
    k = F.get_json_object("props", "$.k").cast("int")
    out = {}
    for i, (f, cats) in enumerate(scalar.MAB_FIELDS.items()):
        out[f] = F.element_at(F.array(*[F.lit(c) for c in cats]), (k / (2 ** i)).cast("int") % len(cats) + 1)
    for i, (f, cats) in enumerate(scalar.MCK_FIELDS.items()):
        out[f] = F.element_at(F.array(*[F.lit(c) for c in cats]), (k / (3 ** i)).cast("int") % len(cats) + 1)
    return out


def _fields_sql():
    parts = []
    for i, (f, cats) in enumerate(scalar.MAB_FIELDS.items()):
        parts.append(f"{list(cats)}[(k // {2 ** i}) % {len(cats)} + 1] AS {f}")
    for i, (f, cats) in enumerate(scalar.MCK_FIELDS.items()):
        parts.append(f"{list(cats)}[(k // {3 ** i}) % {len(cats)} + 1] AS {f}")
    return ", ".join(parts)


_TASKMAP_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_TASK.items()) + " END"
ENC_SQL = f"""e AS (SELECT event_id, {_TASKMAP_SQL} AS task, {_fields_sql()}
  FROM (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


def encoded_events(spark, sf):
    ev = table(spark, sf, "events", "event_id", "event_type", "props")
    task = F.element_at(F.create_map(*[x for kv in EVENT_TASK.items() for x in map(F.lit, kv)]), F.col("event_type"))
    return ev.select("event_id", task.alias("task"), *[c.alias(n) for n, c in _field_cols().items()])


def _code_sql():
    mab = ", ".join(f"list_position({list(c)}, {f}) - 1" for f, c in scalar.MAB_FIELDS.items())
    mck = ", ".join(f"list_position({list(c)}, {f}) - 1" for f, c in scalar.MCK_FIELDS.items())
    return (f"CASE task WHEN 'calibration' THEN [0, 0, 0, 0, 0, 0] WHEN 'plr' THEN [1, 0, 0, 0, 0, 0] "
            f"WHEN 'mab' THEN [2, {mab}] WHEN 'mckinnon' THEN [3, {mck}, 0, 0, 0] END")


@register("task_code_vector", f"""
WITH {ENC_SQL} SELECT event_id, task, array_to_string({_code_sql()}, ',') AS code FROM e""")
def q_task_code_vector(spark, sf):
    """[task, f1..f5] code vector per row, as text."""
    e = encoded_events(spark, sf)
    fields = {f: F.col(f) for f in [*scalar.MAB_FIELDS, *scalar.MCK_FIELDS]}
    return e.select("event_id", "task", F.array_join(scalar.task_code_vector("task", fields), ",").alias("code"))


def _onehot_sql():
    tasks = list(scalar.TASK_CODES)
    cols = ["array_to_string([" + ", ".join(f"CAST(task = '{t}' AS INTEGER)" for t in tasks) + "], ',') AS task_1hot"]
    for tname, fs in scalar.TASK_FIELDS.items():
        for f, cats in fs.items():
            inner = ", ".join(f"CAST({f} = '{c}' AS INTEGER)" for c in cats)
            cols.append(f"CASE WHEN task = '{tname}' THEN array_to_string([{inner}], ',') END AS {f}_1hot")
    return ", ".join(cols)


@register("task_onehot", f"WITH {ENC_SQL} SELECT event_id, {_onehot_sql()} FROM e")
def q_task_onehot(spark, sf):
    """Fixed-category one-hot lists per task, others null (as text)."""
    e = encoded_events(spark, sf)
    fields = {f: F.col(f) for f in [*scalar.MAB_FIELDS, *scalar.MCK_FIELDS]}
    oh = scalar.task_one_hot("task", fields)
    return e.select("event_id", *[F.array_join(c.cast("array<int>"), ",").alias(n) for n, c in oh.items()])


@register("dot_error", f"""
WITH {F_SQL},
p AS (SELECT f.*, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
        c_acctbal / 10 AS true_x, CAST(c_nationkey * 4 AS DOUBLE) AS true_y,
        row_number() OVER ({WO}) - 1 AS pos
      FROM f JOIN customer ON user_id = c_custkey),
g AS (SELECT user_id, event_type,
        avg(CASE WHEN pos >= 5 THEN value END) AS value_mean, stddev_pop(CASE WHEN pos >= 5 THEN value END) AS value_std,
        avg(CASE WHEN pos >= 5 THEN k END) AS k_mean, stddev_pop(CASE WHEN pos >= 5 THEN k END) AS k_std,
        CASE WHEN count(DISTINCT true_x) = 1 THEN min(true_x) END AS tx,
        CASE WHEN count(DISTINCT true_y) = 1 THEN min(true_y) END AS ty,
        greatest(count(DISTINCT true_x), count(DISTINCT true_y)) > 1 AS multi_true
      FROM p GROUP BY 1, 2),
e AS (SELECT *, abs(tx - value_mean) AS ex, abs(ty - k_mean) AS ey FROM g)
SELECT user_id, event_type, round(value_mean, 6) AS value_mean, round(value_std, 6) AS value_std,
  round(k_mean, 6) AS k_mean, round(k_std, 6) AS k_std, round(ex, 6) AS value_error, round(ey, 6) AS k_error,
  CAST(multi_true AS INTEGER) AS multi_true,
  CASE WHEN ex >= 50 OR ey >= 50 THEN 'fail' WHEN ex < 50 AND ey < 50 THEN 'pass' ELSE '' END AS both50,
  CASE WHEN ey >= 50 THEN 'fail' WHEN ey < 50 THEN 'pass' ELSE '' END AS y50,
  CASE WHEN ex >= 100 OR ey >= 100 THEN 'fail' WHEN ex < 100 AND ey < 100 THEN 'pass' ELSE '' END AS both100,
  CASE WHEN ey >= 100 THEN 'fail' WHEN ey < 100 THEN 'pass' ELSE '' END AS y100
FROM e""")
def q_dot_error(spark, sf):
    """Per target skip the first 5 frames, mean / population std
    of the observed coordinates, abs error to the single true position
    (from the subject's dimension row), pass/fail flags at 50 and 100."""
    fr = frames(spark, sf, "props").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    cu = table(spark, sf, "customer", "c_custkey", "c_acctbal", "c_nationkey")
    fr = fr.join(cu, fr.user_id == cu.c_custkey).withColumns({
        "true_x": F.col("c_acctbal") / 10, "true_y": (F.col("c_nationkey") * 4).cast("double")})
    g = series.target_error(chunked(fr), REC, ORDER, chunk(), ["value", "k"], ["true_x", "true_y"], skip=5,
                            thresholds=(50.0, 100.0))
    dbl = ["value_mean", "value_std", "k_mean", "k_std", "value_error", "k_error"]
    return g.select(*REC, *[F.round(c, R6).alias(c) for c in dbl], F.col("multi_true").cast("int").alias("multi_true"),
                    "both50", "y50", "both100", "y100")


@register("recording_quality_filter", f"""
WITH {F_SQL},
q AS (SELECT user_id, event_type, count(*) AS n_rows,
        avg(CAST(value IS NULL AS DOUBLE)) AS value_null_share,
        avg(CAST(nullif(CAST(json_extract_string(props, '$.k') AS INTEGER) % 10, 0) IS NULL AS DOUBLE)) AS k_null_share
      FROM f GROUP BY 1, 2)
SELECT user_id, event_type, n_rows, round(value_null_share, 6) AS value_null_share, round(k_null_share, 6) AS k_null_share
FROM q WHERE greatest(value_null_share, k_null_share) < 0.5""")
def q_quality_filter(spark, sf):
    """F8: keep recordings whose every feature is < 50 % missing (second
    feature: last digit of k, 0 meaning not measured)."""
    fr = frames(spark, sf, "props")
    fr = fr.withColumn("k", F.nullif(F.get_json_object("props", "$.k").cast("int") % 10, F.lit(0)))
    q = series.quality_keep(fr, REC, ["value", "k"])
    return q.select(*REC, "n_rows", F.round("value_null_share", R6).alias("value_null_share"),
                    F.round("k_null_share", R6).alias("k_null_share"))


@register("factorize_codes", """
WITH f AS (SELECT event_type, min((ts, event_id)) AS o FROM events GROUP BY 1)
SELECT event_type, CAST(dense_rank() OVER (ORDER BY o) - 1 AS INTEGER) AS code FROM f""")
def q_factorize(spark, sf):
    """Integer code per value by first appearance."""
    ev = table(spark, sf, "events", "event_type", "ts", "event_id")
    return series.factorize(ev, "event_type", ORDER, out="code").select("event_type", "code").distinct()


@register("truncate_shortest", f"""
WITH p AS (SELECT event_id, event_type, row_number() OVER ({WO}) - 1 AS pos, count(*) OVER ({W}) AS l FROM events),
s AS (SELECT event_type, min(l) AS short FROM p GROUP BY 1)
SELECT event_id FROM p JOIN s USING (event_type) WHERE pos < short""")
def q_truncate(spark, sf):
    """Cut every recording to the shortest recording of its task."""
    ev = table(spark, sf, "events", "event_id", "ts", "user_id", "event_type")
    return series.truncate(chunked(ev), REC, ORDER, chunk(), by=["event_type"]).select("event_id")
