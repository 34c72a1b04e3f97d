"""Ordered-series operators.

A *recording* is a group of rows ordered by a unique order key. Nothing here
uses a ``Window.partitionBy(recording)`` over raw rows: positional scans go
through :mod:`trialframe.operators.ordered` (chunked, skew-safe), bounded
frames (rolling means) run over fixed-size position *blocks* with a halo of
neighbour rows, and whole-recording statistics are aggregates joined back.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialframe.operators import ordered
from trialframe.operators.joins import attach

BLOCK = 4096  # rows per block for bounded-frame windows


def _keys(k) -> list[str]:
    return [k] if isinstance(k, str) else list(k)


# ------------------------------------------------------------------ W1
def fill_forward_backward(df: DataFrame, rec, order, chunk: Column, cols: Sequence[str]) -> DataFrame:
    """``ffill().bfill()`` per recording (leading nulls take the first
    later value; an all-null recording stays null)."""
    sc = ordered.scan(df, rec, order, chunk,
                      ffill={f"_ff_{c}": c for c in cols}, bfill={f"_bf_{c}": c for c in cols})
    return sc.withColumns({c: F.coalesce(F.col(f"_ff_{c}"), F.col(f"_bf_{c}")) for c in cols}).drop(
        *[f"_ff_{c}" for c in cols], *[f"_bf_{c}" for c in cols])


# ------------------------------------------------------------------ W2/W11
def group_stats(df: DataFrame, rec, aggs: dict[str, Column]) -> DataFrame:
    return df.groupBy(*_keys(rec)).agg(*[e.alias(k) for k, e in aggs.items()])


def zscore(df: DataFrame, rec, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """(x - mean) / std with ddof 0 per recording; a constant (or all
    null) series gives null. Stats by aggregate + join back."""
    st = group_stats(df, rec, {**{f"_m_{c}": F.avg(c) for c in cols},
                               **{f"_s_{c}": F.stddev_pop(c) for c in cols}})
    j = attach(df, st, _keys(rec), "inner")
    out = {f"{c}{suffix}": F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.nullif(F.col(f"_s_{c}"), F.lit(0.0)))
           for c in cols}
    return j.withColumns(out).drop(*[f"_m_{c}" for c in cols], *[f"_s_{c}" for c in cols])


def minmax_scale(df: DataFrame, rec, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """(x - min) / (max - min) per recording; zero range -> null."""
    st = group_stats(df, rec, {**{f"_lo_{c}": F.min(c) for c in cols}, **{f"_hi_{c}": F.max(c) for c in cols}})
    j = attach(df, st, _keys(rec), "inner")
    out = {f"{c}{suffix}": F.try_divide(F.col(c) - F.col(f"_lo_{c}"),
                                       F.nullif(F.col(f"_hi_{c}") - F.col(f"_lo_{c}"), F.lit(0.0)))
           for c in cols}
    return j.withColumns(out).drop(*[f"_lo_{c}" for c in cols], *[f"_hi_{c}" for c in cols])


# ------------------------------------------------------------------ W3
def resample_nearest(df: DataFrame, rec, order, chunk: Column, cols: Sequence[str], n_col: str,
                     index: str = "i") -> DataFrame:
    """Resample each recording to ``n_col`` samples by nearest sampling,
    ``out[i] = in[floor(i * L / N)]`` (exact integer arithmetic, L = length).

    No array is built: the row at position p serves every output index i
    with ``p*N <= i*L < (p+1)*N``, i.e. ``i`` in
    ``[ceil(p*N/L), ceil((p+1)*N/L))`` - at most ``ceil(N/L)`` indices, so
    up-sampling emits a bounded number of copies per row."""
    sc = ordered.scan(df, rec, order, chunk, pos="_p", totals={"_L": ("count", None)})
    p, L, N = F.col("_p"), F.col("_L"), F.col(n_col).cast("long")
    lo = F.floor((p * N + L - 1) / L).cast("long")
    hi = F.floor(((p + 1) * N + L - 1) / L).cast("long")  # exclusive
    sc = sc.where(hi > lo)
    idx = F.explode(F.sequence(lo, hi - 1))
    return sc.select(*_keys(rec), idx.alias(index), *cols)


# ------------------------------------------------------------------ W5/W6
def lag_velocity(df: DataFrame, rec, order, chunk: Column, ts: str, cols: Sequence[str],
                 valid: Column | None = None, suffix: str = "_velocity") -> DataFrame:
    """Per valid row, (x - x_prev) / dt against the previous *valid* row
    of the recording; the first valid row and dt <= 0 give 0. Invalid rows
    are dropped first (they never update the previous state)."""
    d = df if valid is None else df.where(valid)
    lags = {f"_prev_{c}": c for c in cols}
    lags["_prev_ts"] = ts
    sc = ordered.scan(d, rec, order, chunk, lag=lags)
    dt = ordered.micros_between("_prev_ts", ts) / 1e6
    out = {}
    for c in cols:
        out[f"{c}{suffix}"] = F.when(F.col("_prev_ts").isNotNull() & (dt > 0),
                                     (F.col(c) - F.col(f"_prev_{c}")) / dt).otherwise(F.lit(0.0))
    return sc.withColumns(out).drop(*lags)


def euclid(*cols: str | Column) -> Column:
    """sqrt(a^2 + b^2 + c^2)."""
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.sqrt(sum((c * c for c in cs[1:]), cs[0] * cs[0]))


# ------------------------------------------------------------------ W7/W19
def skip_first(df: DataFrame, rec, order, chunk: Column, k: int) -> DataFrame:
    """Drop the first ``k`` rows of each group (``series[k:]``)."""
    sc = ordered.scan(df, rec, order, chunk, pos="_p")
    return sc.where(F.col("_p") >= k).drop("_p")


def truncate(df: DataFrame, rec, order, chunk: Column, n: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Keep the first ``n`` rows per recording, or (n=None) the length
    of the shortest recording within ``by`` (e.g. per task)."""
    sc = ordered.scan(df, rec, order, chunk, pos="_p", totals={"_L": ("count", None)})
    if n is not None:
        return sc.where(F.col("_p") < n).drop("_p", "_L")
    per_rec = sc.select(*_keys(rec), *by, "_L").distinct()
    shortest = per_rec.groupBy(*by).agg(F.min("_L").alias("_short"))
    j = attach(sc, shortest, list(by), "inner") if by else sc.withColumn(
        "_short", per_rec.agg(F.min("_L")).scalar())
    return j.where(F.col("_p") < F.col("_short")).drop("_p", "_L", "_short")


# ------------------------------------------------------------------ W10/W18
def rolling(df: DataFrame, rec, pos: str, lo: int, hi: int, aggs: dict[str, Column],
            block: int = BLOCK) -> DataFrame:
    """Bounded row-frame window ``rowsBetween(lo, hi)`` (lo <= 0 <= hi) over
    position ``pos`` without sending a whole recording to one task.

    Rows are cut into blocks of ``block`` positions; a row is copied to every
    block that its neighbours' frames reach (several, if the frame is wider
    than a block), the window runs inside (recording, block), copies are
    dropped."""
    keys = _keys(rec)
    p = F.col(pos)
    b = F.floor(p / block).cast("long")
    # every block that holds a row whose frame reaches this one
    first = F.greatest(F.floor((p - hi) / block), F.lit(0))
    d = df.withColumn("_home", b).withColumn("_blk", F.explode(F.sequence(first, F.floor((p - lo) / block))))
    w = Window.partitionBy(*keys, "_blk").orderBy(pos).rowsBetween(lo, hi)
    d = d.withColumns({k: e.over(w) for k, e in aggs.items()})
    return d.where(F.col("_blk") == F.col("_home")).drop("_blk", "_home")


def centred_rolling_mean(df: DataFrame, rec, pos: str, col: str, width: int = 30, out: str | None = None,
                         fill: float = 0.0, block: int = BLOCK) -> DataFrame:
    """Pandas ``rolling(width, center=True).mean().fillna(fill)``: frame
    ``[-(width//2), width - width//2 - 1]``, full windows of non-null values
    only, everything else -> ``fill``."""
    out = out or f"{col}_roll"
    lo, hi = -(width // 2), width - width // 2 - 1
    r = rolling(df, rec, pos, lo, hi, {"_rs": F.avg(col), "_rn": F.count(col)}, block)
    return r.withColumn(out, F.when(F.col("_rn") == width, F.col("_rs")).otherwise(F.lit(fill))).drop("_rs", "_rn")


# ------------------------------------------------------------------ W12
def cumsum_clip(df: DataFrame, rec, order, chunk: Column, col: str, lo: float, hi: float,
                out: str | None = None) -> DataFrame:
    """Running sum per recording, then clipped to [lo, hi]."""
    out = out or f"{col}_cum"
    sc = ordered.scan(df, rec, order, chunk, cumsum={"_cs": col})
    return sc.withColumn(out, F.least(F.greatest(F.col("_cs"), F.lit(lo)), F.lit(hi))).drop("_cs")


# ------------------------------------------------------------------ W13
def intervals(df: DataFrame, rec, order, chunk: Column, ts: str, out: str = "dt_s") -> DataFrame:
    """Seconds since the previous row of the recording (null on first)."""
    sc = ordered.scan(df, rec, order, chunk, lag={"_pts": ts})
    dt = ordered.micros_between("_pts", ts) / 1e6
    return sc.withColumn(out, dt).drop("_pts")


# ------------------------------------------------------------------ W14
def detrend(df: DataFrame, rec, t: str, col: str) -> DataFrame:
    """Constant (x - mean) and linear (x - (slope*t + intercept)) detrend
    per recording; least squares from ``regr_slope/regr_intercept``
    aggregates, joined back."""
    st = group_stats(df, rec, {"_m": F.avg(col), "_b": F.regr_slope(col, t), "_a": F.regr_intercept(col, t)})
    j = attach(df, st, _keys(rec), "inner")
    return j.withColumns({
        f"{col}_detrend_const": F.col(col) - F.col("_m"),
        f"{col}_detrend_linear": F.col(col) - (F.col("_b") * F.col(t) + F.col("_a")),
    }).drop("_m", "_b", "_a")


def detrend_cubic(df: DataFrame, rec, t: str, col: str) -> DataFrame:
    """X minus its least-squares cubic in ``t``, per recording.

    One aggregate for the centre and width of ``t``, one for the power sums of
    the centred, scaled time u in [-1, 1], both joined back; the fit is solved
    in polynomials that are orthogonal over the recording's own times (from the
    moments of u), so there is no ill-conditioned system. Rows without time or
    value are left out of the fit, and have no residual. A recording with as few
    distinct times as a lower degree needs gets that degree: one time a constant,
    two a line, three a parabola."""
    rec = _keys(rec)
    both = F.col(t).isNotNull() & F.col(col).isNotNull()
    at, x = F.when(both, F.col(t).cast("double")), F.when(both, F.col(col).cast("double"))
    span = df.groupBy(*rec).agg(F.avg(at).alias("_mid"), F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    d = attach(df, span, rec, "left")
    half = F.greatest(F.col("_hi") - F.col("_mid"), F.col("_mid") - F.col("_lo"))
    d = d.withColumn("_u", F.when(half > 0, (at - F.col("_mid")) / half).otherwise(F.when(both, F.lit(0.0)))).drop("_mid", "_lo", "_hi")
    u = F.col("_u")
    power = lambda k: reduce(lambda a, b: a * b, [u] * k)
    sums = d.groupBy(*rec).agg(
        *[F.avg(power(k)).alias(f"_m{k}") for k in range(1, 7)], F.avg(x).alias("_c0"), *[F.avg(power(k) * x).alias(f"_x{k}") for k in range(1, 4)],
    )
    m1, m2, m3, m4, m5, m6, c0, x1, x2, x3 = (F.col(f"_{k}") for k in ("m1", "m2", "m3", "m4", "m5", "m6", "c0", "x1", "x2", "x3"))
    # p1 = u - m1; p2 = u^2 - a p1 - m2; p3 = u^3 - b p2 - g p1 - m3; h: mean squares; c: coefficients
    over = lambda n, h: F.when(h > 1e-12, n / h).otherwise(F.lit(0.0))
    steps = {
        "_h1": m2 - m1 * m1, "_a": over(m3 - m1 * m2, F.col("_h1")), "_c1": over(x1 - m1 * c0, F.col("_h1")),
        "_h2": m4 - F.col("_a") * (m3 - m1 * m2) - m2 * m2,
        "_q": m5 - F.col("_a") * (m4 - m1 * m3) - m2 * m3, "_xp2": x2 - F.col("_a") * (x1 - m1 * c0) - m2 * c0,
        "_b": over(F.col("_q"), F.col("_h2")), "_c2": over(F.col("_xp2"), F.col("_h2")), "_g": over(m4 - m1 * m3, F.col("_h1")),
        "_h3": m6 - F.col("_b") * F.col("_q") - F.col("_g") * (m4 - m1 * m3) - m3 * m3,
        "_c3": over(x3 - F.col("_b") * F.col("_xp2") - F.col("_g") * (x1 - m1 * c0) - m3 * c0, F.col("_h3")),
    }
    for name, value in steps.items():
        sums = sums.withColumn(name, value)
    kept = ["_m1", "_m2", "_m3", "_a", "_b", "_g", "_c0", "_c1", "_c2", "_c3"]
    j = attach(d, sums.select(*rec, *kept), rec, "left")
    p1 = u - m1
    p2 = u * u - F.col("_a") * p1 - m2
    p3 = u * u * u - F.col("_b") * p2 - F.col("_g") * p1 - m3
    return j.withColumn(f"{col}_detrend_cubic", x - c0 - F.col("_c1") * p1 - F.col("_c2") * p2 - F.col("_c3") * p3).drop("_u", *kept)


# ------------------------------------------------------------------ W15
def order_check(df: DataFrame, rec, order, chunk: Column, col: str, role: str | None = None) -> DataFrame:
    """Per recording, is ``col`` non-decreasing along ``order``, its
    largest step, whether it is gap-free, and (optionally) how often the
    same role speaks twice in a row."""
    lags = {"_prev": col}
    if role:
        lags["_prole"] = role
    sc = ordered.scan(df, rec, order, chunk, lag=lags)
    step = F.col(col) - F.col("_prev")
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.min(col).alias("first_value"),
        F.coalesce(F.min(step) >= 0, F.lit(True)).alias("monotonic"),
        F.max(step).alias("max_step"),
        ((F.max(col) - F.min(col) + 1) == F.count_distinct(col)).alias("contiguous"),
    ]
    if role:
        aggs.append(F.count_if(F.col(role) == F.col("_prole")).alias("n_role_repeats"))
    return sc.groupBy(*_keys(rec)).agg(*aggs)


# ------------------------------------------------------------------ W16
def factorize(df: DataFrame, col: str, order: Sequence[str], out: str | None = None) -> DataFrame:
    """Dense integer code by first appearance over the whole table.
    Only the distinct values are ranked, in ranges over many tasks (``order``
    must be unique, so first appearances do not tie)."""
    out = out or f"{col}_code"
    firsts = df.groupBy(col).agg(F.min(F.struct(*[F.col(c) for c in order])).alias("_o"))
    ranked = ordered.scan(ordered.range_chunked(firsts, "_o"), [], ["_o"], F.col("_range"), pos="_p")
    codes = ranked.select(col, F.col("_p").cast("int").alias(out))
    return attach(df, codes, [col], "left")


# ------------------------------------------------------------------ F8
def quality_keep(df: DataFrame, rec, cols: Sequence[str], max_share: float = 0.5) -> DataFrame:
    """F8: recordings whose every feature has < ``max_share`` missing, as
    (rec..., n_rows, <col>_null_share...)."""
    g = df.groupBy(*_keys(rec)).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.avg(F.col(c).isNull().cast("double")).alias(f"{c}_null_share") for c in cols])
    return g.where(F.greatest(*[F.col(f"{c}_null_share") for c in cols], F.lit(-1.0)) < max_share)


def quality_filter(df: DataFrame, rec, cols: Sequence[str], max_share: float = 0.5) -> DataFrame:
    """F8: rows of the kept recordings (semi join)."""
    keep = quality_keep(df, rec, cols, max_share).select(*_keys(rec))
    return attach(df, keep, _keys(rec), "inner")


# ------------------------------------------------------------------ A11
def target_error(df: DataFrame, target, order, chunk: Column, obs: Sequence[str], true: Sequence[str],
                 skip: int = 30, skip_targets: Sequence = (), target_col: str | None = None,
                 thresholds: Sequence[float] = (2.0, 3.0)) -> DataFrame:
    """A11 + W7 + X12: per target skip the first ``skip`` rows, then the
    null-ignoring mean and population std of each observed coordinate, the
    absolute error to the target's single true position (null + flag when a
    target has more than one), and pass/fail flags per threshold."""
    from trialframe.functions.scalar import pass_fail

    d = df
    if skip_targets and target_col:
        d = d.where(~F.col(target_col).isin(list(skip_targets)))
    # skip by position inside the aggregate, so a target with <= skip rows
    # still appears (with null statistics), as the reference's nanmean does
    d = ordered.scan(d, target, order, chunk, pos="_p")
    kept = F.col("_p") >= skip
    aggs = []
    for o in obs:
        v = F.when(kept, F.col(o))
        aggs += [F.avg(v).alias(f"{o}_mean"), F.stddev_pop(v).alias(f"{o}_std")]
    for t in true:
        aggs += [F.min(t).alias(f"_{t}_v"), F.count_distinct(t).alias(f"_{t}_n")]
    g = d.groupBy(*_keys(target)).agg(*aggs)
    out = {}
    errs = []
    for o, t in zip(obs, true):
        single = F.when(F.col(f"_{t}_n") == 1, F.col(f"_{t}_v"))
        out[f"{o}_error"] = F.abs(single - F.col(f"{o}_mean"))
        errs.append(F.col(f"{o}_error"))
    out["multi_true"] = F.greatest(*[F.col(f"_{t}_n") for t in true], F.lit(0)) > 1
    g = g.withColumns(out)
    flags = {}
    for thr in thresholds:
        tag = str(int(thr)) if float(thr).is_integer() else str(thr)
        flags[f"both{tag}"] = pass_fail(F.col(f"{obs[0]}_error"), F.col(f"{obs[-1]}_error"), thr)
        flags[f"y{tag}"] = pass_fail(None, F.col(f"{obs[-1]}_error"), thr)
    return g.withColumns(flags).drop(*[f"_{t}_v" for t in true], *[f"_{t}_n" for t in true])
