"""Skew-safe ordered scans inside groups.

A plain ``Window.partitionBy(recording).orderBy(ts)`` sends a whole recording
to one task; if one recording holds a third of all rows, that task holds a
third of the data. Every ordered operator in this package goes through
:func:`scan` instead, which works in two levels:

1. rows are cut into *chunks*: contiguous runs of the order, given by a
   column that never decreases along the order (a time bucket of the
   timestamp, or ``floor(turn / width)``). Local windows run over
   ``(group, chunk)`` so no task sees more than one chunk of one group;
2. each chunk is summarised (count, sum, last non-null, last row ...) into a
   small table, one row per ``(group, chunk)``; windows over that table give
   the value carried into each chunk from the chunks before (or after) it;
3. the carry is joined back on ``(group, chunk)``. The big side is already
   partitioned on exactly those keys by step 1, so the join does not
   reshuffle it, and AQE broadcasts the summary when it measures it small.

Supported scans: 0-based position, running sum, forward/backward fill, lag
(previous row), lead (next row), plus group-wide totals (count/sum/min/max).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Default chunk for timestamp-ordered series: one day of a recording.
DAY_MICROS = 86_400_000_000
# rows of a group in one chunk, ranges that a larger bucket is cut into, and the column of even_chunks
CHUNK_ROWS = 250_000
MAX_RANGES = 5000
CHUNK = "_ck"


def epoch_micros(ts_col: str | Column) -> Column:
    """Microseconds since 1970-01-01 00:00 of a ``timestamp_ntz`` column as
    pure wall-clock arithmetic, so the session time zone never changes the
    value (``cast(ntz as timestamp)`` would)."""
    c = F.col(ts_col) if isinstance(ts_col, str) else ts_col
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)


def micros_between(start: str | Column, end: str | Column) -> Column:
    """end - start in microseconds (exact for timestamp and timestamp_ntz)."""
    s = F.col(start) if isinstance(start, str) else start
    e = F.col(end) if isinstance(end, str) else end
    return F.timestamp_diff("MICROSECOND", s, e)


def time_chunk(ts_col: str, width_micros: int = DAY_MICROS) -> Column:
    """Chunk id for a timestamp / timestamp_ntz order column."""
    return F.floor(epoch_micros(ts_col) / F.lit(width_micros)).cast("long")


def int_chunk(col: str, width: int = 4096) -> Column:
    """Chunk id for an integer order column (turn number, row number)."""
    return F.floor(F.col(col) / F.lit(width)).cast("long")


def range_chunked(df: DataFrame, order: Sequence[str] | str, out: str = "_range") -> DataFrame:
    """Rows with a chunk id taken from the data: the number of the range
    partition of a global sort, whose bounds Spark samples. However the values
    are spread, chunks are about even. Written to the shared checkpoint
    folder, so that the ids are the same wherever they are read."""
    from trialframe.session import cut_lineage

    return cut_lineage(df.orderBy(*_cols(order)).withColumn(out, F.spark_partition_id()))


def even_chunks(
    df: DataFrame, keys: Sequence[str] | str, ts: str, out: str = CHUNK, width_micros: int = DAY_MICROS, most: int = CHUNK_ROWS
) -> DataFrame:
    """``df`` with a chunk column for :func:`scan`: the time bucket of ``ts``,
    and where a bucket of a group holds over ``most`` rows, the number of a
    range of times within it. The bounds of those ranges are quantiles of the
    bucket's own times, so a recording whose frames all fall in one day is
    split like any other. One count per bucket decides; without a large bucket
    nothing more is done. Rows of one instant stay together; there are at most
    MAX_RANGES ranges in a bucket."""
    keys = _cols(keys)
    d = df.withColumn(out, time_chunk(ts, width_micros))
    bucket = F.struct(*keys, out)
    large = d.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > most)
    largest = large.agg(F.max("_rows")).first()[0]
    if largest is None:
        return d
    n = min(MAX_RANGES, 2 * -(-largest // most))
    of_large = d.join(large.select("_bucket"), bucket == F.col("_bucket"), "left_semi")
    cuts = of_large.groupBy(bucket.alias("_bucket")).agg(
        F.array_distinct(F.percentile_approx(epoch_micros(ts), [k / n for k in range(1, n)], 100 * n)).alias("_cuts"))
    j = d.join(cuts, bucket == F.col("_bucket"), "left")
    part = F.coalesce(F.size(F.filter("_cuts", lambda c: c < epoch_micros(ts))), F.lit(0))
    return j.withColumn(out, F.struct(F.col(out).alias("bucket"), part.alias("part"))).drop("_bucket", "_cuts")


def _cols(xs: Sequence[str] | str) -> list[str]:
    return [xs] if isinstance(xs, str) else list(xs)


def scan(
    df: DataFrame,
    keys: Sequence[str] | str,
    order: Sequence[str] | str,
    chunk: Column,
    *,
    pos: str | None = None,
    cumsum: dict[str, str] | None = None,
    ffill: dict[str, str] | None = None,
    bfill: dict[str, str] | None = None,
    lag: dict[str, str] | None = None,
    lead: dict[str, str] | None = None,
    totals: dict[str, tuple[str, str | None]] | None = None,
) -> DataFrame:
    """Add ordered-scan columns to ``df``.

    Each dict maps *output column* -> *input column* (``totals`` maps output
    column -> ``(kind, input column)`` with kind one of count/sum/min/max,
    e.g. ``{"n": ("count", None), "mx": ("max", "v")}``; only decomposable
    aggregates, because they are combined from chunk partials).
    """
    keys, order = _cols(keys), _cols(order)
    cumsum, ffill, bfill = cumsum or {}, ffill or {}, bfill or {}
    lag, lead, totals = lag or {}, lead or {}, totals or {}

    # group and (group, chunk) as structs: a struct of nulls is no null and
    # equals another, so rows with a null key or a null chunk take part
    ck, grp, part = "_chunk", "_grp", ["_part"]
    ordx = F.struct(*[F.col(c) for c in order])
    d = df.withColumn(ck, chunk).withColumn("_ord", ordx)
    d = d.withColumn("_part", F.struct(*keys, ck))

    w_loc = Window.partitionBy(*part).orderBy(*order)
    w_run = w_loc.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w_rest = w_loc.rowsBetween(Window.currentRow, Window.unboundedFollowing)

    # ---- level 1: local scans inside (group, chunk)
    loc = {"_lrn": F.row_number().over(w_loc) - 1}
    for out, c in cumsum.items():
        loc[f"_ls_{out}"] = F.sum(c).over(w_run)
    for out, c in ffill.items():
        loc[f"_lf_{out}"] = F.last(c, ignorenulls=True).over(w_run)
    for out, c in bfill.items():
        loc[f"_lb_{out}"] = F.first(c, ignorenulls=True).over(w_rest)
    for out, c in lag.items():
        loc[f"_lg_{out}"] = F.lag(c).over(w_loc)
    for out, c in lead.items():
        loc[f"_ld_{out}"] = F.lead(c).over(w_loc)
    d = d.withColumns(loc)

    # ---- level 2: one summary row per (group, chunk)
    summ = {"_cnt": F.count(F.lit(1))}
    for out, c in cumsum.items():
        summ[f"_cs_{out}"] = F.sum(c)
    for out, c in ffill.items():
        summ[f"_cf_{out}"] = F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_ord")))
    for out, c in bfill.items():
        summ[f"_cb_{out}"] = F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_ord")))
    for out, c in lag.items():
        summ[f"_cg_{out}"] = F.max_by(F.col(c), F.col("_ord"))
    for out, c in lead.items():
        summ[f"_cd_{out}"] = F.min_by(F.col(c), F.col("_ord"))
    for out, (kind, c) in totals.items():
        summ[f"_ct_{out}"] = _PARTIAL[kind](F.lit(1) if c is None else F.col(c))
    s = d.groupBy(*part).agg(*[v.alias(k) for k, v in summ.items()])

    s = s.withColumn(grp, F.struct(F.lit(0).alias("_all"), *[F.col("_part")[k].alias(k) for k in keys])).withColumn(ck, F.col("_part")[ck])
    w_c = Window.partitionBy(grp).orderBy(ck)
    w_before = w_c.rowsBetween(Window.unboundedPreceding, -1)
    w_after = w_c.rowsBetween(1, Window.unboundedFollowing)
    w_all = Window.partitionBy(grp)
    carry = {"_pc": F.coalesce(F.sum("_cnt").over(w_before), F.lit(0))}
    for out in cumsum:
        carry[f"_pcs_{out}"] = F.sum(f"_cs_{out}").over(w_before)
    for out in ffill:
        carry[f"_pcf_{out}"] = F.last(f"_cf_{out}", ignorenulls=True).over(w_before)
    for out in bfill:
        carry[f"_pcb_{out}"] = F.first(f"_cb_{out}", ignorenulls=True).over(w_after)
    for out in lag:
        carry[f"_pcg_{out}"] = F.lag(f"_cg_{out}").over(w_c)
    for out in lead:
        carry[f"_pcd_{out}"] = F.lead(f"_cd_{out}").over(w_c)
    for out, (kind, _) in totals.items():
        carry[f"_pct_{out}"] = _FINAL[kind](f"_ct_{out}").over(w_all)
    s = s.select(*part, "_cnt", *[v.alias(k) for k, v in carry.items()])

    # ---- level 3: join the carry back on (group, chunk)
    j = d.join(s, part, "inner")
    res = {}
    if pos:
        res[pos] = (F.col("_pc") + F.col("_lrn")).cast("long")
    for out in cumsum:
        prev, here = F.col(f"_pcs_{out}"), F.col(f"_ls_{out}")
        res[out] = F.coalesce(prev + here, here, prev)
    for out in ffill:
        res[out] = F.coalesce(F.col(f"_lf_{out}"), F.col(f"_pcf_{out}"))
    for out in bfill:
        res[out] = F.coalesce(F.col(f"_lb_{out}"), F.col(f"_pcb_{out}"))
    for out in lag:
        res[out] = F.when(F.col("_lrn") == 0, F.col(f"_pcg_{out}")).otherwise(F.col(f"_lg_{out}"))
    for out in lead:
        res[out] = F.when(F.col("_lrn") == F.col("_cnt") - 1, F.col(f"_pcd_{out}")).otherwise(F.col(f"_ld_{out}"))
    for out in totals:
        res[out] = F.col(f"_pct_{out}")
    j = j.withColumns(res)
    drop = [c for c in j.columns if c.startswith("_") and c not in df.columns and c not in res]
    return j.drop(*drop)


_PARTIAL = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
_FINAL = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
