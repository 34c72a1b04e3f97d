"""Aggregations and distinct.

Everything is an ordinary ``groupBy().agg()``: Spark runs it as partial
(map-side) + final aggregation, so hot keys are pre-reduced before the
shuffle. Exact percentiles come from value counts, narrowed to the wanted range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialframe.operators.clean import dedupe_first
from trialframe.operators.joins import attach
from trialframe.session import cut_lineage

QUANTILE_CHUNKS = 64
CELL_VALUES = 200_000
# groups of more different values have them merged, but for a share of 1 / REACH at each side of a wanted quantile
MERGED_VALUES = 10_000
REACH = 1000
RECORDING_ROWS = 50_000
QUARTILES = {"median": 0.5, "q25": 0.25, "q75": 0.75}


def dataset_stats(df: DataFrame, subject: str, session: str, label: str, order: Sequence[str]) -> DataFrame:
    """A1 + A2 as long (stat, value) rows: distinct subjects, distinct
    sessions, and the label of each subject's first row counted per class.
    Two independent aggregates stacked with a union (no join needed)."""
    keep = list(dict.fromkeys([subject, label, *order]))
    per_subject = dedupe_first(df.select(*keep), subject, order)
    counts = df.agg(
        F.count_distinct(subject).alias("n_subjects"),
        F.count_distinct(session).alias("n_sessions"),
    )
    bal = per_subject.agg(
        F.count_if(F.col(label) == 1).alias("n_pos"),
        F.count_if(F.col(label) == 0).alias("n_neg"),
    )
    return unpivot_row(counts).unionByName(unpivot_row(bal))


def unpivot_row(df: DataFrame, name: str = "stat", value: str = "value") -> DataFrame:
    """Wide one-row aggregate -> long (stat, value) rows (``stack``)."""
    cols = df.columns
    return df.unpivot([], cols, name, value)


def class_balance(df: DataFrame, entity: str, label: str, order: Sequence[str], dropna: bool = True) -> DataFrame:
    """A2/A3: one row per entity (first wins), then counts per label value
    sorted by value. ``dropna=False`` keeps the missing-label group (A3)."""
    keep = list(dict.fromkeys([entity, label, *order]))
    per = dedupe_first(df.select(*keep), entity, order)
    if dropna:
        per = per.where(F.col(label).isNotNull())
    return per.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(label)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Absolute and normalised counts (share of all rows)."""
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()  # scalar subquery, no join
    return g.withColumn("share", F.col("n") / total)


def mode_smallest(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent value, smallest on ties (pandas ``mode()[0]``)."""
    g = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_n"))
    # highest count, then smallest value (of any orderable type)
    return g.groupBy(*by).agg(F.min_by(F.col(col), F.struct(-F.col("_n"), F.col(col))).alias("mode"))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], most: int = CELL_VALUES) -> DataFrame:
    """Interpolated quantiles per group (pandas semantics), one column for
    each of ``probs``; nulls are ignored, a group without values is absent.

    Values far from the wanted quantiles of a large group are merged (``_merged``),
    then rows are reduced to value counts. A cell is the range of values in which a
    wanted order statistic lies, the whole group at first. As long as a cell
    holds over ``most`` distinct values, a histogram over QUANTILE_CHUNKS ranges
    of it says in which of them the statistic is, and only that range goes on;
    a running count is made inside the last cells only. So no task sorts over
    ``most`` values of a group, however many there are, and the number of
    passes grows with the logarithm of the largest group."""
    by = list(by)
    group = F.struct(F.lit(0).alias("_one"), *[F.col(c) for c in by])
    rows = df.where(F.col(value).isNotNull()).select(group.alias("_g"), F.col(value).alias("_v"))
    counts = _merged(rows, list(probs.values()), max(most, MERGED_VALUES)).groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_n"))
    counts = cut_lineage(counts)
    totals = counts.groupBy("_g").agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_size"))
    place = {name: F.lit(p) * (F.col("_all") - 1) for name, p in probs.items()}
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in place.values() for f in (F.floor, F.ceil)]))
    nothing = F.lit(None).cast(counts.schema["_v"].dataType)
    cells = totals.select("_g", F.explode(ranks).alias("_rank"), nothing.alias("_lo"), nothing.alias("_hi"), F.lit(0).cast("long").alias("_below"), "_size")
    while (cells.agg(F.max("_size")).first()[0] or 0) > most:
        cells = cut_lineage(_refined(counts, cells, most))
    spans = cells.groupBy("_g", "_lo", "_hi").agg(F.collect_list(F.struct("_rank", "_below")).alias("_ranks"))
    inside = _inside(counts, spans)
    run = F.sum("_n").over(Window.partitionBy("_g", "_lo", "_hi").orderBy("_v"))
    hit = F.explode(F.filter("_ranks", lambda r: (r["_below"] + F.col("_run") > r["_rank"]) & (r["_below"] + F.col("_run") - F.col("_n") <= r["_rank"])))
    found = inside.withColumn("_run", run).select("_g", "_v", hit.alias("_hit")).select("_g", "_v", F.col("_hit._rank").alias("_rank"))
    ends, out = [], []
    for name, x in place.items():
        ends += [F.max(F.when(F.col("_rank") == F.floor(x), F.col("_v"))).alias(f"_lo_{name}"), F.max(F.when(F.col("_rank") == F.ceil(x), F.col("_v"))).alias(f"_hi_{name}")]
        share = x - F.floor(x)
        out.append((F.col(f"_lo_{name}") + share * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))).alias(name))
    ends = found.join(totals.select("_g", "_all"), "_g").groupBy("_g", "_all").agg(*ends)
    return ends.select(*[F.col("_g")[c].alias(c) for c in by], *out)


def _merged(rows: DataFrame, probs: Sequence[float], most: int) -> DataFrame:
    """The rows, with the values of groups of over ``most`` different ones (about)
    that lie between the wanted quantiles merged, so that few are left.

    Around each quantile the values between two approximate quantiles stay; any
    other becomes the end of such a range next below it (of the first range, if
    it lies below all). That keeps the order, so an order statistic that lies in a
    range stays what it is; and the wanted ones do, as the ranges reach ten times
    further than the error that Spark grants for the approximate quantiles."""
    large = cut_lineage(rows.groupBy("_g").agg(F.approx_count_distinct("_v").alias("_size")).where(F.col("_size") > most))
    if large.isEmpty():
        return rows
    ends = [min(1.0, max(0.0, p + d / REACH)) for p in probs for d in (-1, 1)]
    hot = rows.join(F.broadcast(large.select(F.col("_g").alias("_of"))), F.col("_g") == F.col("_of"), "left_semi")
    cuts = cut_lineage(hot.groupBy("_g").agg(F.percentile_approx("_v", ends, 10 * REACH).alias("_e")))
    j = rows.join(F.broadcast(cuts.withColumnRenamed("_g", "_of")), F.col("_g") == F.col("_of"), "left")
    v, e = F.col("_v"), [F.get("_e", F.lit(k)) for k in range(len(ends))]
    stays = F.lit(False)
    for low, high in zip(e[::2], e[1::2]):
        stays |= v.between(low, high)
    below = F.coalesce(F.greatest(*[F.when(x <= v, x) for x in e]), F.least(*e))
    return j.select("_g", F.when(F.col("_e").isNull() | stays, v).otherwise(below).alias("_v"))


def _inside(counts: DataFrame, spans: DataFrame) -> DataFrame:
    """The value counts that lie in a span (_lo, _hi] of their group, null for no bound."""
    j = counts.join(spans, "_g")
    return j.where((F.col("_lo").isNull() | (F.col("_v") > F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_v") <= F.col("_hi"))))


def _refined(counts: DataFrame, cells: DataFrame, most: int) -> DataFrame:
    """The cells over ``most`` values narrowed to one of QUANTILE_CHUNKS ranges."""
    key = ["_g", "_lo", "_hi"]
    large = cells.where(F.col("_size") > most)
    rows = _inside(counts, large.select(*key).distinct())
    cuts = rows.groupBy(*key).agg(F.percentile_approx("_v", [k / QUANTILE_CHUNKS for k in range(1, QUANTILE_CHUNKS)], 1000).alias("_cuts"))
    rows = attach(rows, cuts, key, "inner")
    chunk = F.array_size(F.array_compact(F.transform("_cuts", lambda c: F.when(c < F.col("_v"), c))))
    bars = rows.groupBy(*key, chunk.alias("_q")).agg(F.sum("_n").alias("_in"), F.count(F.lit(1)).alias("_m"), F.max("_v").alias("_top"))
    order = Window.partitionBy(*key).orderBy("_q")
    bars = bars.withColumns({"_to": F.sum("_in").over(order), "_bottom": F.lag("_top").over(order)}).withColumnsRenamed({k: f"_of{k}" for k in key})
    same = (F.col("_g") == F.col("_of_g")) & F.col("_lo").eqNullSafe(F.col("_of_lo")) & F.col("_hi").eqNullSafe(F.col("_of_hi"))
    here = (F.col("_below") + F.col("_to") > F.col("_rank")) & (F.col("_below") + F.col("_to") - F.col("_in") <= F.col("_rank"))
    narrowed = large.join(bars, same).where(here).select(
        "_g", "_rank", F.coalesce("_bottom", "_lo").alias("_lo"), F.col("_top").alias("_hi"),
        (F.col("_below") + F.col("_to") - F.col("_in")).alias("_below"), F.col("_m").alias("_size"),
    )
    return cells.where(F.col("_size") <= most).unionByName(narrowed)


def eight_number(df: DataFrame, by: Sequence[str], col: str, prefix: str = "", extra: Sequence[Column] = ()) -> DataFrame:
    """A5: mean, std (ddof 1), min, max, median, q25, q75, range (and any
    ``extra`` aggregates) per group; exact interpolated percentiles."""
    base = df.groupBy(*by).agg(
        *extra, F.avg(col).alias(f"{prefix}mean"), F.stddev_samp(col).alias(f"{prefix}std"),
        F.min(col).alias(f"{prefix}min"), F.max(col).alias(f"{prefix}max"),
    )
    q = exact_quantiles(df, by, col, {f"{prefix}{k}": p for k, p in QUARTILES.items()})
    return attach(base, q, by, "left").withColumn(f"{prefix}range", F.col(f"{prefix}max") - F.col(f"{prefix}min"))


def set_membership(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Key -> bitmask of the sources containing it, in ONE shuffle
    (union of (key, bit) then ``bit_or`` per key, partially aggregated)."""
    parts = None
    for i, (name, df) in enumerate(sources.items()):
        p = df.select(F.col(key).alias("key"), F.lit(1 << i).alias("bit"))
        parts = p if parts is None else parts.unionByName(p)
    return parts.groupBy("key").agg(F.bit_or("bit").alias("mask"))


def intersection_report(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Counts per source, per pair with the first source, and of the full
    intersection (the reference prints these after each intersect)."""
    m = set_membership(sources, key)
    names = list(sources)
    aggs = [F.count_if(F.col("mask").bitwiseAND(1 << i) != 0).alias(f"n_{n}") for i, n in enumerate(names)]
    full = (1 << len(names)) - 1
    for i, n in enumerate(names[1:], start=1):
        both = 1 | (1 << i)
        aggs.append(F.count_if(F.col("mask").bitwiseAND(both) == both).alias(f"n_{names[0]}_{n}"))
    aggs.append(F.count_if(F.col("mask") == full).alias("n_all"))
    return m.agg(*aggs)


def histogram(df: DataFrame, col: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins between min and max (per group), numpy
    convention: the max value falls in the last bin. Returns (by..., bin,
    lo, hi, n) for non-empty bins."""
    if by:
        b = df.groupBy(*by).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
        j = attach(df, b, list(by), "inner")
    else:  # global range: one scalar subquery, no join at all
        rng = df.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi"))).scalar()
        j = df.withColumns({"_lo": rng["lo"], "_hi": rng["hi"]})
    width = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    idx = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col(col) - F.col("_lo")) / width), F.lit(bins - 1))
    ).cast("int")
    j = j.where(F.col(col).isNotNull()).withColumn("bin", idx)
    return j.groupBy(*by, "bin").agg(
        F.first(F.col("_lo") + F.col("bin") * width).alias("lo"),
        F.first(F.col("_lo") + (F.col("bin") + 1) * width).alias("hi"),
        F.count(F.lit(1)).alias("n"),
    )


def signal_summary(df: DataFrame, rec: Sequence[str], signals: Sequence[str], most: int = RECORDING_ROWS) -> DataFrame:
    """The eight numbers of each signal of a recording, long form.

    The rows are shuffled once and wide, by recording, and the values of a
    recording sorted where they meet. Recordings of over ``most`` rows go
    unpivoted through ``eight_number``, which holds no group whole."""
    rec = list(rec)
    d = df.select(*rec, *[F.col(c).cast("double").alias(c) for c in signals])
    hot = cut_lineage(d.groupBy(*rec).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > most).select(*[F.col(c).alias(f"_{c}") for c in rec]))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in rec]
    some = not hot.isEmpty()
    met = (d.join(F.broadcast(hot), same, "left_anti") if some else d).repartition(*rec).groupBy(*rec).agg(*[
        f(c).alias(f"{c}_{name}") for c in signals
        for name, f in (("n", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max), ("all", lambda c: F.sort_array(F.collect_list(c))))
    ])
    each = F.explode(F.array(*[
        F.struct(F.lit(c).alias("signal"), *[F.col(f"{c}_{k}").alias(k) for k in ("n", "mean", "std", "min", "max", "all")]) for c in signals
    ]))
    out = met.select(*rec, each.alias("_s")).select(*rec, "_s.*")
    out = out.select(*rec, "signal", "n", "mean", "std", "min", "max", *[_at(F.col("all"), p).alias(k) for k, p in QUARTILES.items()])
    out = out.withColumn("range", F.col("max") - F.col("min"))
    if some:
        long = d.join(F.broadcast(hot), same, "left_semi").unpivot(rec, list(signals), "signal", "v")
        out = out.unionByName(eight_number(long, [*rec, "signal"], "v", extra=[F.count("v").alias("n")]))
    return out


def _at(values: Column, p: float) -> Column:
    """The interpolated quantile of a sorted array, null if it is empty."""
    x = F.lit(p) * (F.size(values) - 1)
    low, high = (F.get(values, f(x).cast("int")) for f in (F.floor, F.ceil))
    return low + (x - F.floor(x)) * (high - low)


def status_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per status and their share of all."""
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / g.agg(F.sum("n")).scalar())


def column_families(df: DataFrame, pattern: str = r"^trial\d+_(.+)$") -> DataFrame:
    """Number of columns of each family (group 1 of ``pattern``) and how
    many trials they cover, from the column names alone."""
    names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "name string")
    family = F.regexp_extract("name", pattern, 1)
    return names.where(family != "").groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("n_columns"))
