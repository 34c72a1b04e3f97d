"""Projection, filter and label operators (P*, F*, X9, A15, J7, Q10).

All are ``DataFrame -> DataFrame`` and purely declarative, so Catalyst pushes
the filters into the parquet scan and prunes unused columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band_exclude(df: DataFrame, col: str, threshold: float = 33, buffer: float = 8) -> DataFrame:
    """drop rows whose score lies in the closed band
    [threshold-buffer, threshold+buffer]; rows with a missing score are kept
    (pandas ``~between`` is True for NaN; SQL ``NOT BETWEEN`` would drop them)."""
    lo, hi = threshold - buffer, threshold + buffer
    return df.where(~F.coalesce(F.col(col).between(lo, hi), F.lit(False)))


def filter_cohorts(df: DataFrame, col: str, cohort) -> DataFrame:
    """Int -> equality, list/tuple/set -> membership, "all" -> no filter."""
    if cohort == "all" or cohort is None:
        return df
    if isinstance(cohort, int):
        return df.where(F.col(col) == F.lit(cohort))
    if isinstance(cohort, (list, tuple, set, frozenset)):
        return df.where(F.col(col).isin(list(cohort)))
    raise TypeError(f"cohort must be int, list or 'all', got {type(cohort).__name__}")


def exclude_substrings(df: DataFrame, col: str, needles: Sequence[str]) -> DataFrame:
    """keep rows whose text contains none of ``needles``. A null text
    drops the row (pandas ``~contains`` on NaN is not True)."""
    cond = F.lit(True)
    for n in needles:
        cond = cond & ~F.col(col).contains(n)
    return df.where(cond)


def exclude_values(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """null-safe ``~isin`` (a null value is kept, as in pandas)."""
    return df.where(~F.coalesce(F.col(col).isin(list(values)), F.lit(False)))


def sentinel_to_null(col: str, sentinels: Sequence = (0.0,)) -> Column:
    """numeric sentinel (``0`` / ``"0"``) -> null, as double."""
    c = F.col(col).cast("double")
    for s in sentinels:
        c = F.nullif(c, F.lit(float(s)))
    return c


def map_values(col: str, mapping: dict, otherwise=None) -> Column:
    """Dictionary mapping category -> value, unmapped -> null (or
    ``otherwise``). Written as a CASE chain so it stays in codegen."""
    e = None
    for k, v in mapping.items():
        e = (F.when(F.col(col) == F.lit(k), F.lit(v)) if e is None
             else e.when(F.col(col) == F.lit(k), F.lit(v)))
    if otherwise is not None:
        e = e.otherwise(F.lit(otherwise))
    return e


def good_bad(col: str) -> Column:
    """P7/T12: 'good' -> 1, 'bad' -> 0, '' / null / other -> null."""
    return map_values(col, {"good": 1, "bad": 0}).cast("int")


def dedupe_first(df: DataFrame, key: Sequence[str] | str, order: Sequence[str]) -> DataFrame:
    """One row per key, first by an explicit order. An aggregate
    (min_by over a struct) rather than a row_number window: it is partially
    aggregated map-side, so a hot key never lands whole in one task."""
    key = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in key]
    ordx = F.struct(*[F.col(c) for c in order])
    g = df.groupBy(*key).agg(F.min_by(F.struct(*rest), ordx).alias("_r"))
    return g.select(*key, *[F.col("_r")[c].alias(c) for c in rest])


def latest_per_group(df: DataFrame, key: Sequence[str] | str, order_desc: Sequence[str]) -> DataFrame:
    """Newest row per group (max by ``order_desc``)."""
    key = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in key]
    ordx = F.struct(*[F.col(c) for c in order_desc])
    g = df.groupBy(*key).agg(F.max_by(F.struct(*rest), ordx).alias("_r"))
    return g.select(*key, *[F.col("_r")[c].alias(c) for c in rest])


def drop_missing(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """F7."""
    return df.dropna(subset=list(subset))


def columns_mostly_missing(df: DataFrame, cols: Sequence[str], share: float = 0.5) -> DataFrame:
    """One-row aggregate of null share per column, unpivoted to
    (column, null_count, null_share) and filtered to share > ``share``."""
    stats = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(c).isNull()).alias(f"_z{i}") for i, c in enumerate(cols)],
    )
    stacked = stats.select(
        "_n",
        F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"_z{i}").alias("null_count"))
            for i, c in enumerate(cols)
        ])).alias("s"),
    ).select("s.column", "s.null_count", (F.col("s.null_count") / F.col("_n")).alias("null_share"))
    return stacked.where(F.col("null_share") > share)


def first_token(col: str, sep: str = "_") -> Column:
    """Subject id = text before the first separator."""
    return F.split_part(F.col(col), F.lit(sep), F.lit(1))


def threshold_class(col: str, thr: float = 0.5, strict: bool = False) -> Column:
    """Score -> class as double; ``>=`` by default, ``>`` when strict."""
    c = F.col(col) > thr if strict else F.col(col) >= thr
    return c.cast("double")


def label_join_report(wide: DataFrame, scores: DataFrame, key: str, score: str) -> DataFrame:
    """Q10: one-row matched / unmatched counts of a left join."""
    j = wide.join(scores, key, "left")
    return j.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(score).isNotNull()).alias("n_matched"),
        F.count_if(F.col(score).isNull()).alias("n_unmatched"),
    )


def newest_rank(df: DataFrame, key: Sequence[str], order_desc: Sequence[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*key).orderBy(*order_desc))


def include_exclude(df: DataFrame, col: str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """rows whose name is in ``include`` if that is given (it wins), else
    rows whose name is not in ``exclude``; a null name is in no list."""
    if include:
        return df.where(F.col(col).isin(list(include)))
    if exclude:
        return df.where(~F.coalesce(F.col(col).isin(list(exclude)), F.lit(False)))
    return df


def first_per_type(df: DataFrame, key: Sequence[str], name: str, epoch: Column, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """K7: (key, type, name) of the first item of each type. A rule is (type,
    kind, text): items whose name contains the text belong to the type; kind
    ``earliest`` takes the one with the smallest epoch, ``listed`` the first by
    name. One pass: a row is exploded to the types it belongs to, at most one
    for each rule."""
    each = [F.when(F.col(name).contains(text), F.struct(F.lit(t).alias("type"), (epoch if kind == "earliest" else F.lit(0)).cast("long").alias("at")))
            for t, kind, text in rules]
    d = df.withColumn("_t", F.explode(F.array_compact(F.array(*each))))
    return d.groupBy(*key, F.col("_t.type").alias("type")).agg(F.min(F.struct(F.col("_t.at"), F.col(name)))[name].alias(name))
