"""Feature preparation.

Fit-on-train statistics are computed in LONG form (one row per entity x
feature): a ``groupBy(feature)`` aggregate instead of hundreds of columns in
one aggregate (wide rows defeat whole-stage codegen past ~100 fields).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialframe.operators.joins import attach
from trialframe.operators.summary import exact_quantiles


def to_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], feature: str = "feature",
            value: str = "value") -> DataFrame:
    """Wide -> long with ``unpivot`` (nulls kept: they are to be imputed)."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        list(ids), list(cols), feature, value)


def fit_impute_scale(long: DataFrame, train: Column, feature: str | Sequence[str] = "feature", value: str = "value") -> DataFrame:
    """M10 + M11 fit on the train rows: per feature (or per fold and feature)
    the exact interpolated median (pandas / SimpleImputer semantics), then mean
    and population std (ddof 0) of the *imputed* train values; zero std -> scale 1."""
    by = [feature] if isinstance(feature, str) else list(feature)
    # conditional aggregates instead of a filtered copy: the fit and apply
    # branches then share one identical input subtree, so its shuffle is
    # reused instead of recomputing the upstream plan for the fit
    x = F.when(train, F.col(value))
    med = exact_quantiles(long.select(*by, x.alias("_x")), by, "_x", {"median": 0.5})
    st = long.groupBy(*by).agg(F.count_if(train).alias("_n"), F.count(x).alias("_m"), F.avg(x).alias("_a"),
                                   F.var_pop(x).alias("_v"))
    st = attach(st, med, by, "left")
    # moments of the imputed values from those of the present ones: no second pass over the rows
    gaps = F.col("_n") - F.col("_m")
    mean = (F.col("_m") * F.col("_a") + gaps * F.col("median")) / F.col("_n")
    var = F.col("_m") * (F.col("_v") + F.pow(F.col("_a") - mean, 2)) + gaps * F.pow(F.col("median") - mean, 2)
    st = st.select(*by, "median", mean.alias("mean"), F.sqrt(var / F.col("_n")).alias("std"))
    return st.withColumn("scale", F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std")))


def apply_impute_scale(long: DataFrame, params: DataFrame, feature: str = "feature", value: str = "value",
                       out: str = "value_scaled") -> DataFrame:
    # one row per feature: broadcast, as all long rows would be shuffled before AQE could measure it
    j = attach(long, F.broadcast(params.select(feature, "median", "mean", "scale")), [feature], "inner")
    x = F.coalesce(F.col(value), F.col("median"))
    return j.withColumn(out, (x - F.col("mean")) / F.col("scale")).drop("median", "mean", "scale")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (k * n_c) per class and the negative/positive
    ratio used as a positive-class weight."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    n = df.agg(F.count(F.lit(1))).scalar()
    k = df.agg(F.count_distinct(label)).scalar()
    npos = df.agg(F.count_if(F.col(label) == 1)).scalar()
    nneg = df.agg(F.count_if(F.col(label) == 0)).scalar()
    return g.select(label, "n_c", (n / (k * F.col("n_c"))).alias("weight"),
                    F.try_divide(nneg.cast("double"), npos).alias("pos_weight"))


def with_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Weight column for MLlib ``weightCol``."""
    w = class_weights(df, label).select(label, F.col("weight").alias(out))
    return attach(df, w, [label], "left")


def detect_task(df: DataFrame, target: str, max_classes: int = 10) -> str:
    """M16: 'regression' when the target is floating with non-integral
    values or has more than ``max_classes`` distinct values, else
    'classification'. One small aggregate."""
    dt = df.schema[target].dataType
    r = df.agg(F.count_distinct(target).alias("n"),
               F.count_if(F.col(target) != F.floor(F.col(target))).alias("frac")).first()
    if r["n"] > max_classes:
        return "regression"
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)) and r["frac"] > 0:
        return "regression"
    return "classification"


def feature_columns(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    """Numeric columns not excluded (one exclusion list for ids AND all
    label columns, T26)."""
    num = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, num) and f.name not in exclude]


def good_bad_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Text columns whose non-empty values are a subset of {good, bad}
    (one aggregate that counts the other values)."""
    if not cols:
        return []
    r = df.agg(*[F.count_if(~F.col(c).isin("", "good", "bad")).alias(c) for c in cols]).first()
    return [c for c in cols if not r[c]]


def coerce_numeric(c: str) -> Column:
    """Text -> double, failures -> null (``try_cast``)."""
    return F.col(c).try_cast("double")
