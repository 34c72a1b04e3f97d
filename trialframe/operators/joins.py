"""Joins (J1-J16) and their scale guards.

Spark picks the physical join. What we add:

* ``attach``: join a per-key table back to rows, null keys included; AQE
  converts it to a broadcast after measuring the small side, or splits a
  skewed key.
* anti/semi joins for incremental processing (J8-J11) and partial updates
  (J15) as left join + coalesce.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.functions import names


def attach(rows: DataFrame, per_key: DataFrame, on: Sequence[str] | str, how: str = "left") -> DataFrame:
    """Join a per-key table back to rows. A null key matches the null key, so
    no row of a null group is lost. No hint: AQE broadcasts the small side
    once it has measured it, and splits a hot key otherwise."""
    keys = [on] if isinstance(on, str) else list(on)
    right = per_key.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return rows.join(right, same, how).drop(*[f"__{k}" for k in keys])


def not_yet_processed(candidates: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates without a processed row (left anti join)."""
    return candidates.join(done.select(*keys), list(keys), "left_anti")


def without_output(candidates: DataFrame, path: str, outputs: DataFrame, output_path: str, mark: str = "_analysis_") -> DataFrame:
    """Candidates for which no output ``{stem}{mark}...`` is there, by the
    stem derived from both names. A null path has no output and stays."""
    stem = names.strip_ext(names.base_name(path))
    made = F.element_at(F.split(names.base_name(output_path), re.escape(mark)), 1)
    done = outputs.where(names.base_name(output_path).contains(mark)).select(made.alias("__stem")).distinct()
    return candidates.join(done, stem == F.col("__stem"), "left_anti")


def changed_or_new(listing: DataFrame, local: DataFrame, keys: Sequence[str] = ("name", "size")) -> DataFrame:
    """Re-fetch when no local copy with the same (name, size) exists."""
    return listing.join(local.select(*keys), list(keys), "left_anti")


def restrict_to(df: DataFrame, keys: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Semi join to a key list (never an IN string)."""
    return df.join(keys, on, "left_semi")


def fill_missing_from(df: DataFrame, other: DataFrame, on: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Only null cells of ``cols`` are filled from ``other`` (keyed,
    never positional)."""
    o = other.select(*on, *[F.col(c).alias(f"_new_{c}") for c in cols])
    j = df.join(o, list(on), "left")
    return j.withColumns({c: F.coalesce(F.col(c), F.col(f"_new_{c}")) for c in cols}).drop(
        *[f"_new_{c}" for c in cols])


def mirror_by_group_range(df: DataFrame, group: str | Sequence[str], col: str, out: str) -> DataFrame:
    """out = -col + (max(col) - min(col)) per group, nulls ignored; an
    all-null group stays null. Group range by aggregate + join (no window, so
    a hot group is partially aggregated instead of landing in one task)."""
    g = [group] if isinstance(group, str) else list(group)
    r = df.groupBy(*g).agg((F.max(col) - F.min(col)).alias("_range"))
    return attach(df, r, g, "inner").withColumn(out, -F.col(col) + F.col("_range")).drop("_range")


def last_value_lookup(df: DataFrame, key: str, value_cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Key -> values of its last row by ``order`` (dict(zip) last wins)."""
    ordx = F.struct(*[F.col(c) for c in order])
    g = df.groupBy(key).agg(F.max_by(F.struct(*value_cols), ordx).alias("_v"))
    return g.select(key, *[F.col("_v")[c].alias(c) for c in value_cols])


def metric_delta(a: DataFrame, b: DataFrame, on: Sequence[str], metric_cols: Sequence[str],
                 suffixes=("_a", "_b")) -> DataFrame:
    """Join two run variants by model, difference per metric."""
    sa = a.select(*on, *[F.col(c).alias(c + suffixes[0]) for c in metric_cols])
    sb = b.select(*on, *[F.col(c).alias(c + suffixes[1]) for c in metric_cols])
    j = sa.join(sb, list(on), "inner")
    return j.withColumns({f"{c}_delta": F.col(c + suffixes[1]) - F.col(c + suffixes[0]) for c in metric_cols})


def wide_merge(parts: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """P5: full outer merge of several per-key tables; keys once, every other
    column under its source's prefix. All joins share the key partitioning.
    Null keys merge with null keys."""
    out = None
    for prefix, df in parts.items():
        part = df.select(*keys, *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in keys])
        if out is None:
            out = part
            continue
        right = part.withColumnsRenamed({k: f"__{k}" for k in keys})
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
        both = out.join(right, same, "full")
        out = both.withColumns({k: F.coalesce(k, f"__{k}") for k in keys}).drop(*[f"__{k}" for k in keys])
    return out


def attach_stats(rows: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Left join of recording-level stats; a column that both sides have
    is taken from the stats, and rows without stats stay."""
    clash = [c for c in stats.columns if c in rows.columns and c != key]
    return attach(rows.drop(*clash), stats, key, "left")
