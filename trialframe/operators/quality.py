"""Data-quality operators (Q1-Q10). The reference asserts; we return
violation tables / counts so a job can decide to stop, warn or quarantine,
and every check is one aggregation pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check_name, n_violations) for boolean violation
    predicates, all counted in one scan."""
    one = df.agg(*[F.count_if(p).alias(name) for name, p in checks.items()])
    return one.unpivot([], list(checks), "check_name", "n_violations")


def outside_whitelist(df: DataFrame, col: str, allowed: Sequence[str]) -> DataFrame:
    """Q5: values not in the allowed list, with their counts."""
    return df.where(~F.coalesce(F.col(col).isin(list(allowed)), F.lit(False))).groupBy(col).agg(
        F.count(F.lit(1)).alias("n"))


def group_consistency(df: DataFrame, group: str, label: str, device: str, order: Sequence[str]) -> DataFrame:
    """Q1/Q8: groups carrying more than one label or device; ``first_device``
    is the one used downstream (first row by ``order``)."""
    ordx = F.struct(*[F.col(c) for c in order])
    g = df.groupBy(F.col(group).alias("group_id")).agg(
        F.count_distinct(label).alias("n_labels"),
        F.count_distinct(device).alias("n_devices"),
        F.min_by(F.col(device), ordx).alias("first_device"),
    )
    return g.where((F.col("n_labels") > 1) | (F.col("n_devices") > 1))


def identity_violations(df: DataFrame, group: str, cols: Sequence[str], label: str | None = None) -> DataFrame:
    """Q1: every group must map to one value of each id column, and to at
    most one non-null label."""
    aggs = [F.count_distinct(c).alias(f"n_{c}") for c in cols]
    if label:
        aggs.append(F.count_distinct(label).alias(f"n_{label}"))
    g = df.groupBy(group).agg(*aggs)
    bad = None
    for c in [*cols, *([label] if label else [])]:
        p = F.col(f"n_{c}") > 1
        bad = p if bad is None else bad | p
    return g.where(bad)


def equal_distinct_counts(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Q3: distinct key count per table as (table_name, n) rows."""
    out = None
    for name, df in tables.items():
        r = df.agg(F.count_distinct(key).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = r if out is None else out.unionByName(r)
    return out


def join_adds_no_nulls(left: DataFrame, right: DataFrame, on: str, cols: Sequence[str], new_col: str) -> DataFrame:
    """Q4: nulls in existing columns before vs after a left join, plus nulls
    in the joined column. Both totals are scalar subqueries (no join)."""
    before = left.agg(sum((F.count_if(F.col(c).isNull()) for c in cols), F.lit(0)).alias("n")).scalar()
    j = left.join(right, on, "left")
    return j.agg(
        sum((F.count_if(F.col(c).isNull()) for c in cols), F.lit(0)).alias("nulls_after"),
        F.count_if(F.col(new_col).isNull()).alias("new_col_nulls"),
    ).select(before.alias("nulls_before"), "nulls_after", "new_col_nulls")


def match_report(joined: DataFrame, col: str) -> DataFrame:
    """Q10: matched / unmatched counts after a left join."""
    return joined.agg(F.count_if(F.col(col).isNotNull()).alias("n_matched"),
                      F.count_if(F.col(col).isNull()).alias("n_unmatched"))


def group_leak(folds: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """Groups appearing in more than one fold (must be empty)."""
    g = folds.groupBy(group).agg(F.count_distinct(fold).alias("n_folds"))
    return g.where(F.col("n_folds") > 1)


def schema_diff(df: DataFrame, expected: dict[str, str]) -> list[tuple[str, str, str | None, str | None]]:
    """Q7: (column, problem, expected type, found type) of the columns that
    are missing, extra or of another type; names and types only."""
    found = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = [(c, "missing", t, None) for c, t in expected.items() if c not in found]
    out += [(c, "extra", None, t) for c, t in found.items() if c not in expected]
    return sorted(out + [(c, "type", t, found[c]) for c, t in expected.items() if c in found and found[c] != t])
