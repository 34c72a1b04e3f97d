"""Registry of named queries over the driver tables.

Each query is a ``(spark, sf_dir) -> DataFrame`` callable, optionally paired
with an ANSI SQL string that DuckDB can run over the same parquet tables (the
correctness oracle). Output column names are identical on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import every plan module so its queries register."""
    from trialframe.plans import (  # noqa: F401
        q_wide,
        q_clean,
        q_series,
        q_folds,
        q_metrics,
        q_models,
        q_stream,
        q_more,
        q_fill,
    )
