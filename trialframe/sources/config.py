"""Cohort-parameterised sources.

A plain nested dict with a ``default`` entry; an unknown cohort falls back
to ``default``; path templates are filled from keyword values. Per-task
lookups are small literal DataFrames (fixed size, so broadcasting them is
safe) joined by task; an unknown task gets null.
"""

from __future__ import annotations

import copy
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: samples of a task's recording at 60 frames a second, and the
# number of trials (time-series samples) of a task
RESAMPLE_60FPS = {"calibration_1": 1650, "calibration_2": 1650, "plr": 480, "face_pairs": 5460, "mckinnon": 1440}
TRIAL_COUNTS = {"face_pairs": 140, "calibration_1": 9, "calibration_2": 9, "plr": 90, "mckinnon": 30}

DEFAULT_CONFIG: dict = {
    "default": {
        "cohort_id": 5,
        "paths": {"sessions": "{root}/sessions/{session_id}.parquet", "output": "{root}/output/{cohort_id}"},
        "tables": {"scores": "scores_primary", "secondary": "scores_secondary", "surveys": "surveys",
                   "completion": "completion"},
        # two SEPARATE per-task maps (T24): resample length at 60 fps, and
        # the number of trials per task
        "resample_60fps": RESAMPLE_60FPS,
        "trial_counts": TRIAL_COUNTS,
        "processing": {"threshold": 33, "buffer": 8, "interp_factor": 1.0},
    },
}


def cohort_config(name: str | None, config: dict | None = None) -> dict:
    """The cohort's settings merged over ``default``."""
    cfg = config or DEFAULT_CONFIG
    base = copy.deepcopy(cfg["default"])
    over = cfg.get(name or "default")
    if over is None:
        return base

    def merge(a, b):
        for k, v in b.items():
            a[k] = merge(a.get(k, {}), v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v
        return a

    return merge(base, copy.deepcopy(over))


def fill_path(template: str, **values) -> str:
    """Fill ``{name}`` fields; a missing field raises KeyError."""
    fields = {f for _, f, _, _ in string.Formatter().parse(template) if f}
    missing = fields - set(values)
    if missing:
        raise KeyError(f"template needs {sorted(missing)}")
    return template.format(**values)


def task_lookup(spark: SparkSession, mapping: dict[str, int], value_name: str) -> DataFrame:
    """(task, value) literal table."""
    return spark.createDataFrame(list(mapping.items()), f"task string, {value_name} long")


def with_task_value(df: DataFrame, spark: SparkSession, mapping: dict[str, int], value_name: str,
                    task_col: str = "task", factor: float | None = None) -> DataFrame:
    """Join a per-task value (unknown task -> null); with
    ``factor`` the value becomes ``int(value * factor)``."""
    lk = task_lookup(spark, mapping, value_name).withColumnRenamed("task", task_col)
    out = df.join(F.broadcast(lk), task_col, "left")
    if factor is not None:
        out = out.withColumn(value_name, (F.col(value_name) * F.lit(factor)).cast("long"))
    return out
