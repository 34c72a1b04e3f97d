"""Extension points.

* D2 analysers: named per-recording analyses. Built-ins are aggregate
  expressions (they run map-side partial, JVM-only). A custom one is a state
  that is updated batch by batch in every task and merged per recording, so no
  recording is gathered; or, where an analysis needs the whole recording at
  once, a grouped pandas function.
* D4 scorers: named metric expressions over confusion-count columns or over
  the values of long predictions, and their ranking.
* D5 status records: run a per-key job step and return (key, status,
  error) rows instead of failing the whole job.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.operators import metrics
from trialframe.operators.joins import attach

# ------------------------------------------------------------------ D2
AggAnalyser = Callable[[], list[Column]]
ANALYSERS: dict[str, AggAnalyser] = {}
PANDAS_ANALYSERS: dict[str, tuple[Callable[[pd.DataFrame], pd.DataFrame], str]] = {}


def analyser(name: str):
    def deco(fn: AggAnalyser) -> AggAnalyser:
        ANALYSERS[name] = fn
        return fn

    return deco


def pandas_analyser(name: str, schema: str):
    """Register a grouped-pandas analyser: fn(pdf of one recording) -> one
    or more result rows with ``schema`` (must include the key columns)."""

    def deco(fn):
        PANDAS_ANALYSERS[name] = (fn, schema)
        return fn

    return deco


@dataclass(frozen=True)
class StateAnalyser:
    """A custom analysis as a mergeable state.

    ``update(state, frames)`` takes any part of a recording, in any order,
    ``merge(a, b)`` joins two states, ``finish(state)`` gives the values of the
    columns of ``schema``. A state must be small; it travels pickled."""

    schema: str
    init: Callable[[], object]
    update: Callable[[object, pd.DataFrame], object]
    merge: Callable[[object, object], object]
    finish: Callable[[object], dict]


STATE_ANALYSERS: dict[str, StateAnalyser] = {}
MAX_HELD_STATES = 10_000


def state_analyser(name: str, schema: str, init, update, merge, finish) -> StateAnalyser:
    """Register a state analyser; ``schema`` are its result columns, without the keys."""
    STATE_ANALYSERS[name] = StateAnalyser(schema, init, update, merge, finish)
    return STATE_ANALYSERS[name]


def run_state_analyser(frames: DataFrame, rec: Sequence[str], a: StateAnalyser) -> DataFrame:
    """One row per recording (null keys included). A task keeps a state for
    each recording it meets and hands on MAX_HELD_STATES at a time, so a hot
    recording is worked on by all tasks that hold some of it, and what meets
    for it in the end is one state for each of them."""
    rec = list(rec)
    keys = ", ".join(f"`{c}` {frames.schema[c].dataType.simpleString()}" for c in rec)

    def handed(held: dict) -> pd.DataFrame:
        out = pd.DataFrame({c: pd.Series([k[i] for k in held], dtype=object) for i, c in enumerate(rec)})
        out["_state"] = [pickle.dumps(s) for s in held.values()]
        return out

    def partial(batches):
        held: dict[tuple, object] = {}
        for pdf in batches:
            for key, part in pdf.groupby(rec, dropna=False, sort=False):
                key = tuple(None if pd.isna(k) else k for k in key)
                held[key] = a.update(held[key] if key in held else a.init(), part)
            if len(held) > MAX_HELD_STATES:
                yield handed(held)
                held = {}
        yield handed(held)

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        states = [pickle.loads(s) for s in pdf["_state"]]
        state = states[0]
        for other in states[1:]:
            state = a.merge(state, other)
        out = pdf[rec].iloc[:1].copy()
        for name, value in a.finish(state).items():
            out[name] = [value]
        return out

    states = frames.mapInPandas(partial, f"{keys}, _state binary")
    return states.groupBy(*rec).applyInPandas(merged, f"{keys}, {a.schema}")


# fixed values: output names and thresholds of the built-in analyses
@analyser("detection")
def _detection() -> list[Column]:
    return [F.count(F.lit(1)).alias("total_frames"),
            F.count_if(F.col("detected")).alias("valid_detections"),
            (F.count_if(F.col("detected")) * 100.0 / F.count(F.lit(1))).alias("detection_rate")]


@analyser("movement")
def _movement() -> list[Column]:
    v = F.col("total_velocity")
    return [F.count_if(v > 100).alias("high_movement_frames"),
            F.count_if((v >= 20) & (v <= 100)).alias("moderate_movement_frames"),
            F.count_if(v < 20).alias("low_movement_frames")]


@analyser("size_compliance")
def _size() -> list[Column]:
    s = F.col("face_size_percentage")
    ok = (s >= 0.05) & (s <= 0.25)
    return [F.count_if(ok).alias("optimal_size_frames"), F.count_if(s < 0.05).alias("too_small_frames"),
            F.count_if(s > 0.25).alias("too_large_frames"),
            (F.count_if(ok) * 100.0 / F.count(F.lit(1))).alias("optimal_size_percentage")]


def run_analysers(frames: DataFrame, rec: Sequence[str], enabled: Sequence[str]) -> DataFrame:
    """Run the enabled analysers: all aggregate ones in ONE groupBy, each
    custom one on its own, joined on the recording key."""
    unknown = [n for n in enabled if n not in ANALYSERS and n not in PANDAS_ANALYSERS and n not in STATE_ANALYSERS]
    if unknown:
        raise KeyError(f"unknown analysers {unknown}")
    aggs = [c for n in enabled if n in ANALYSERS for c in ANALYSERS[n]()]
    out = frames.groupBy(*rec).agg(*aggs) if aggs else frames.select(*rec).distinct()
    for n in enabled:
        if n in PANDAS_ANALYSERS:
            fn, schema = PANDAS_ANALYSERS[n]
            out = out.join(frames.groupBy(*rec).applyInPandas(fn, schema), list(rec), "left")
        elif n in STATE_ANALYSERS:
            out = attach(out, run_state_analyser(frames, rec, STATE_ANALYSERS[n]), rec, "left")
    return out


# ------------------------------------------------------------------ D4
def _div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


SCORERS: dict[str, Callable[[], Column]] = {
    "accuracy": lambda: _div(F.col("tp") + F.col("tn"), F.col("n")),
    "balanced_accuracy": lambda: (_div(F.col("tp"), F.col("tp") + F.col("fn"))
                                  + _div(F.col("tn"), F.col("tn") + F.col("fp"))) / 2,
    "sensitivity": lambda: _div(F.col("tp"), F.col("tp") + F.col("fn")),
    "specificity": lambda: _div(F.col("tn"), F.col("tn") + F.col("fp")),
    "npv": lambda: _div(F.col("tn"), F.col("tn") + F.col("fn")),
}


def scorer(name: str):
    def deco(fn: Callable[[], Column]):
        SCORERS[name] = fn
        return fn

    return deco


def score(confusion: DataFrame, names: Sequence[str]) -> DataFrame:
    return confusion.withColumns({n: SCORERS[n]() for n in names})


# aggregates over long predictions (y_true, predicted, score)
VALUE_SCORERS: dict[str, Callable[[], Column]] = {
    "mse": lambda: F.avg(F.pow(F.col("y_true") - F.col("predicted"), 2)),
    "rmse": lambda: F.sqrt(F.avg(F.pow(F.col("y_true") - F.col("predicted"), 2))),
    "mae": lambda: F.avg(F.abs(F.col("y_true") - F.col("predicted"))),
    "r2": lambda: 1 - F.try_divide(F.sum(F.pow(F.col("y_true") - F.col("predicted"), 2)), F.var_pop("y_true") * F.count("y_true")),
    "brier": lambda: F.avg(F.pow(F.col("y_true") - F.col("score"), 2)),
}
# scores of which the smallest is the best
LOWER_IS_BETTER = {"mse", "rmse", "mae", "brier"}


def value_scorer(name: str, lower_is_better: bool = False):
    def deco(fn: Callable[[], Column]):
        VALUE_SCORERS[name] = fn
        if lower_is_better:
            LOWER_IS_BETTER.add(name)
        return fn

    return deco


def score_values(predictions: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per ``by`` with the named value scores."""
    return predictions.groupBy(*by).agg(*[VALUE_SCORERS[n]().alias(n) for n in names])


def rank_by(scores: DataFrame, name: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank 1 for the best row by a named score (within ``by``), missing scores
    last, ties by ``label``."""
    best = F.asc_nulls_last(name) if name in LOWER_IS_BETTER else F.desc_nulls_last(name)
    return metrics.top_k(scores, list(by), [best, F.asc(label)], 2**31 - 1)


# ------------------------------------------------------------------ D5
def run_with_status(keys: DataFrame, key: str, step: Callable[[str], None]) -> DataFrame:
    """Apply ``step(key)`` to every key in parallel tasks; one row per key:
    (key, status in {success, error}, error message). A failing key does not
    fail the job."""

    def run(batches):
        for pdf in batches:
            status, errors = [], []
            for k in pdf[key]:
                try:
                    step(k)
                    status.append("success")
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - recorded, not raised
                    status.append("error")
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({key: pdf[key], "status": status, "error": errors})

    return keys.select(F.col(key).cast("string").alias(key)).mapInPandas(
        run, f"{key} string, status string, error string")
