"""Exact quantiles by narrowing, with a hot group."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialframe.operators import summary

PROBS = {"low": 0.0, "q25": 0.25, "median": 0.5, "q99": 0.99, "high": 1.0}


def data(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", float(v)) for v in np.round(rng.normal(size=4000), 3)]
    rows += [("hot", 0.5)] * 700 + [("tie", 2.0)] * 9 + [("one", -1.0), ("two", 1.0), ("two", 4.0), ("none", None)]
    rows += [(None, float(v)) for v in range(10)] + [("hot", None)] * 5
    return rows, spark.createDataFrame(rows, "g string, v double").repartition(7)


@pytest.mark.parametrize("most", [200_000, 50, 3])
def test_quantiles_at_any_cell_size(spark, most):
    rows, df = data(spark)
    pdf = pd.DataFrame(rows, columns=["g", "v"]).dropna(subset="v")
    want = {k: g["v"].quantile(list(PROBS.values())).tolist() for k, g in pdf.groupby("g", dropna=False)}
    got = {r["g"]: [r[n] for n in PROBS] for r in summary.exact_quantiles(df, ["g"], "v", PROBS, most).collect()}
    assert {k if isinstance(k, str) else None: pytest.approx(v) for k, v in want.items()} == got
    every = summary.exact_quantiles(df, [], "v", {"m": 0.3}, most).collect()
    assert every[0]["m"] == pytest.approx(pdf["v"].quantile(0.3)) and len(every) == 1
    assert summary.exact_quantiles(df.limit(0), ["g"], "v", PROBS, most).collect() == []


def test_no_cell_holds_more_than_its_limit(spark, monkeypatch):
    _, df = data(spark)
    sizes = []
    inside = summary._inside

    def seen(counts, spans):
        out = inside(counts, spans)
        if "_ranks" in spans.columns:  # the last cells, those that are sorted
            sizes.append(out.groupBy("_g", "_lo", "_hi").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(summary, "_inside", seen)
    summary.exact_quantiles(df, ["g"], "v", PROBS, 40).collect()
    assert sizes and max(sizes) <= 40


@pytest.mark.parametrize("most", [50_000, 5])
def test_signal_summary(spark, most):
    rng = np.random.default_rng(2)
    rows = [("hot", k, float(v), None) for k, v in enumerate(rng.normal(size=300))] + [(None, 1, 2.0, 3.0), (None, 2, 5.0, None), ("one", 0, None, 1.0)]
    df = spark.createDataFrame(rows, "g string, a long, b double, c double").repartition(5)
    got = {(r["g"], r["signal"]): r for r in summary.signal_summary(df, ["g"], ["a", "b", "c"], most).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "a", "b", "c"])
    assert len(got) == 9
    for g in ("hot", None, "one"):
        for c in "abc":
            v, r = pdf[pdf["g"].isna() if g is None else pdf["g"] == g][c].dropna(), got[g, c]
            want = [v.mean(), v.std(), v.min(), v.max(), *v.quantile([0.5, 0.25, 0.75]), v.max() - v.min()]
            assert r["n"] == len(v)
            assert [r[k] for k in ("mean", "std", "min", "max", "median", "q25", "q75", "range")] == [None if np.isnan(x) else pytest.approx(x) for x in want]


def test_signal_summary_shuffles_wide_rows_once(spark):
    df = spark.range(40).selectExpr("id % 3 AS g", "id AS a", "id * 2 AS b")
    plan = summary.signal_summary(df, ["g"], ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Expand" not in plan


def test_large_groups_keep_few_values(spark):
    """Quantiles stay exact while most values of a large group are merged before they are shuffled."""
    rng = np.random.default_rng(3)
    v = {"a": rng.normal(size=30_000), "ties": np.floor(rng.normal(size=30_000) * 2), "small": rng.normal(size=20)}
    df = spark.createDataFrame(pd.DataFrame([(g, x) for g, xs in v.items() for x in xs], columns=["g", "v"]))
    got = {r["g"]: r for r in summary.exact_quantiles(df, ["g"], "v", PROBS, 100).collect()}
    for g, x in v.items():
        assert np.allclose([got[g][n] for n in PROBS], np.quantile(x, list(PROBS.values())), atol=1e-12)
    rows = df.selectExpr("struct(g) AS _g", "v AS _v")
    assert summary._merged(rows, list(PROBS.values()), 10_000).where("_g.g = 'a'").select("_v").distinct().count() < 400
