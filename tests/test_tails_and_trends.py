"""Tails of the significance tests and cubic trends against direct computation."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialframe.operators import series, significance


def test_binomial_tail(spark):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(-1, n + 2)), int(n), float(p)) for n in (1, 2, 7, 16, 40, 97, 300) for p in (0.02, 0.5, 0.536, 0.97) for _ in range(6)]
    df = spark.createDataFrame(rows, "k long, n long, p double")
    got = df.select("k", "n", "p", significance.binom_sf(F.col("k"), F.col("n"), F.col("p")).alias("s")).collect()
    for r in got:
        p = Fraction(r["p"])
        want = float(sum(math.comb(r["n"], i) * p**i * (1 - p) ** (r["n"] - i) for i in range(max(r["k"], 0), r["n"] + 1)))
        assert math.isclose(r["s"], want, rel_tol=1e-10, abs_tol=1e-13), r


def test_hypergeometric_tail(spark):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(120):
        pop = int(rng.integers(1, 200))
        succ, draws = (int(rng.integers(0, pop + 1)) for _ in range(2))
        rows.append((int(rng.integers(-1, pop + 2)), pop, succ, draws))
    df = spark.createDataFrame(rows, "x long, pop long, succ long, draws long")
    for r in df.withColumn("s", significance.hypergeom_sf(*(F.col(c) for c in ("x", "pop", "succ", "draws")))).collect():
        x, pop, succ, draws = r["x"], r["pop"], r["succ"], r["draws"]
        every = math.comb(pop, draws)
        want = float(Fraction(sum(math.comb(succ, i) * math.comb(pop - succ, draws - i) for i in range(max(x, 0), min(succ, draws) + 1)), every))
        assert math.isclose(r["s"], want, rel_tol=1e-9, abs_tol=1e-12), r


def test_tails_of_large_test_sets(spark):
    n = 10**9
    rows = [(n // 2, n, 0.5), (n // 2 + 1, n, 0.5), (n // 2 + 100_000, n, 0.5), (1000, n, 1e-6), (n, n, 0.5), (n // 2 + 5 * 10**6, n, 0.5)]
    df = spark.createDataFrame(rows, "k long, n long, p double")
    got = [r[0] for r in df.select(significance.binom_sf(F.col("k"), F.col("n"), F.col("p"))).collect()]
    middle = math.exp(math.log(2 / math.pi / n) / 2 - 1 / (4 * n))
    assert math.isclose(got[0], 0.5 + middle / 2, rel_tol=1e-12) and math.isclose(got[1], 0.5 - middle / 2, rel_tol=1e-12)
    z = (100_000 - 0.5) / math.sqrt(n / 4)
    assert math.isclose(got[2], 0.5 * math.erfc(z / math.sqrt(2)), rel_tol=1e-6)
    poisson = 1 - sum(math.exp(-1000 + i * math.log(1000) - math.lgamma(i + 1)) for i in range(1000))
    assert math.isclose(got[3], poisson, rel_tol=1e-5) and got[4] == 0.0 and got[5] == 0.0
    h = spark.createDataFrame([(n // 4, n, n // 2, n // 2)], "x long, pop long, succ long, draws long")
    p = h.select(significance.hypergeom_sf(*(F.col(c) for c in h.columns))).first()[0]
    assert 0.5 < p < 0.5001


def test_error_function(spark):
    x = [-6.0, -2.5, -0.3, 0.0, 1e-9, 0.7, 1.9, 2.4999, 2.5, 3.3, 6.0, 20.0]
    got = spark.createDataFrame([(v,) for v in x], "x double").select(significance.erfc(F.col("x"))).collect()
    for v, r in zip(x, got):
        assert math.isclose(r[0], math.erfc(v), rel_tol=2e-12), (v, r[0], math.erfc(v))
    p = spark.range(1).select(significance.mcnemar_p(F.lit(0), F.lit(0)), significance.mcnemar_p(F.lit(12), F.lit(3))).first()
    assert p[0] == 1.0 and math.isclose(p[1], math.erfc(8 / math.sqrt(15) / math.sqrt(2)), rel_tol=1e-12)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 200])
def test_cubic_trend(spark, n):
    rng = np.random.default_rng(n)
    t = np.sort(rng.choice(10_000, size=n, replace=False)) + 1_600_000_000
    x = rng.normal(size=n) + 1e-9 * (t - t[0]) ** 2
    rows = [("a", int(a), float(b)) for a, b in zip(t, x)] + [("a", None, 1.0), ("a", int(t[0]) + 5, None), (None, 1, 2.0), (None, 2, 2.0), ("c", 7, 3.0), ("c", 7, 5.0)]
    df = spark.createDataFrame(rows, "rec string, t long, x double")
    got = series.detrend_cubic(df, "rec", "t", "x").collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"rec", "t", "x", "x_detrend_cubic"}
    mine = {r["t"]: r["x_detrend_cubic"] for r in got if r["rec"] == "a" and r["t"] is not None and r["x"] is not None}
    u = (t - t.mean()) / max(1, np.abs(t - t.mean()).max())
    want = x - np.polyval(np.polyfit(u, x, min(3, n - 1)), u)
    assert np.allclose([mine[int(a)] for a in t], want, atol=1e-8)
    assert sorted(abs(r["x_detrend_cubic"]) for r in got if r["rec"] in (None, "c")) == pytest.approx([0, 0, 1, 1], abs=1e-9)
    assert [r["x_detrend_cubic"] for r in got if r["rec"] == "a" and (r["t"] is None or r["x"] is None)] == [None, None]
