"""Significance tests as column expressions.

Spark SQL has no gamma or error function, so the tails are built from what it
has. A probability of the binomial is taken in saddle-point form (Loader 2000:
Stirling's error and deviances, no difference of large logarithms), the tail
as that probability times a sum of ratios of neighbouring terms. Terms beyond
ten standard deviations do not count, so a row needs a sequence of the order of
sqrt(n), not n: 10^9 test rows take 160,000 terms. The error function is its
series or its continued fraction (DLMF 7.6.2, 7.9.4), each where it converges
fast; both are exact to about 1e-14. The inputs are per-model aggregate rows.
"""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS = 80
SERIES_BELOW = 2.5


def _steps(n: int) -> Column:
    return F.sequence(F.lit(1), F.lit(n))


def erfc(x: Column) -> Column:
    """1 - erf(x)."""
    z = F.abs(x).cast("double")
    one = F.lit(1.0)
    # erf z = 2 / sqrt(pi) * exp(-z^2) * sum of 2^n z^(2n+1) / (1 * 3 * ... * (2n+1))
    series = F.aggregate(
        _steps(TERMS), F.struct(one.alias("t"), one.alias("s")),
        lambda a, n: F.struct((a["t"] * 2 * z * z / (2 * n + 1)).alias("t"), (a["s"] + a["t"] * 2 * z * z / (2 * n + 1)).alias("s")),
        lambda a: a["s"],
    )
    low = 1 - 2 / sqrt(pi) * F.exp(-z * z) * z * series
    # erfc z = exp(-z^2) / sqrt(pi) / (z + (1/2) / (z + (2/2) / (z + (3/2) / ...))), from the inside out
    inner = F.aggregate(_steps(TERMS), z, lambda a, n: z + (TERMS + 1 - n) / 2.0 / a)
    high = F.exp(-z * z) / sqrt(pi) / inner
    tail = F.when(z < SERIES_BELOW, low).otherwise(high)
    return F.when(x >= 0, tail).otherwise(2.0 - tail)


def chi2_1df_sf(x: Column) -> Column:
    """P(chi^2_1 >= x) = erfc(sqrt(x / 2))."""
    return erfc(F.sqrt(x / 2.0))


def _stirling_error(n: Column) -> Column:
    """ln n! - ln(sqrt(2 pi n) (n / e)^n) for a whole n >= 1."""
    n = n.cast("double")
    small = F.log(F.factorial(F.least(n, F.lit(15.0)).cast("int")).cast("double")) - (n + 0.5) * F.log(n) + n - 0.5 * F.log(F.lit(2 * pi))
    r = 1 / (n * n)
    large = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / n
    return F.when(n <= 15, small).otherwise(large)


def _let(value: Column, then) -> Column:
    """then(value), with value written and computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _deviance(x: Column, m: Column) -> Column:
    """x ln(x / m) + m - x, without cancellation where x is near m."""
    terms = F.sequence(F.lit(12), F.lit(1), F.lit(-1))
    near = lambda v: v * (x - m + 2 * x * F.aggregate(terms, F.lit(0.0), lambda a, j: v * v * (1.0 / (2 * j + 1) + a)))
    return F.when(F.abs(x - m) < 0.1 * (x + m), _let((x - m) / (x + m), near)).otherwise(x * F.log(x / m) + m - x)


def binom_pmf(k: Column, n: Column, p: Column) -> Column:
    """P(X = k), X ~ Binomial(n, p), 0 < p < 1, 0 <= k <= n."""

    def of(s):
        k, n, p = s["k"], s["n"], s["p"]
        rest = n - k
        exponent = _stirling_error(n) - _stirling_error(k) - _stirling_error(rest) - _deviance(k, n * p) - _deviance(rest, n * (1.0 - p))
        inside = F.exp(exponent) * F.sqrt(n / (2 * pi * k * rest))
        return F.when(k == 0, F.exp(n * F.log1p(-p))).when(rest == 0, F.exp(n * F.log(p))).otherwise(inside)

    return _let(F.struct(k.cast("double").alias("k"), n.cast("double").alias("n"), p.cast("double").alias("p")), of)


def _ratio_sum(length: Column, ratio) -> Column:
    """1 + r(0) + r(0) r(1) + ... of ``length`` terms; ratio(j) is r of the step."""
    one = F.lit(1.0)
    steps = F.when(length > 1, F.sequence(F.lit(0).cast("long"), length.cast("long") - 2)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(
        steps, F.struct(one.alias("t"), one.alias("s")),
        lambda a, j: F.struct((a["t"] * ratio(j)).alias("t"), (a["s"] + a["t"] * ratio(j)).alias("s")), lambda a: a["s"],
    )


def _reach(sd: Column) -> Column:
    """Terms after which a tail that starts beyond the mean has died out."""
    return F.ceil(10 * sd) + 100


def binom_sf(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k), X ~ Binomial(n, p), one-sided 'greater' test."""

    def of(s):
        k, n, p = s["k"], s["n"], s["p"]
        reach = _reach(F.sqrt(n * p * (1 - p)))
        # the tail beyond the mean, upwards from k or downwards from k - 1
        above = k > n * p
        x = F.when(above, k).otherwise(k - 1)
        up = lambda j: (n - x - j) * p / ((x + j + 1) * (1 - p))
        down = lambda j: (x - j) * (1 - p) / ((n - x + j + 1) * p)
        total = _ratio_sum(F.least(F.when(above, n - x).otherwise(x) + 1, reach), lambda j: F.when(above, up(j)).otherwise(down(j)))
        tail = binom_pmf(x, n, p) * total
        return _let(tail, lambda t: F.when(above, t).otherwise(1 - t))

    tail = _let(F.struct(k.cast("long").alias("k"), n.cast("long").alias("n"), p.cast("double").alias("p")), of)
    return (F.when(k <= 0, F.lit(1.0)).when(k > n, F.lit(0.0))
            .when(p <= 0, F.lit(0.0)).when(p >= 1, F.lit(1.0)).otherwise(F.greatest(F.least(tail, F.lit(1.0)), F.lit(0.0))))


def hypergeom_sf(x0: Column, pop: Column, succ: Column, draws: Column) -> Column:
    """P(X >= x0), X ~ Hypergeometric(population, successes, draws)."""
    given = {"x0": x0, "pop": pop, "succ": succ, "draws": draws}

    def of(s):
        x0, pop, succ, draws = (s[c] for c in given)
        fail = pop - succ
        p = draws / pop.cast("double")
        above = x0 > succ * p
        x = F.when(above, x0).otherwise(x0 - 1)
        up = lambda j: (succ - x - j) * (draws - x - j) / ((x + j + 1.0) * (fail - draws + x + j + 1))
        down = lambda j: (x - j) * (fail - draws + x - j) / ((succ - x + j + 1.0) * (draws - x + j + 1))
        last = F.when(above, F.least(succ, draws) - x).otherwise(x - F.greatest(F.lit(0).cast("long"), draws - fail))
        total = _ratio_sum(F.least(last + 1, _reach(F.sqrt(succ * p * (1 - p)))), lambda j: F.when(above, up(j)).otherwise(down(j)))
        pmf = binom_pmf(x, succ, p) * binom_pmf(draws - x, fail, p) / binom_pmf(draws, pop, p)
        return _let(pmf * total, lambda t: F.when(above, t).otherwise(1 - t))

    tail = _let(F.struct(*[c.cast("long").alias(n) for n, c in given.items()]), of)
    lo, hi = F.greatest(F.lit(0), draws - (pop - succ)), F.least(succ, draws)
    return F.when(x0 <= lo, F.lit(1.0)).when(x0 > hi, F.lit(0.0)).otherwise(F.greatest(F.least(tail, F.lit(1.0)), F.lit(0.0)))


def permutation_p(n: Column, n_correct: Column, pos_true: Column, pos_pred: Column) -> Column:
    """E25, exact: share of all label permutations whose accuracy >= the
    observed one (the limit of the reference's 1000 random shuffles). With
    m predicted and P true positives, correct = 2*TP + n - m - P and TP is
    hypergeometric."""
    need = F.ceil((n_correct - n + pos_pred + pos_true) / 2.0)
    return hypergeom_sf(need, n, pos_true, pos_pred)


def mcnemar_p(b: Column, c: Column) -> Column:
    """Continuity-corrected McNemar; no discordant pairs -> 1."""
    stat = F.pow(F.abs(b - c) - 1, 2) / (b + c)
    return F.when((b + c) > 0, chi2_1df_sf(stat)).otherwise(F.lit(1.0))


def truncated_correct(acc: Column, n: Column) -> Column:
    """T10 compatibility: int(accuracy * n) as the reference computes it
    (50/97 -> 49)."""
    return F.floor(acc * n)


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")
