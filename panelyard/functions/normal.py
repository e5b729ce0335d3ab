"""The normal distribution and Sharpe algebra as SQL text that any ANSI engine evaluates, and as plain Python.

The text forms stay inside generated code; the Python forms serve the driver and Arrow kernels.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

# The rational approximation of the normal tail by Hart (algorithm 5666), as published by West (2005).
_NUM = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_DEN = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
# Acklam's rational approximation of the normal quantile.
_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239)
_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)

EULER_GAMMA = 0.5772156649015329


def _lit(x: float) -> str:
    return f"cast('{x!r}' as double)"


def _horner(terms: tuple[float, ...], x: str, last: float | None = None) -> str:
    out = _lit(terms[0])
    for t in (*terms[1:], *(() if last is None else (last,))):
        out = f"({out} * {x} + {_lit(t)})"
    return out


def sf_sql(x: str) -> str:
    """Upper tail of the normal as SQL text; null for null, exact to about 1e-15."""
    a = f"abs({x})"
    tail = f"exp(-{a} * {a} / 2) * {_horner(_NUM, a)} / {_horner(_DEN, a)}"
    far = f"exp(-{a} * {a} / 2) / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65e0))))) / {_lit(math.sqrt(2 * math.pi))}"
    upper = f"(case when {a} > 37 then cast(0 as double) when {a} < 7.07106781186547e0 then {tail} else {far} end)"
    return f"(case when {x} is null then null when {x} > 0 then {upper} else 1 - {upper} end)"


def cdf_sql(x: str) -> str:
    return sf_sql(f"(-({x}))")


def ppf_sql(p: str) -> str:
    """Normal quantile as SQL text, relative error about 1e-9; null outside (0, 1)."""
    q, r = f"({p} - 0.5e0)", f"(({p} - 0.5e0) * ({p} - 0.5e0))"
    mid = f"{_horner(_A, r)} * {q} / {_horner((*_B, 1.0), r)}"
    low = f"sqrt(-2 * ln({p}))"
    high = f"sqrt(-2 * ln(1 - {p}))"
    tail = lambda t: f"{_horner(_C, t)} / {_horner((*_D, 1.0), t)}"
    return f"(case when {p} is null or {p} <= 0 or {p} >= 1 then null when {p} < 0.02425e0 then {tail(low)} when {p} > 0.97575e0 then -({tail(high)}) else {mid} end)"


def sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)


def sf_array(x: np.ndarray) -> np.ndarray:
    return np.array([math.nan if math.isnan(v) else sf(v) for v in np.ravel(x)]).reshape(np.shape(x))


def sharpe_pvalue_sql(sharpe: str, n: str, periods: int) -> str:
    """Two-sided p-value of an annual Sharpe ratio under normal returns."""
    z = f"(abs({sharpe}) / {_lit(math.sqrt(periods))} * sqrt(cast({n} as double)))"
    return f"(2 * {sf_sql(z)})"


def psr_sql(sharpe: str, n: str, benchmark: str, variance: str, periods: int) -> str:
    """Probability that the true Sharpe ratio exceeds the benchmark; all Sharpe ratios annual, variance per period."""
    z = f"((({sharpe}) - ({benchmark})) / {_lit(math.sqrt(periods))} * sqrt(cast({n} as double) - 1) / sqrt({variance}))"
    return cdf_sql(z)


def nonnormal_variance_sql(sr: str, skew: str, kurtosis: str) -> str:
    return f"(1 - ({skew}) * ({sr}) + (({kurtosis}) - 1) / 4 * ({sr}) * ({sr}))"


def expected_max(n_trials: float) -> float:
    """Expected largest of n independent standard normals, in the extreme-value approximation; 0 for one."""
    if n_trials <= 1:
        return 0.0
    return (1 - EULER_GAMMA) * ppf(1 - 1 / n_trials) + EULER_GAMMA * ppf(1 - 1 / (n_trials * math.e))


def log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - log_beta(a, b)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + num * d or tiny)
        c = 1.0 + num / c or tiny
        f *= c * d
        if abs(1.0 - c * d) < 1e-15:
            break
    return front * (f - 1.0)


def t_sf(t: float, df: float) -> float:
    """Upper tail of Student's t."""
    half = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return half if t > 0 else 1 - half


def t_isf(p: float, df: float) -> float:
    """Student t value with upper tail p, by bisection."""
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_sf(mid, df) > p else (lo, mid)
    return (lo + hi) / 2
