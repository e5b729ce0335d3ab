"""Regressions on known factors: does a candidate earn what they don't explain?"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.functions import normal
from panelyard.operators.sharpe import newey_west_lags

FACTORS = ("Mkt-RF", "SMB", "HML", "RMW", "CMA", "Mom")


def ols_hac(y: np.ndarray, x: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, covariance) with a Bartlett long-run covariance, without small-sample corrections."""
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ (x.T @ y)
    u = x * (y - x @ beta)[:, None]
    s = u.T @ u
    for j in range(1, min(lags, len(y) - 1) + 1):
        g = u[j:].T @ u[:-j]
        s += (1 - j / (lags + 1)) * (g + g.T)
    return beta, inv @ s @ inv


def factor_alpha(returns: DataFrame, factors: DataFrame, *, returns_are_excess: bool, lags: int | None = None, names: Sequence[str] = FACTORS, key: str = "candidate", value: str = "ret") -> DataFrame:
    """(candidate, n_obs, lags, alpha, se, t, pvalue): intercepts with robust errors and one-sided p-values.

    Factors have one row a date, so they go to each candidate by a join on date; a candidate then is one small
    group. Too few observations, collinear factors, or residuals of zero give a row of nulls.
    """
    kind = returns.schema[key].dataType.simpleString()
    columns = [f"_f{i}" for i in range(len(names))]
    wide = factors.select("date", F.col("RF").alias("_rf"), *[F.col(f"`{n}`").alias(c) for n, c in zip(names, columns, strict=True)]).dropna()
    rows = returns.where(F.col(value).isNotNull()).select("date", key, value).join(wide, "date")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        y = pdf[value].to_numpy(float) - (0.0 if returns_are_excess else pdf["_rf"].to_numpy(float))
        x = np.column_stack([np.ones(len(pdf)), pdf[columns].to_numpy(float)])
        n, used = len(y), lags if lags is not None else newey_west_lags(len(y))
        out = {key: [pdf[key].iloc[0]], "n_obs": [n], "lags": [None], "alpha": [None], "se": [None], "t": [None], "pvalue": [None]}
        if n > x.shape[1] and np.linalg.matrix_rank(x) == x.shape[1]:
            beta, cov = ols_hac(y, x, used)
            left = y - x @ beta
            if np.abs(left).max() > 1e-10 * max(np.abs(y).max(), 1e-300) and cov[0, 0] > 0:
                se = math.sqrt(cov[0, 0])
                out |= {"lags": [used], "alpha": [beta[0]], "se": [se], "t": [beta[0] / se], "pvalue": [normal.sf(beta[0] / se)]}
        return pd.DataFrame(out)

    return rows.groupBy(key).applyInPandas(fit, f"{key} {kind}, n_obs bigint, lags int, alpha double, se double, t double, pvalue double")


def check_daily(frame: DataFrame) -> None:
    """Raises if a date repeats or the median gap is over four days."""
    from pyspark.sql import Window

    gaps = frame.select("date", F.datediff("date", F.lag("date").over(Window.orderBy("date"))).alias("gap"))
    least, median = gaps.agg(F.min("gap"), F.percentile("gap", F.lit(0.5))).first()
    if least is not None and (least < 1 or median > 4):
        raise ValueError("needs daily rows, one a date")
