"""An anytime-valid monitor of decay: a mixture of bets against the expected mean, over batches of series."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BETS = tuple(2.0**-k for k in range(8))


@dataclass(frozen=True)
class MonitorConfig:
    expected_mean: float
    scale: float
    alpha: float = 0.05
    horizon: int = 252
    bets: Sequence[float] = field(default=BETS)

    def __post_init__(self) -> None:
        if not (math.isfinite(self.expected_mean) and math.isfinite(self.scale) and self.scale > 0 and 0 < self.alpha < 1 and self.horizon >= 1 and self.bets and all(b > 0 for b in self.bets)):
            raise ValueError("monitor settings out of range")

    def steps(self, r: float | None) -> list[float]:
        """Log-wealth increment of each bet for one observation; none for a missing one."""
        if r is None or math.isnan(r):
            return [0.0] * len(self.bets)
        x = (self.expected_mean - r) / self.scale
        return [math.copysign(math.log1p(abs(b * x) + (b * x) ** 2 / 2), b * x) - b * b / 2 for b in self.bets]

    def e_value(self, wealth: Sequence[float]) -> float:
        top = max(wealth)
        return math.exp(top) * sum(math.exp(w - top) for w in wealth) / len(wealth)


def from_backtest(returns: DataFrame, *, value: str = "ret", alpha: float = 0.05, horizon: int = 252) -> MonitorConfig:
    """Expected mean and sample deviation of a backtest's returns."""
    mean, sd, n = returns.agg(F.avg(value), F.stddev_samp(value), F.count(value)).first()
    if n < 2:
        raise ValueError("need at least two returns")
    return MonitorConfig(mean, sd, alpha, horizon)


def _step(r: Column, config: MonitorConfig, bet: float) -> Column:
    u = (F.lit(config.expected_mean) - r) / config.scale * bet
    return F.when(r.isNotNull() & ~F.isnan(r), F.signum(u) * F.log1p(F.abs(u) + u * u / 2) - bet * bet / 2).otherwise(0.0)


def e_process(returns: DataFrame, config: MonitorConfig, *, key: str = "strategy", order: str = "t", value: str = "r") -> DataFrame:
    """Adds ``e_value``: the mixture's wealth after each period; a missing period carries it forward.

    One running sum for each bet over one window, so the plan has a single sort by series.
    """
    run = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    bets = list(config.bets)
    out = returns.select("*", *[F.sum(_step(F.col(value), config, b)).over(run).alias(f"_w{i}") for i, b in enumerate(bets)])
    wealth = [F.col(f"_w{i}") for i in range(len(bets))]
    top = F.greatest(*wealth) if len(wealth) > 1 else wealth[0]
    total = sum((F.exp(w - F.col("_top")) for w in wealth), F.lit(0.0))
    return out.withColumn("_top", top).withColumn("e_value", F.exp("_top") * total / len(bets)).drop("_top", *[f"_w{i}" for i in range(len(bets))])


def decisions(returns: DataFrame, config: MonitorConfig, *, key: str = "strategy", order: str = "t", value: str = "r") -> DataFrame:
    """(key, decision, at, e_value): retire at the first crossing of 1 / alpha, keep once the horizon is seen, else continue."""
    run = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = e_process(returns, config, key=key, order=order, value=value).withColumn("_n", F.count(F.when(~F.isnan(value), F.col(value))).over(run))
    call = F.when(F.col("e_value") >= 1 / config.alpha, "retire").when(F.col("_n") >= config.horizon, "keep")
    final = marked.withColumn("_d", call)
    return final.groupBy(key).agg(
        F.coalesce(F.min_by("_d", F.when(F.col("_d").isNotNull(), F.col(order))), F.lit("continue")).alias("decision"),
        F.min(F.when(F.col("_d").isNotNull(), F.col(order))).alias("at"),
        F.coalesce(F.min_by("e_value", F.when(F.col("_d").isNotNull(), F.col(order))), F.max_by("e_value", order)).alias("e_value"),
    )
