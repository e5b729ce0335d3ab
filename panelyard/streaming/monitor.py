"""The decay monitor one observation at a time, as a stateful stream operator."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from panelyard.operators.monitor import MonitorConfig

OUTPUT = "strategy string, t bigint, e_value double, n_obs bigint, decision string"
STATE = "wealth array<double>, n_obs bigint, decision string, e_value double"


def monitor_stream(returns: DataFrame, config: MonitorConfig) -> DataFrame:
    """(strategy, t, e_value, n_obs, decision) for each row of a stream of (strategy string, t bigint, r double).

    State is one wealth for each bet, a count and the decision, which is final once it isn't "continue": later rows
    of that strategy are answered with it and change nothing.
    """

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        wealth, n, decision, e = state.get if state.exists else ([0.0] * len(config.bets), 0, "continue", 1.0)
        wealth = list(wealth)
        rows = pd.concat(list(batches)).sort_values("t")
        out = []
        for t, r in zip(rows["t"], rows["r"], strict=True):
            if decision == "continue":
                if pd.notna(r):
                    n += 1
                    wealth = [w + s for w, s in zip(wealth, config.steps(float(r)), strict=True)]
                    e = config.e_value(wealth)
                decision = "retire" if e >= 1 / config.alpha else "keep" if n >= config.horizon else "continue"
            out.append((key[0], int(t), e, n, decision))
        state.update((wealth, n, decision, e))
        yield pd.DataFrame(out, columns=["strategy", "t", "e_value", "n_obs", "decision"])

    return returns.groupBy("strategy").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def overlapping(records: DataFrame, *, key: str, time: str, overlap: str) -> DataFrame:
    """Records of overlapping fetches, each key once: late repeats are dropped for as long as the overlap lasts."""
    return records.withWatermark(time, overlap).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, *, time: str = "ts", late: str = "1 day", width: str = "1 day", key: str = "event_type", value: str = "value") -> DataFrame:
    """Count and mean for each window and key, final once the watermark has passed."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
