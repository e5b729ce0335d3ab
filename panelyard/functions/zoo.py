"""The published formulas that a new factor is held against."""

from __future__ import annotations

#: How daily returns are written out; a member that has them stands in the zoo twice, the second time with the field ``returns``.
RETURNS = "close / shift(close, 1) - 1"

# The formulas of Kakushadze, "101 Formulaic Alphas" (2016), that the language can express, by the paper's numbers. {r} stands for daily returns.
FORMULAS = {
    "alpha_002": "-1 * ts_corr(rank(delta(log(volume), 2)), rank((close - open) / open), 6)",
    "alpha_003": "-1 * ts_corr(rank(open), rank(volume), 10)",
    "alpha_004": "-1 * ts_rank(rank(low), 9)",
    "alpha_006": "-1 * ts_corr(open, volume, 10)",
    "alpha_008": "-1 * rank(ts_sum(open, 5) * ts_sum({r}, 5) - shift(ts_sum(open, 5) * ts_sum({r}, 5), 10))",
    "alpha_012": "sign(delta(volume, 1)) * (-1 * delta(close, 1))",
    "alpha_013": "-1 * rank(ts_cov(rank(close), rank(volume), 5))",
    "alpha_014": "-1 * rank(delta({r}, 3)) * ts_corr(open, volume, 10)",
    "alpha_015": "-1 * ts_sum(rank(ts_corr(rank(high), rank(volume), 3)), 3)",
    "alpha_016": "-1 * rank(ts_cov(rank(high), rank(volume), 5))",
    "alpha_017": "-1 * rank(ts_rank(close, 10)) * rank(delta(delta(close, 1), 1)) * rank(ts_rank(volume / ts_mean(volume, 20), 5))",
    "alpha_018": "-1 * rank(ts_std(abs(close - open), 5) + (close - open) + ts_corr(close, open, 10))",
    "alpha_019": "-1 * sign((close - shift(close, 7)) + delta(close, 7)) * (1 + rank(1 + ts_sum({r}, 250)))",
    "alpha_020": "-1 * rank(open - shift(high, 1)) * rank(open - shift(close, 1)) * rank(open - shift(low, 1))",
    "alpha_022": "-1 * delta(ts_corr(high, volume, 5), 5) * rank(ts_std(close, 20))",
    "alpha_026": "-1 * ts_max(ts_corr(ts_rank(volume, 5), ts_rank(high, 5), 5), 3)",
    "alpha_028": "scale(ts_corr(ts_mean(volume, 20), low, 5) + (high + low) / 2 - close)",
    "alpha_029": "ts_min(ts_product(rank(rank(scale(log(ts_sum(ts_min(rank(rank(-1 * rank(delta(close - 1, 5)))), 2), 1))))), 1), 5) + ts_rank(shift(-1 * ({r}), 6), 5)",
    "alpha_030": "(1 - rank(sign(close - shift(close, 1)) + sign(shift(close, 1) - shift(close, 2)) + sign(shift(close, 2) - shift(close, 3)))) * ts_sum(volume, 5) / ts_sum(volume, 20)",
    "alpha_031": "rank(rank(rank(decay_linear(-1 * rank(rank(delta(close, 10))), 10)))) + rank(-1 * delta(close, 3)) + sign(scale(ts_corr(ts_mean(volume, 20), low, 12)))",
    "alpha_033": "rank(-1 * (1 - open / close))",
    "alpha_034": "rank((1 - rank(ts_std({r}, 2) / ts_std({r}, 5))) + (1 - rank(delta(close, 1))))",
    "alpha_035": "ts_rank(volume, 32) * (1 - ts_rank(close + high - low, 16)) * (1 - ts_rank({r}, 32))",
    "alpha_037": "rank(ts_corr(shift(open - close, 1), close, 200)) + rank(open - close)",
    "alpha_038": "-1 * rank(ts_rank(close, 10)) * rank(close / open)",
    "alpha_039": "-1 * rank(delta(close, 7) * (1 - rank(decay_linear(volume / ts_mean(volume, 20), 9)))) * (1 + rank(ts_sum({r}, 250)))",
    "alpha_040": "-1 * rank(ts_std(high, 10)) * ts_corr(high, volume, 10)",
    "alpha_043": "ts_rank(volume / ts_mean(volume, 20), 20) * ts_rank(-1 * delta(close, 7), 8)",
    "alpha_044": "-1 * ts_corr(high, rank(volume), 5)",
    "alpha_045": "-1 * rank(ts_sum(shift(close, 5), 20) / 20) * ts_corr(close, volume, 2) * rank(ts_corr(ts_sum(close, 5), ts_sum(close, 20), 2))",
    "alpha_052": "(-1 * ts_min(low, 5) + shift(ts_min(low, 5), 5)) * rank((ts_sum({r}, 240) - ts_sum({r}, 20)) / 220) * ts_rank(volume, 5)",
    "alpha_053": "-1 * delta(((close - low) - (high - close)) / (close - low), 9)",
    "alpha_054": "-1 * ((low - close) * signed_power(open, 5)) / ((low - high) * signed_power(close, 5))",
    "alpha_055": "-1 * ts_corr(rank((close - ts_min(low, 12)) / (ts_max(high, 12) - ts_min(low, 12))), rank(volume), 6)",
    "alpha_056": "0 - 1 * (rank(ts_sum({r}, 10) / ts_sum(ts_sum({r}, 2), 3)) * rank(({r}) * cap))",
    "alpha_060": "0 - 1 * (2 * scale(rank(((close - low) - (high - close)) / (high - low) * volume)) - scale(rank(ts_argmax(close, 10))))",
    "alpha_101": "(close - open) / ((high - low) + 0.001)",
}


def default_zoo() -> list[tuple[str, str]]:
    """(name, formula) in order: all members with returns written out, then, as ``name_returns``, those that have returns with the field."""
    return [(n, f.replace("{r}", RETURNS)) for n, f in FORMULAS.items()] + [(f"{n}_returns", f.replace("{r}", "returns")) for n, f in FORMULAS.items() if "{r}" in f]
