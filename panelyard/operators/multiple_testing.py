"""Corrections for many tests over a table of p-values, one row a candidate.

Ranks and running extrema come from a sort by ranges (see ``scan``), so no task sees all p-values; sizes and cuts are
aggregates. ``by`` splits the table into separate families. What is one sort for one correction is one sort for all of
:func:`evidence_profile`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.operators import scan

_PLACED = ("_r", "_m", "_n", "_id", "_part")


def _alpha(alpha: float) -> float:
    if not 0 < alpha < 1:
        raise ValueError("alpha must be in (0, 1)")
    return alpha


def _ranked(pvalues: DataFrame, p: str, by: Sequence[str]) -> DataFrame:
    """With _r, the rank of a p-value in its family, missing ones last, _m rows and _n p-values of the family."""
    return scan.ranked(pvalues, F.col(p).asc_nulls_last(), by=by, _m=F.count(F.lit(1)), _n=F.count(p))


def bonferroni(pvalues: DataFrame, alpha: float = 0.05, *, p: str = "p", by: Sequence[str] = (), name: str = "rejected") -> DataFrame:
    """p at most alpha over the family's size; missing p-values were trials too."""
    counted = scan.sized(pvalues, by, _m=F.count(F.lit(1)))
    return counted.withColumn(name, F.coalesce(F.col(p) <= F.lit(_alpha(alpha)) / F.col("_m"), F.lit(False))).drop("_m")


def holm(pvalues: DataFrame, alpha: float = 0.05, *, p: str = "p", by: Sequence[str] = (), name: str = "rejected") -> DataFrame:
    """Step down until the first failure; missing p-values count in the family's size."""
    ranked = _ranked(pvalues, p, by)
    fails = F.col(p).isNull() | (F.col(p) > F.lit(_alpha(alpha)) / (F.col("_m") - F.col("_r") + 1))
    return scan.sized(ranked, by, _f=F.min(F.when(fails, F.col("_r")))).withColumn(name, F.col("_r") < F.coalesce("_f", F.col("_m") + 1)).drop("_f", *_PLACED)


def _step_up(pvalues: DataFrame, level: Column, p: str, by: Sequence[str], name: str) -> DataFrame:
    cut = F.max(F.when(F.col(p) <= level, F.col("_r")))
    return scan.sized(_ranked(pvalues, p, by), by, _c=cut).withColumn(name, F.col(p).isNotNull() & (F.col("_r") <= F.coalesce("_c", F.lit(0)))).drop("_c", *_PLACED)


def benjamini_hochberg(pvalues: DataFrame, alpha: float = 0.05, *, p: str = "p", by: Sequence[str] = (), name: str = "rejected") -> DataFrame:
    """Step up over the p-values that are there: all up to the largest passing rank."""
    return _step_up(pvalues, F.lit(_alpha(alpha)) * F.col("_r") / F.col("_n"), p, by, name)


def benjamini_yekutieli(pvalues: DataFrame, alpha: float = 0.05, *, p: str = "p", by: Sequence[str] = (), name: str = "rejected") -> DataFrame:
    """As Benjamini-Hochberg, divided by the harmonic sum; missing p-values count in the family's size."""
    return _step_up(pvalues, F.lit(_alpha(alpha)) * F.col("_r") / (F.col("_m") * harmonic(F.col("_m"))), p, by, name)


#: Euler's constant, and the number of terms up to which a harmonic sum is added up.
EULER, ADDED = 0.5772156649015329, 100


def harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m: added up for a small m, else by its expansion, whose error is below 1e-14 there."""
    m = F.greatest(m, F.lit(1))
    few = F.aggregate(F.sequence(F.lit(1), F.least(m, F.lit(ADDED)).cast("int")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / i)
    x = m.cast("double")
    many = F.log(x) + EULER + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x)
    return F.when(m <= ADDED, few).otherwise(many)


def _holm(ranked: DataFrame, p: str, by: Sequence[str], name: str) -> DataFrame:
    up = scan.running(ranked, F.col(p) * (F.col("_m") - F.col("_r") + 1), name, by=by)
    return up.withColumn(name, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), name)))


def _least_share(ranked: DataFrame, p: str, by: Sequence[str]) -> DataFrame:
    """With _s, the least p / rank from the last p-value down to this one: every step-up value is a multiple of it."""
    return scan.running(ranked, F.col(p) / F.col("_r"), "_s", by=by, largest=False, from_end=True)


def _capped(p: str, value: Column) -> Column:
    return F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), value))


def holm_adjusted(pvalues: DataFrame, *, p: str = "p", by: Sequence[str] = (), name: str = "holm") -> DataFrame:
    """Running maximum of (m - rank + 1) p, at most 1; m counts missing p-values."""
    return _holm(_ranked(pvalues, p, by), p, by, name).drop(*_PLACED)


def bh_adjusted(pvalues: DataFrame, *, p: str = "p", by: Sequence[str] = (), name: str = "bh") -> DataFrame:
    """Running minimum from the largest p of p m / rank; m counts those that are there."""
    return _least_share(_ranked(pvalues, p, by), p, by).withColumn(name, _capped(p, F.col("_n") * F.col("_s"))).drop("_s", *_PLACED)


def by_adjusted(pvalues: DataFrame, *, p: str = "p", by: Sequence[str] = (), name: str = "by") -> DataFrame:
    """As :func:`bh_adjusted` times the harmonic sum; m counts missing p-values."""
    return _least_share(_ranked(pvalues, p, by), p, by).withColumn(name, _capped(p, F.col("_m") * harmonic(F.col("_m")) * F.col("_s"))).drop("_s", *_PLACED)


#: The lambdas among which the bootstrap chooses.
GRID = tuple(round(0.05 * i, 2) for i in range(20))


def _share_above(p: str, lam: float) -> Column:
    """Storey's share of true nulls, not capped; lambda 0 gives 1, so that p-values of 0 count."""
    return F.lit(1.0) if lam == 0 else F.try_divide(F.count_if(F.col(p) > lam), F.lit(1 - lam) * F.count(p))


def estimate_pi0(pvalues: DataFrame, lam: float | None = 0.5, *, p: str = "p", n_boot: int = 200, gamma: float = 0.05, seed: int = 0) -> DataFrame:
    """One row (pi0, m): the share of p-values above lambda over its length, at most 1; lambda 0 gives 1, None :func:`bootstrap_lambda`'s."""
    lam = bootstrap_lambda(pvalues, p=p, n_boot=n_boot, gamma=gamma, seed=seed) if lam is None else lam
    if not 0 <= lam < 1:
        raise ValueError("lambda must be in [0, 1)")
    return pvalues.where(F.col(p).isNotNull()).agg(F.least(F.lit(1.0), _share_above(p, lam)).alias("pi0"), F.count(p).alias("m"))


def pfdr_grid(pvalues: DataFrame, *, gamma: float = 0.05, p: str = "p") -> DataFrame:
    """(lam, pi0, pfdr) for each lambda of the grid: the estimated positive false discovery rate of rejecting p up to gamma, at most 1.

    One aggregate over the table; a family without p-values has nulls.
    """
    counts = pvalues.agg(F.count(p).alias("m"), F.count_if(F.col(p) <= gamma).alias("r"), *[_share_above(p, lam).alias(f"s{i}") for i, lam in enumerate(GRID)])
    rate = lambda i: F.least(F.lit(1.0), F.col(f"s{i}") * gamma / (F.greatest("r", F.lit(1)) / F.col("m") * (1 - F.pow(F.lit(1 - gamma), F.col("m")))))
    rows = F.array(*[F.struct(F.lit(lam).alias("lam"), F.least(F.lit(1.0), F.col(f"s{i}")).alias("pi0"), F.when(F.col("m") > 0, rate(i)).alias("pfdr")) for i, lam in enumerate(GRID)])
    return counts.select(F.explode(rows).alias("g")).select("g.*")


def bootstrap_lambda(pvalues: DataFrame, *, p: str = "p", n_boot: int = 200, gamma: float = 0.05, seed: int = 0) -> float:
    """Storey's bootstrap choice of lambda: the grid's value whose resampled pFDR estimates lie nearest, in mean square, to the least estimate.

    An estimate reads a sample only through how many p-values lie between neighbouring grid values and up to gamma. The
    counts of a resample of m p-values are multinomial with the table's own shares, so replications draw counts and not
    p-values: exact in law for any m, and a map over replications on the executors. The driver gets some twenty counts
    and twenty mean squares.
    """
    cuts = sorted({*GRID[1:], gamma})
    bucket = F.lit(0)
    for cut in cuts:
        bucket = bucket + (F.col(p) > cut).cast("int")
    bins = dict.fromkeys(range(len(cuts) + 1), 0) | {r["b"]: r["count"] for r in pvalues.where(F.col(p).isNotNull()).groupBy(bucket.alias("b")).count().collect()}
    counts = np.array([bins[i] for i in range(len(cuts) + 1)], dtype=np.int64)
    m = int(counts.sum())
    if not m:
        raise ValueError("no usable p-values")
    first_above = [cuts.index(lam) + 1 if lam else 0 for lam in GRID]
    upto = cuts.index(gamma) + 1

    def rates(draw: np.ndarray) -> np.ndarray:
        above = np.cumsum(draw[::-1])[::-1]
        share = np.array([1.0 if not lam else above[i] / ((1 - lam) * m) for lam, i in zip(GRID, first_above, strict=True)])
        return np.minimum(1.0, share * gamma / (max(draw[:upto].sum(), 1) / m * (1 - (1 - gamma) ** m)))

    target = rates(counts).min()

    def replicate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            misses = [(rates(np.random.default_rng([seed, k]).multinomial(m, counts / m)) - target) ** 2 for k in batch.column(0).to_pylist()]
            flat = np.concatenate(misses)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(len(GRID)), len(misses))), pa.array(flat)], names=["i", "miss"])

    drawn = pvalues.sparkSession.range(n_boot).mapInArrow(replicate, "i bigint, miss double").groupBy("i").agg(F.avg("miss").alias("mse")).orderBy("mse", "i").first()
    return GRID[drawn["i"]]


def _storey(ranked: DataFrame, lam: float, pfdr: bool, p: str, by: Sequence[str], name: str) -> DataFrame:
    """From ranked rows with _s. Ties share their least value, which is that of the last of them, as the running minimum gives it to all."""
    out = scan.sized(ranked, by, _pi0=F.least(F.lit(1.0), _share_above(p, lam)))
    if not pfdr:
        return out.withColumn(name, _capped(p, F.col("_pi0") * F.col("_n") * F.col("_s"))).drop("_pi0")
    some = 1 - F.pow(1 - F.col(p), F.col("_n"))
    each = F.when(some > 0, F.col("_n") * F.col(p) / F.col("_r") / F.when(some > 0, some)).when(F.col(p).isNotNull(), 1 / F.col("_r"))
    return scan.running(out, each, "_q", by=by, largest=False, from_end=True).withColumn(name, _capped(p, F.col("_pi0") * F.col("_q"))).drop("_pi0", "_q")


def storey_qvalues(pvalues: DataFrame, lam: float | None = 0.5, *, pfdr: bool = False, p: str = "p", by: Sequence[str] = (), name: str = "q") -> DataFrame:
    """pi0 p m over the number of p-values up to p, as a running minimum from the largest p.

    ``pfdr`` divides by 1 - (1 - p)^m, the chance of any rejection; where that is 0 the limit pi0 over the number of
    p-values stands. ``lam`` None is the bootstrap's choice, for a table that is one family.
    """
    if lam is None:
        if by:
            raise ValueError("the bootstrap chooses one lambda for one family")
        lam = bootstrap_lambda(pvalues, p=p)
    return _storey(_least_share(_ranked(pvalues, p, by), p, by), lam, pfdr, p, by, name).drop("_s", *_PLACED)


def _all_adjusted(pvalues: DataFrame, p: str) -> DataFrame:
    shared = _least_share(_holm(_ranked(pvalues, p, ()), p, (), "holm"), p, ())
    return shared.withColumn("by", _capped(p, F.col("_m") * harmonic(F.col("_m")) * F.col("_s"))).withColumn("bh", _capped(p, F.col("_n") * F.col("_s")))


def all_adjusted(pvalues: DataFrame, *, p: str = "p") -> DataFrame:
    """With holm, by and bh: every adjusted p-value from one sort."""
    return _all_adjusted(pvalues, p).drop("_s", *_PLACED)


def evidence_profile(pvalues: DataFrame, *, lam: float | None = 0.5, p: str = "p", with_lfdr: bool = False) -> DataFrame:
    """p with its Holm, Benjamini-Yekutieli, Benjamini-Hochberg and Storey values side by side, and ``with_lfdr`` its local one.

    One sort serves all four. The local false discovery rate is a fit over all p-values, and null below 200 of them.
    """
    lam = bootstrap_lambda(pvalues, p=p) if lam is None else lam
    out = _storey(_all_adjusted(pvalues, p), lam, False, p, (), "q").drop("_s", *_PLACED)
    if not with_lfdr:
        return out
    from panelyard.operators.grading import family_lfdr

    return family_lfdr(out, p=p)


def false_discovery_rate(decided: DataFrame, *, rejected: str = "rejected", truth: str = "truth") -> DataFrame:
    """One row: false discoveries over discoveries, null without any; a rejected row without known truth raises."""
    known = F.when(F.col(truth).isNull(), F.raise_error(F.lit("a tested candidate has no truth"))).otherwise(F.col(rejected) & ~F.col(truth))
    return decided.agg(F.try_divide(F.sum(known.cast("int")), F.sum(F.col(rejected).cast("int"))).alias("fdr"))


def power(decided: DataFrame, *, rejected: str = "rejected", truth: str = "truth") -> DataFrame:
    """One row: found over true, null when none is true."""
    return decided.agg(F.try_divide(F.sum((F.col(rejected) & F.col(truth)).cast("int")), F.sum(F.col(truth).cast("int"))).alias("power"))


def score(decided: DataFrame, *, rejected: str = "rejected", truth: str = "truth") -> DataFrame:
    """Discoveries, true and false ones, FDR (over at least one), power and precision."""
    r, t = F.col(rejected), F.col(truth)
    return decided.agg(F.count_if(r).alias("discoveries"), F.count_if(r & t).alias("true_discoveries"), F.count_if(r & ~t).alias("false_discoveries"), F.count_if(t).alias("n_true")).select(
        "*",
        (F.col("false_discoveries") / F.greatest("discoveries", F.lit(1))).alias("fdr"),
        F.try_divide("true_discoveries", "n_true").alias("power"),
        F.try_divide("true_discoveries", "discoveries").alias("precision"),
    )
