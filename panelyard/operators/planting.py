"""Planting effects into given returns: what the funnel would have found, had one family earned a given Sharpe ratio.

A plant adds one constant to every return of a family's variants. It moves their means and nothing else: the centred
moments, the lagged sums of the robust variance, the correlations inside the family and every other family stay as they
are. So the returns are read once, for a row of sums a variant; a grid of Sharpe ratios is then arithmetic on such rows,
and the other families' statistics come from one table. No world is simulated, and no returns are planted.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions import normal
from panelyard.operators import multiple_testing as mt
from panelyard.operators import correlation, scan, search, sharpe
from panelyard.plans import funnel


#: Families that some plant could bring below the line are sent to all executors up to this number.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Side:
    """One batch as the plants see it: a row of sums for each variant and span, each family's size and inner correlation, and null statistics.

    ``sums`` is (candidate, family, pos, span, n, mean, m2, m3, m4, a, b, c), with span "search" or "held"; ``null`` has a row
    a family: k, rho, p1, best, p2 and the held-out n_obs and p of the best variant.
    """

    sums: DataFrame
    families: DataFrame
    null: DataFrame
    n_variants: int
    stage1: str
    periods: int


def series_sums(returns: DataFrame, *, method: str = "hac", lags: int | None = None, keys: Sequence[str] = ("candidate",)) -> DataFrame:
    """keys, n, mean, m2, m3, m4, a, b, c: the variance of a Sharpe ratio s of a period is a - b s + c s^2 / 4, whatever the mean.

    With z = (r - mean) / sd and q = z^2 - 1 a ratio's influence is z - s q / 2, so its long-run variance is a quadratic
    in s whose terms are Bartlett-weighted lagged sums of z z, z q and q q, made in one pass. "normal" has a = 1, b = 0, c = 2.
    """
    base = sharpe.moments(returns, keys=keys).withColumnRenamed("n_obs", "n")
    if method == "normal":
        return base.select("*", F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(2.0).alias("c"))
    if method != "hac":
        raise ValueError("method is normal or hac")
    z = (F.col("ret") - F.col("mean")) / F.sqrt("m2")
    rows = returns.where("ret is not null").join(base, list(keys)).where("m2 > 0").withColumn("_z", z).withColumn("_q", F.col("_z") * F.col("_z") - 1)
    series = Window.partitionBy(*keys).orderBy("date")
    most = lags if lags is not None else sharpe.newey_west_lags(int(base.agg(F.max("n")).first()[0] or 2))
    own = F.lit(lags) if lags is not None else sharpe.newey_west_lags(F.col("n"))
    products = []
    for j in range(most + 1):
        zj, qj = (F.col("_z"), F.col("_q")) if not j else (F.lag("_z", j).over(series), F.lag("_q", j).over(series))
        cross = F.col("_z") * F.col("_q") if not j else F.col("_z") * qj + F.col("_q") * zj
        products += [(F.col("_z") * zj).alias(f"_a{j}"), cross.alias(f"_b{j}"), (F.col("_q") * qj).alias(f"_c{j}")]
    summed = rows.select(*keys, *products).groupBy(*keys).agg(*[F.sum(f"_{x}{j}").alias(f"_{x}{j}") for j in range(most + 1) for x in "abc"])
    out = base.join(summed, list(keys), "left")

    def long_run(x: str) -> Column:
        total = F.col(f"_{x}0")
        for j in range(1, most + 1):
            weight = F.when(F.lit(j) <= F.least(own, F.col("n") - 1), 1 - F.lit(j) / (own + 1.0)).otherwise(0.0)
            total = total + (1 if x == "b" else 2) * weight * F.coalesce(f"_{x}{j}", F.lit(0.0))
        return (total / F.col("n")).alias(x)

    return out.select(*base.columns, *[long_run(x) for x in "abc"])


def _tested(sums: DataFrame, moved: Column, periods: int) -> DataFrame:
    """``sums`` with the annual Sharpe ratio, its one-sided p and the sample ratio of series whose mean has ``moved``."""
    live = (F.col("m2") > 0) & (F.col("n") >= 2)
    s = (F.col("mean") + moved) / F.sqrt("m2")
    placed = sums.withColumn("_s", F.when(live, s)).withColumn("variance", F.when(live, F.col("a") - F.col("b") * F.col("_s") + F.col("c") / 4 * F.col("_s") * F.col("_s")))
    z = placed.withColumn("sharpe_ratio", F.col("_s") * math.sqrt(periods)).withColumn("_z", F.try_divide("_s", F.sqrt(F.col("variance") / (F.col("n") - 1))))
    return z.withColumn("p", F.expr(normal.sf_sql("_z"))).withColumn("ratio", F.col("_s") * F.sqrt((F.col("n") - 1) / F.col("n"))).drop("_s", "_z")


def _families(tested: DataFrame, families: DataFrame, stage1: str, by: Sequence[str]) -> DataFrame:
    """by, family, p1, best, p2, held-out n_obs, p, sharpe and variance, from tested rows of both spans."""
    found = tested.where("span = 'search'").groupBy(*by, "family").agg(
        F.min("p").alias("_p"), F.min_by(F.struct(F.col("candidate").alias("best"), F.col("p").alias("p2")), F.when(F.col("ratio").isNotNull(), F.struct((-F.col("ratio")).alias("r"), F.col("pos").alias("o")))).alias("_b")
    )
    out = found.select(*by, "family", "_p", "_b.best", "_b.p2").join(families, "family")
    p1 = search.search_adjusted("_p", "k") if stage1 == "independent" else search.search_adjusted("_p", F.col("k").cast("double"), "rho")
    held = tested.where("span = 'held'").select(*by, F.col("candidate").alias("best"), F.col("n").alias("ho_n_obs"), F.col("p").alias("ho_p"), F.col("sharpe_ratio").alias("ho_sharpe"), F.col("variance").alias("ho_variance"))
    return out.withColumn("p1", p1).drop("_p").join(held, [*by, "best"], "left")


def null_side(returns: DataFrame, *, search_end: str, holdout_start: str, stage1: str = "rho", method: str = "hac", lags: int | None = None, periods: int = 252) -> Side:
    """The batch (date, candidate, family, pos, ret) as it is, with what plants need to know of it.

    A variant without returns in the search period, or flat there, counts in its family's size and is never its best.
    """
    if stage1 not in ("rho", "independent"):
        raise ValueError("a bootstrap reads the returns of each draw: plant it with calibration.plant")
    variants = returns.select("candidate", "family", "pos").distinct()
    span = F.when(F.col("date") <= F.lit(search_end).cast("date"), "search").when(F.col("date") >= F.lit(holdout_start).cast("date"), "held")
    rows = returns.where("ret is not null").withColumn("span", span).where("span is not null")
    sums = scan.kept(series_sums(rows.select("date", "candidate", "span", "ret"), method=method, lags=lags, keys=("candidate", "span")).join(variants, "candidate"))
    sizes = variants.groupBy("family").agg(F.count("*").alias("k"))
    if stage1 == "rho":
        inside = funnel._within_family_correlation(rows.where("span = 'search'").select("date", "candidate", "ret"), variants)
        sizes = sizes.join(inside, "family", "left").withColumn("rho", F.greatest(F.lit(0.0), F.coalesce("rho", F.lit(0.0))))
    else:
        sizes = sizes.withColumn("rho", F.lit(0.0))
    families = scan.kept(sizes)
    null = scan.kept(_families(_tested(sums, F.lit(0.0), periods), families, stage1, ()))
    return Side(sums, families, null, variants.count(), stage1, periods)


def planted(side: Side, targets: Sequence | None, sharpes: Sequence[float], *, vol: float | None = 0.01) -> DataFrame:
    """(target, sharpe, statistics): each target family as it would be with every Sharpe ratio of the grid planted in all its variants.

    A variant earns ``vol`` times the ratio a year more, or its own search spread times it where ``vol`` is None. None
    as targets takes every family. Duplicate targets, unknown ones and a grid that doesn't increase are refused.
    """
    grid = [float(s) for s in sharpes]
    if not grid or any(not math.isfinite(s) or s < 0 for s in grid) or any(b <= a for a, b in zip(grid, grid[1:], strict=False)):
        raise ValueError("the grid must be finite, at least 0 and increasing")
    rows = side.sums
    if targets is not None:
        wanted = list(targets)
        if len(set(wanted)) < len(wanted):
            raise ValueError("a target stands twice: list each family once")
        known = {r["family"] for r in side.families.where(F.col("family").isin(wanted)).collect()}
        if missing := [t for t in wanted if t not in known]:
            raise ValueError(f"not families of this batch: {missing}")
        rows = rows.where(F.col("family").isin(wanted))
    spread = F.lit(vol) if vol is not None else F.coalesce(F.sqrt(F.max(F.when(F.col("span") == "search", F.col("m2"))).over(Window.partitionBy("candidate"))), F.lit(0.0))
    tiled = rows.withColumn("_vol", spread).withColumn("sharpe", F.explode(F.array(*[F.lit(s) for s in grid])))
    tested = _tested(tiled, F.col("sharpe") * F.col("_vol") / math.sqrt(side.periods), side.periods)
    return _families(tested, side.families, side.stage1, ("sharpe",)).withColumnRenamed("family", "target")


def planted_sides(side: Side, targets: Sequence, sharpes: Sequence[float], *, vol: float | None = 0.01) -> DataFrame:
    """(sharpe, family, statistics) of the whole batch with all targets planted at once, a copy for each ratio.

    A row of the null table stands for every family that isn't planted, so the result has families times ratios rows.
    """
    fresh = planted(side, targets, sharpes, vol=vol).withColumnRenamed("target", "family")
    others = side.null.where(~F.col("family").isin(list(targets))).withColumn("sharpe", F.explode(F.array(*[F.lit(float(s)) for s in sharpes])))
    return fresh.unionByName(others)


def _expected_max(rows: DataFrame, trials: str) -> DataFrame:
    """``rows`` with _e, the expected largest of so many standard normals, worked out once for each number."""

    def expect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([normal.expected_max(n) for n in numbers], pa.float64())], names=["_t", "_e"])

    numbers = rows.select(F.col(trials).cast("long").alias("_t")).distinct().mapInArrow(expect, "_t bigint, _e double")
    return rows.join(numbers, F.col(trials) == F.col("_t")).drop("_t")


def decisions(side: Side, th: funnel.Thresholds, targets: Sequence | None, sharpes: Sequence[float], *, vol: float | None = 0.01) -> DataFrame:
    """(target, sharpe, stage1, stage2, stage3, stage4, accepted): one family planted at a time, through every stage of the funnel.

    Stage 1 is Benjamini-Hochberg over all families, the target in place of its null row. Stages 2 and 4 test the target
    whatever happened before, stage 4 beside the other families that live in that world; ``accepted`` is all in order.

    A family whose null p-value is above the line even if one more p-value stood before it, q (rank + 1) / m, can't be
    rejected in any such world, and all that can be form a head of the null ranking. Only those travel to the worlds, each
    once for a target and ratio, and the step-up there keeps the size m of all families.
    """
    if th.stage1 != side.stage1:
        raise ValueError("the side was made for another stage 1")
    fresh = scan.kept(planted(side, targets, sharpes, vol=vol))
    missing = F.raise_error(F.lit("p1 is missing for a family"))
    null = scan.ranked(side.null.withColumn("p1", F.when(F.col("p1").isNull(), missing.cast("double")).otherwise(F.col("p1"))), F.col("p1"), _m=F.count(F.lit(1)))
    reach = F.max(F.when(F.col("p1") <= F.lit(th.q1) * (F.col("_r") + 1) / F.col("_m"), F.col("_r")))
    head = scan.sized(null, _reach=reach).where("_r <= _reach")
    m = side.families.count()
    head = scan.kept(head.select("family", "p1", "p2", "ho_n_obs", "ho_p", "ho_sharpe", "ho_variance"))
    columns = ("family", "p1", "p2", "ho_n_obs", "ho_p", "ho_sharpe", "ho_variance")
    own = fresh.select("target", "sharpe", F.lit(True).alias("own"), F.col("target").alias("family"), *columns[1:])
    beside = fresh.select("target", "sharpe").crossJoin(F.broadcast(head) if head.count() <= BROADCAST_ROWS else head).where("family <> target").withColumn("own", F.lit(False)).select(*own.columns)
    world = ["target", "sharpe"]
    screened = mt._step_up(own.unionAll(beside), F.lit(th.q1) * F.col("_r") / F.lit(m), "p1", world, "stage1")
    second = F.coalesce(F.col("p2") <= th.alpha2, F.lit(False))
    living = screened.withColumn("stage2", second).where("own or (stage1 and stage2)")
    if th.final == "bh":
        last = mt.benjamini_hochberg(living.withColumn("_q", F.coalesce("ho_p", F.lit(1.0))), th.q4, p="_q", by=world, name="stage4")
    else:
        trials = F.lit(side.n_variants) if th.final_trials == "searched" else F.count(F.lit(1)).over(Window.partitionBy(*world))
        best = F.col("_e") / F.sqrt(F.col("ho_n_obs").cast("double")) * math.sqrt(side.periods)
        placed = _expected_max(living.withColumn("_trials", trials.cast("long")), "_trials").withColumn("_b", best)
        last = placed.withColumn("stage4", F.coalesce(F.expr(normal.psr_sql("ho_sharpe", "ho_n_obs", "_b", "ho_variance", side.periods)) >= th.d4, F.lit(False)))
    mine = last.where("own")
    return mine.select("target", "sharpe", "stage1", "stage2", F.lit(True).alias("stage3"), "stage4", (F.col("stage1") & F.col("stage2") & F.col("stage4")).alias("accepted"))


def detectable(decided: DataFrame, level: float) -> DataFrame:
    """(stage, at): the least ratio whose share of passing targets, as a running maximum over the grid, reaches ``level``, between grid points by a line.

    Null where no ratio of the grid reaches it.
    """
    from panelyard.operators import calibration

    names = ("stage1", "stage2", "stage4", "accepted")
    shares = decided.groupBy("sharpe").agg(*[F.avg(F.col(n).cast("double")).alias(n) for n in names])
    curves = shares.select("sharpe", F.explode(F.array(*[F.struct(F.lit(n).alias("stage"), F.col(n).alias("share")) for n in names])).alias("c")).select("sharpe", "c.*")
    return calibration.crossing(curves, level, keys=("stage",), x="sharpe", y="share")


@dataclass(frozen=True)
class Structure:
    """What a batch looks like to a simulator of its like: family sizes in order of family, mean correlations, and lengths."""

    variants: tuple[int, ...]
    within_corr: float
    across_corr: float
    search_periods: int
    holdout_periods: int
    n_trials: int


def correlations(returns: DataFrame) -> DataFrame:
    """One row (within, across): the mean over families of two variants and more of their mean pairwise correlation, and the mean over pairs of different families.

    Where every variant has every date, correlations add up: the mean over dates of the squared sum of a group's
    standardised returns is its size plus twice its correlations, so no pair is made. A batch with gaps is correlated on
    common dates by :mod:`correlation`. A flat variant has no correlation; null without any pair.
    """
    there = scan.kept(returns.where("ret is not null").select("date", "candidate", "family", "ret"))
    each = there.groupBy("candidate").agg(F.first("family").alias("family"), F.count("*").alias("n"), F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("sd"))
    dates = there.select("date").distinct().count()
    if each.where(F.col("n") != dates).isEmpty():
        live = each.where("sd > 0")
        z = there.drop("family").join(live, "candidate").select("date", "family", ((F.col("ret") - F.col("mean")) / F.col("sd")).alias("z"))
        by_family = z.groupBy("date", "family").agg(F.sum("z").alias("s"))
        sizes = live.groupBy("family").agg(F.count("*").alias("k"))
        inner = by_family.groupBy("family").agg(F.avg(F.col("s") * F.col("s")).alias("v")).join(sizes, "family").withColumn("c", F.col("v") - F.col("k"))
        whole = by_family.groupBy("date").agg(F.sum("s").alias("s")).agg(F.avg(F.col("s") * F.col("s")).alias("w"))
        k = F.sum("k")
        sums = inner.agg(F.avg(F.when(F.col("k") > 1, F.col("c") / (F.col("k") * (F.col("k") - 1)))).alias("within"), F.sum("v").alias("v"), k.alias("k"), F.sum(F.col("k") * F.col("k")).alias("kk"))
        return sums.crossJoin(F.broadcast(whole)).select("within", F.try_divide(F.col("w") - F.col("v"), F.col("k") * F.col("k") - F.col("kk")).alias("across"))
    sums = scan.kept(correlation.correlation_sums(there))
    inside, every = sums.where("family is not null"), sums.where("family is null")
    within = inside.agg(F.avg(F.try_divide("s", "n")).alias("within"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("_s"), F.coalesce(F.sum("n"), F.lit(0)).alias("_n"))
    return within.crossJoin(F.broadcast(every.agg(F.sum("s").alias("s"), F.sum("n").alias("n")))).select("within", F.try_divide(F.col("s") - F.col("_s"), F.col("n") - F.col("_n")).alias("across"))


def structure(returns: DataFrame, *, search_end: str, holdout_periods: int, n_trials: int) -> Structure:
    """The structure of a batch's search period, for a gate's report: correlations are clipped to [0, 0.99] across and from there to 1 within."""
    window = returns.where(F.col("date") <= F.lit(search_end).cast("date"))
    sizes = [r["k"] for r in returns.groupBy("family").agg(F.countDistinct("candidate").alias("k")).orderBy("family").collect()]
    found = correlations(window).first()
    across = min(max(found["across"] or 0.0, 0.0), 0.99)
    within = min(max(across if found["within"] is None else found["within"], across), 1.0)
    return Structure(tuple(sizes), within, across, window.select("date").distinct().count(), holdout_periods, n_trials)
