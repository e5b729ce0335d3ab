"""From variants to accepted families: family statistics, screening stages, and the final gate on held-out data."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators import correlation, ledger, scan, search, sharpe
from panelyard.operators import multiple_testing as mt

STAGE1, FINAL, TRIALS = ("rho", "independent", "bootstrap"), ("bh", "dsr"), ("survivors", "searched")
HOLDOUT = ("n_obs", "sharpe", "skew", "kurtosis", "variance", "p")


@dataclass(frozen=True, kw_only=True)
class Thresholds:
    """One setting of the funnel, checked when it is made."""

    q1: float = 0.10
    stage1: str = "rho"
    alpha2: float = 1.0
    final: str = "bh"
    d4: float = 0.95
    q4: float = 0.30
    final_trials: str = "survivors"

    def __post_init__(self) -> None:
        if self.stage1 not in STAGE1 or self.final not in FINAL or self.final_trials not in TRIALS:
            raise ValueError("unknown method")
        for name in ("q1", "alpha2", "d4", "q4"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int | float):
                raise TypeError(f"{name} must be a number")
            if not 0 < value < 1 and not (name == "alpha2" and value == 1):
                raise ValueError(f"{name} out of range")
            object.__setattr__(self, name, float(value))


def best_by_family(values: DataFrame, *, value: str = "value") -> DataFrame:
    """(family, best): the variant with the largest value, the first in position on ties; null where a family has no value."""
    ranked = values.withColumn("_r", F.row_number().over(Window.partitionBy("family").orderBy(F.col(value).desc_nulls_last(), "pos")))
    return ranked.where("_r = 1").select("family", F.when(F.col(value).isNotNull(), F.col("candidate")).alias("best"))


def family_statistics(returns: DataFrame, *, search_end: str, holdout_start: str | None = None, n_boot: int = 0, seed: int = 0, q: float = 0.05, periods: int = 252, correlated: bool = True) -> tuple[DataFrame, int]:
    """(statistics, variants) of (date, candidate, family, pos, ret).

    A family has its best variant over the search period, its size k, three family p-values (independent, with its own
    mean correlation, bootstrapped), the best variant's p-value, and held-out statistics of that variant alone. Rows of
    ``holdout_start`` and later are read only for variants that are carried. Unless ``correlated``, rho is 0 unread.
    """
    variants = returns.select("candidate", "family", "pos").distinct()
    window = returns.where((F.col("date") <= F.lit(search_end).cast("date")) & F.col("ret").isNotNull())
    tests = scan.kept(sharpe.sharpe_test(window, periods=periods).join(variants, "candidate"))
    n_variants = variants.count()
    naive = scan.kept(_naive(tests, n_variants, periods))
    ratios = window.groupBy("candidate").agg(F.try_divide(F.avg("ret"), F.stddev_samp("ret")).alias("value")).join(variants, "candidate", "right")
    best = best_by_family(ratios)
    naive_best = best_by_family(naive.where("stacked").join(ratios.select("candidate", "value"), "candidate")).withColumnRenamed("best", "naive_best")
    inside = scan.kept(_within_family_correlation(window, variants)) if correlated else variants.select("family", F.lit(0.0).alias("rho")).distinct()
    sized = tests.groupBy("family").agg(F.min("pvalue_greater").alias("p")).join(variants.groupBy("family").agg(F.count("*").alias("k")), "family").join(inside, "family", "left").withColumn("rho", F.greatest(F.lit(0.0), F.coalesce("rho", F.lit(0.0))))
    stats = sized.select("family", "k", "rho", search.search_adjusted("p", "k").alias("p1_independent"), search.search_adjusted("p", F.col("k").cast("double"), "rho").alias("p1_rho"))
    if n_boot:
        boot = search.bootstrap_family_pvalues(window.select("date", "candidate", "family", "pos", "ret"), n_boot=n_boot, seed=seed)
        stats = stats.join(boot.select("family", F.col("pvalue").alias("p1_bootstrap")), "family", "left")
    else:
        stats = stats.withColumn("p1_bootstrap", F.lit(None).cast("double"))
    p2 = tests.select(F.col("candidate").alias("best"), F.col("pvalue_greater").alias("p2"))
    stats = stats.join(best, "family").join(p2, "best", "left").join(naive_best, "family", "left").withColumn("naive_pass", F.col("naive_best").isNotNull())
    if holdout_start is not None:
        held = returns.where((F.col("date") >= F.lit(holdout_start).cast("date")) & F.col("ret").isNotNull())
        for prefix, chosen in (("ho_", "best"), ("nv_", "naive_best")):
            stats = stats.join(holdout_statistics(held, stats.select(chosen).where(f"{chosen} is not null").distinct().withColumnRenamed(chosen, "candidate"), prefix, periods).withColumnRenamed("candidate", chosen), chosen, "left")
    return stats, n_variants


def split_statistics(returns: DataFrame, *, search_end: str, stage2_start: str, holdout_start: str | None = None, n_boot: int = 0, seed: int = 0, q: float = 0.05, periods: int = 252) -> tuple[DataFrame, int]:
    """As :func:`family_statistics` in the split design: stage 1 sees the search period before ``stage2_start``, p2 the rest of it.

    The naive stack's columns come from the whole search period in either design. A best variant without returns in
    the second part has a null p2 and so can't pass stage 2.
    """
    cut, end = F.lit(stage2_start).cast("date"), F.lit(search_end).cast("date")
    early = returns.where(F.col("date") < cut)
    second = returns.where((F.col("date") >= cut) & (F.col("date") <= end) & F.col("ret").isNotNull())
    if stage2_start > search_end or early.isEmpty() or second.isEmpty():
        raise ValueError("stage2_start must leave search dates for both stages")
    first, n_variants = family_statistics(early, search_end=search_end, n_boot=n_boot, seed=seed, q=q, periods=periods)
    whole, _ = family_statistics(returns, search_end=search_end, holdout_start=holdout_start, periods=periods, correlated=False)
    naive = whole.select("family", *[c for c in whole.columns if c.startswith(("naive_", "nv_"))])
    confirmed = sharpe.sharpe_test(second.join(first.select(F.col("best").alias("candidate")).distinct(), "candidate", "left_semi"), periods=periods)
    stats = first.drop("p2", "naive_best", "naive_pass").join(confirmed.select(F.col("candidate").alias("best"), F.col("pvalue_greater").alias("p2")), "best", "left").join(naive, "family", "left")
    if holdout_start is not None:
        held = returns.where((F.col("date") >= F.lit(holdout_start).cast("date")) & F.col("ret").isNotNull())
        chosen = first.select(F.col("best").alias("candidate")).where("candidate is not null").distinct()
        stats = stats.join(holdout_statistics(held, chosen, "ho_", periods).withColumnRenamed("candidate", "best"), "best", "left")
    return stats, n_variants


def holdout_statistics(held: DataFrame, chosen: DataFrame, prefix: str = "ho_", periods: int = 252) -> DataFrame:
    """Held-out tests of the chosen variants only: a semi-join before anything is computed."""
    tests = sharpe.sharpe_test(held.join(chosen, "candidate", "left_semi"), periods=periods).withColumnRenamed("pvalue_greater", "p")
    return tests.select("candidate", *[F.col(c).alias(prefix + c) for c in HOLDOUT])


def _naive(tests: DataFrame, n_variants: int, periods: int) -> DataFrame:
    """Every screening method as a gate at once, on every variant."""
    p = mt.all_adjusted(sharpe.deflated(tests, n_variants, periods=periods), p="pvalue_greater")
    return p.withColumn("stacked", F.coalesce((F.col("holm") <= 0.05) & (F.col("by") <= 0.05) & (F.col("bh") <= 0.05) & (F.col("psr") >= 0.95) & (F.col("dsr") >= 0.95), F.lit(False)))


def _within_family_correlation(window: DataFrame, variants: DataFrame) -> DataFrame:
    """(family, rho): mean pairwise correlation inside each family; variants meet within a family, never across families."""
    rows = window.select("date", "candidate", "ret").join(variants.select("candidate", "family"), "candidate")
    return correlation.correlation_sums(rows, across=False).select("family", F.try_divide("s", "n").alias("rho"))


def screen(stats: DataFrame, th: Thresholds, *, stage1: str | None = None) -> DataFrame:
    """Adds stage1 (Benjamini-Hochberg over families), stage2 (the best variant's p) and stage3 (passed through until spanning is measured)."""
    p = f"p1_{stage1 or th.stage1}"
    checked = stats.withColumn(p, F.when(F.col(p).isNull(), F.raise_error(F.lit(f"{p} is missing for a family"))).otherwise(F.col(p)))
    out = mt.benjamini_hochberg(checked, th.q1, p=p, name="stage1")  # cuts lineage: what follows reads one row a family
    return out.withColumn("stage2", F.col("stage1") & F.coalesce(F.col("p2") <= th.alpha2, F.lit(False))).withColumn("stage3", F.col("stage2"))


def final_gate(stats: DataFrame, th: Thresholds, n_variants: int, *, alive: str = "stage3", prefix: str = "ho_", min_obs: int | None = None, periods: int = 252) -> DataFrame:
    """Adds stage4 on held-out statistics of the families still alive; one that is flat or not covered fails and still counts."""
    live = F.col(alive)
    read = live if min_obs is None else live & F.coalesce(F.col(f"{prefix}n_obs") >= min_obs, F.lit(False))
    if th.final == "bh":
        marked = stats.withColumn("_p", F.when(live, F.coalesce(F.when(read, F.col(f"{prefix}p")), F.lit(1.0))))
        return mt.benjamini_hochberg(marked, th.q4, p="_p", name="stage4").drop("_p")
    n_alive = stats.where(live).count()
    tests = stats.withColumn("sharpe", F.col(f"{prefix}sharpe")).withColumn("n_obs", F.col(f"{prefix}n_obs")).withColumn("variance", F.col(f"{prefix}variance"))
    scored = sharpe.deflated(tests, n_variants if th.final_trials == "searched" else max(1, n_alive), periods=periods, name="_dsr")
    return scored.withColumn("stage4", F.coalesce(read & (F.col("_dsr") >= th.d4), F.lit(False))).drop("_dsr", "sharpe", "n_obs", "variance")


def run_funnel(stats: DataFrame, th: Thresholds, n_variants: int, *, stage1: str | None = None, min_obs: int | None = None, periods: int = 252) -> DataFrame:
    return final_gate(screen(stats, th, stage1=stage1), th, n_variants, min_obs=min_obs, periods=periods)


def run_baseline(stats: DataFrame, *, q: float = 0.1, stage1: str = "rho") -> DataFrame:
    """Benjamini-Hochberg over family p-values alone."""
    return mt.benjamini_hochberg(stats, q, p=f"p1_{stage1}", name="accepted")


def gate_report(stages: DataFrame, truth: DataFrame) -> DataFrame:
    """(stage, truth, entering, passing): the flow of families through the stages."""
    rows = stages.join(truth, "family")
    names = ["stage1", "stage2", "stage3", "stage4"]
    parts = F.array(*[F.struct(F.lit(n).alias("stage"), (F.lit(True) if i == 0 else F.col(names[i - 1])).alias("before"), F.col(n).alias("after")) for i, n in enumerate(names)])
    return rows.select("truth", F.explode(parts).alias("s")).groupBy("s.stage", "truth").agg(F.count_if("s.before").alias("entering"), F.count_if(F.col("s.before") & F.col("s.after")).alias("passing"))


@dataclass(frozen=True)
class GateConfig:
    """A registered, single-look decision: what is searched, what is held out, and the thresholds."""

    name: str
    search_end: str
    holdout_start: str
    holdout_end: str
    thresholds: Thresholds
    n_boot: int = 0
    coverage: float = 0.5

    @property
    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


def _events(path: str) -> list[dict]:
    try:
        with open(path, encoding="utf-8") as f:
            return [json.loads(line) for line in f if line.strip()]
    except FileNotFoundError:
        return []


def register(config: GateConfig, path: str) -> bool:
    """Adds the configuration to the ledger once; whether it was new."""
    if any(e.get("name") == "gate-registered" and e["params"]["config_hash"] == config.digest for e in _events(path)):
        return False
    ledger.append(path, {"name": "gate-registered", "params": {"config_hash": config.digest, "gate": config.name}})
    return True


def run_gate(config: GateConfig, returns: DataFrame, path: str, *, holdout: Callable[[list[str]], DataFrame], authorizer: str, periods: int = 252) -> DataFrame:
    """The scorecard of a registered gate that may look at held-out data once.

    Survivors are collected and the look is written to the ledger before ``holdout`` is called: an action barrier, so
    that lazy evaluation can't read held-out rows first. The survivors are families, at most as many as were registered.
    """
    if not authorizer.strip():
        raise PermissionError("a gate needs a named authorizer")
    events = [e for e in _events(path) if (e.get("params") or {}).get("config_hash") == config.digest]
    if not any(e["name"] == "gate-registered" for e in events):
        raise PermissionError("this configuration isn't registered")
    if any(e["name"] == "gate-look" for e in events):
        raise PermissionError("the look of this configuration is spent")
    if returns.where(F.col("date") > F.lit(config.search_end).cast("date")).limit(1).count():
        raise ValueError("returns run past the search period")
    stats, n_variants = family_statistics(returns, search_end=config.search_end, n_boot=config.n_boot, periods=periods)
    screened = screen(stats, config.thresholds)
    chosen = [r["best"] for r in screened.where("stage3").select("best").collect()]
    ledger.append(path, {"name": "gate-look", "params": {"config_hash": config.digest, "authorizer": authorizer, "variants": sorted(map(str, chosen))}})
    spark = returns.sparkSession
    held = holdout(chosen)
    if held.where(~F.col("date").between(F.lit(config.holdout_start).cast("date"), F.lit(config.holdout_end).cast("date"))).limit(1).count():
        raise ValueError("held-out rows outside the registered window")
    ids = spark.createDataFrame([(c,) for c in chosen], f"candidate {returns.schema['candidate'].dataType.simpleString()}")
    tests = holdout_statistics(held.where("ret is not null"), ids, periods=periods).withColumnRenamed("candidate", "best")
    days = spark.sql(f"select count_if(dayofweek(d) not in (1, 7)) from (select explode(sequence(date'{config.holdout_start}', date'{config.holdout_end}')) d)").first()[0]
    need = -(-config.coverage * days // 1)
    out = final_gate(screened.join(tests, "best", "left"), config.thresholds, n_variants, min_obs=int(need), periods=periods)
    return out.withColumn("accepted", F.col("stage3") & F.col("stage4")).withColumn("config_hash", F.lit(config.digest))


def write_scorecard(card: DataFrame, path: str) -> None:
    """CSV with a header, null as empty; one row a family."""
    card.coalesce(1).write.mode("overwrite").csv(path, header=True, nullValue="")


def read_scorecard(spark, path: str, schema: str) -> DataFrame:
    """The CSV under an explicit schema, labels as text; a flag other than true or false raises."""
    return spark.read.csv(path, header=True, schema=schema, nullValue="", mode="FAILFAST")
