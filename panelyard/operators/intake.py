"""What a batch of candidate returns must satisfy before any statistic is computed, as aggregates and anti-joins."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Returns that a tested period needs for each candidate.
LEAST_RETURNS = 2
#: Offenders that a message names; how many there are is always said.
NAMED = 10


@dataclass(frozen=True)
class Intake:
    """Returns (date, candidate, ret) with families (candidate, family) and where they came from."""

    returns: DataFrame
    family: DataFrame
    generator: str
    source: dict = field(default_factory=dict)


def problems(returns: DataFrame, family: DataFrame) -> DataFrame:
    """(problem, offender): every breach of the contract between returns and families, for each side in one pass.

    Problems: a repeated (candidate, date), a null date, an infinite return, a candidate without returns, a candidate
    without or with more than one family, a blank family, a label of an unknown candidate.
    """
    name = F.col("candidate").cast("string").alias("offender")
    cells = returns.groupBy("candidate", "date").agg(F.count("*").alias("n"))
    each = returns.groupBy("candidate").agg(
        F.count_if(F.col("date").isNull()).alias("undated"), F.count_if(F.col("ret").isin(float("inf"), float("-inf"))).alias("infinite"), F.count_if(F.col("ret").isNotNull() & ~F.isnan("ret")).alias("there")
    )
    labels = family.groupBy("candidate").agg(F.count("*").alias("n"), F.count("family").alias("known"), F.count_if(F.trim(F.col("family").cast("string")) == "").alias("blank"))
    both = each.join(labels, "candidate", "full_outer")
    wrong = F.array_compact(
        F.array(
            F.when(F.col("undated") > 0, "a date is missing"), F.when(F.col("infinite") > 0, "returns must be finite"), F.when(F.col("there") == 0, "no returns at all"),
            F.when(F.col("there").isNotNull() & (F.coalesce("known", F.lit(0)) == 0), "no family"), F.when(F.col("n") > 1, "more than one family"), F.when(F.col("blank") > 0, "blank family"),
            F.when(F.col("there").isNull(), "label of an unknown candidate"),
        )
    )
    repeated = cells.where("n > 1").select(F.lit("a date repeats").alias("problem"), name).distinct()
    return repeated.unionByName(both.select(F.explode(wrong).alias("problem"), name))


def _refuse(found: DataFrame, what: str = "") -> None:
    rows = found.groupBy("problem").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("offender")), 1, NAMED).alias("some")).orderBy("problem").collect()
    if rows:
        raise ValueError(what + "; ".join(f"{r['problem']} ({r['n']}): {', '.join(r['some'])}" for r in rows))


def check_dates(returns: DataFrame, date: str = "date") -> None:
    """Dates must be plain days: a date column, or time stamps without zone at midnight."""
    kind = returns.schema[date].dataType
    if isinstance(kind, T.DateType):
        return
    if not isinstance(kind, T.TimestampNTZType):
        raise TypeError("returns need a column of dates without time zone")
    if not returns.where(F.col(date) != F.date_trunc("day", date)).isEmpty():
        raise ValueError("dates must be at midnight")


def check(returns: DataFrame, family: DataFrame, generator: str) -> None:
    """Raise with every problem and its first offenders."""
    if not generator or not generator.strip():
        raise ValueError("generator must name what produced the candidates")
    check_dates(returns)
    if returns.isEmpty():
        raise ValueError("returns has no candidates or no dates")
    _refuse(problems(returns, family))


def period_shortfalls(returns: DataFrame, search_end: str, holdout_start: str | None = None, *, least: int = LEAST_RETURNS) -> DataFrame:
    """(period, candidate, n): candidates with under ``least`` returns in a period, none at all included."""
    there = F.col("ret").isNotNull() & ~F.isnan("ret")
    periods = [("search", F.col("date") <= F.lit(search_end).cast("date"))] + ([("holdout", F.col("date") >= F.lit(holdout_start).cast("date"))] if holdout_start else [])
    counts = returns.groupBy("candidate").agg(*[F.count_if(there & inside).alias(name) for name, inside in periods])
    long = counts.select("candidate", F.explode(F.array(*[F.struct(F.lit(name).alias("period"), F.col(name).alias("n")) for name, _ in periods])).alias("x"))
    return long.select("x.period", "candidate", "x.n").where(F.col("n") < least)


def check_periods(returns: DataFrame, *, search_end: str, holdout_start: str | None = None) -> None:
    """Every candidate needs enough returns up to ``search_end``; the cuts must be in order."""
    if holdout_start is not None and holdout_start <= search_end:
        raise ValueError("the holdout must start after the search period")
    check_dates(returns)
    short = period_shortfalls(returns, search_end)
    _refuse(short.select(F.lit(f"fewer than {LEAST_RETURNS} returns in the search period").alias("problem"), F.col("candidate").cast("string").alias("offender")))


def from_returns(returns: DataFrame, family: DataFrame, *, generator: str, source: dict | None = None, search_end: str | None = None, holdout_start: str | None = None) -> Intake:
    """A checked batch without the dates on which no candidate has a return; how many went is kept with its span."""
    check(returns, family, generator)
    if search_end is not None:
        check_periods(returns, search_end=search_end, holdout_start=holdout_start)
    there = returns.where(F.col("ret").isNotNull() & ~F.isnan("ret")).select("date").distinct()
    kept = returns.join(there, "date", "left_semi")
    spans = returns.select("date").distinct().join(there.withColumn("_t", F.lit(True)), "date", "left").agg(F.count_if(F.col("_t").isNull()).alias("gone"), F.min(F.when(F.col("_t"), F.col("date"))).alias("a"), F.max(F.when(F.col("_t"), F.col("date"))).alias("b")).first()
    return Intake(kept, family, generator, {**(source or {}), "n_dropped_rows": spans["gone"], "start": str(spans["a"])[:10], "end": str(spans["b"])[:10]})


def check_holdout(frame: DataFrame, wanted: list[str], *, start: str, end: str | None = None) -> None:
    """Exactly the wanted candidates, dates inside the window, none twice, all finite."""
    ids = frame.sparkSession.createDataFrame([(c,) for c in wanted], "offender string")
    have = frame.select(F.col("candidate").cast("string").alias("offender"), "date", "ret")
    outside = (F.col("date") < F.lit(start).cast("date")) | (F.col("date") > F.lit(end).cast("date") if end else F.lit(False))
    found = [
        ids.join(have, "offender", "left_anti").select(F.lit("not delivered").alias("problem"), "offender"),
        have.select("offender").distinct().join(ids, "offender", "left_anti").select(F.lit("not asked for").alias("problem"), "offender"),
        have.where(outside | F.col("date").isNull()).select(F.lit("a date outside the window").alias("problem"), "offender").distinct(),
        have.groupBy("offender", "date").count().where("count > 1").select(F.lit("a date repeats").alias("problem"), "offender").distinct(),
        have.where(F.col("ret").isin(float("inf"), float("-inf"))).select(F.lit("returns must be finite").alias("problem"), "offender").distinct(),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    _refuse(out, "holdout: ")
