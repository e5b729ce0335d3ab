"""Point-in-time rules for daily market data: missing returns, spreads, availability, links, spells, delistings, universe."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FAR_FUTURE = "9999-12-31"
DELIST_MAX_GAP = 10
FALLBACK_DAYS = 90
SPREAD_ROWS, SPREAD_LEAST = 21, 5
#: Securities of failed banks, the actions of performance delistings, and the return each stands for.
FAILED_BANKS, BANK_RETURN = (11786, 90090), -1.0
PERFORMANCE_ACTIONS, PERFORMANCE_RETURN = ("GDR", "GLI", "GEX"), -0.5
#: Wider quotes are bad quotes.
MAX_SPREAD = 0.05


def by_security():
    """Each security's rows in order of date."""
    return Window.partitionBy("permno").orderBy("date")


def flag(c: str):
    """A membership flag that may arrive as a number or be missing: unknown counts as out."""
    return F.coalesce(F.col(c).cast("boolean"), F.lit(False))


def daily_returns(daily: DataFrame, *, failed_banks: tuple[int, ...] = FAILED_BANKS) -> DataFrame:
    """Adds ``ret`` to (permno, date, dlyret, dlyretmissflg, dlydelflg, delactiontype).

    A recorded return stands. A missing one is 0 on a first day (NS) or without a price (MP); on a delisting row it
    is -100% for a failed bank and -50% for the performance actions, else null; on the first untracked day (NT)
    after a tracked one it is -50%, and null on later ones.
    """
    untracked = F.coalesce(F.col("dlyretmissflg") == "NT", F.lit(False))
    first = untracked & ~F.lag(untracked, 1, True).over(by_security())
    gone = F.coalesce(F.col("dlydelflg") == "Y", F.lit(False))
    value = (
        F.when(F.col("dlyret").isNotNull(), F.col("dlyret"))
        .when(first, PERFORMANCE_RETURN)
        .when(gone & F.col("permno").isin(*failed_banks), BANK_RETURN)
        .when(gone & F.col("delactiontype").isin(*PERFORMANCE_ACTIONS), PERFORMANCE_RETURN)
        .when(F.col("dlyretmissflg").isin("NS", "MP"), 0.0)
    )
    return daily.withColumn("ret", value)


def quoted_spread(daily: DataFrame) -> DataFrame:
    """Adds ``spread``: (ask - bid) over the midpoint, for ask > bid > 0 and a spread of at most ``MAX_SPREAD``.

    Without one, the median of the security's previous 21 rows if at least five are valid; else the day's median
    over the universe.
    """
    width = F.try_divide(F.col("dlyask") - F.col("dlybid"), (F.col("dlyask") + F.col("dlybid")) / 2)
    quoted = daily.withColumn("_q", F.when((F.col("dlybid") > 0) & (F.col("dlyask") > F.col("dlybid")) & (width <= MAX_SPREAD), width))
    back = by_security().rowsBetween(-SPREAD_ROWS, -1)
    trailing = F.when(F.count("_q").over(back) >= SPREAD_LEAST, F.percentile("_q", F.lit(0.5)).over(back))
    day = F.percentile(F.when(flag("in_universe"), F.col("_q")), F.lit(0.5)).over(Window.partitionBy("date"))
    return quoted.withColumn("_t", trailing).withColumn("spread", F.coalesce("_q", "_t", day)).drop("_q", "_t")


def available_from(facts: DataFrame, calendar: DataFrame, *, report: str | None = "rdq", period: str = "datadate") -> DataFrame:
    """Adds ``available``: the first trading day strictly after the report date, or after the period's end plus 90 days.

    Null past the calendar's end. A strict forward as-of join as an equi-join: each trading day stands for the span of
    base dates that lead to it, and spans are written out day by day, so the small, bounded side has one row for each
    calendar day and the facts are matched by equality.
    """
    fallback = F.date_add(F.col(period), FALLBACK_DAYS)
    base = F.coalesce(F.col(report), fallback) if report else fallback
    days = calendar.select(F.col("date").alias("available")).distinct()
    spans = days.withColumn("_from", F.lag("available").over(Window.orderBy("available")))
    inner = spans.where("_from is not null").select("available", F.explode(F.sequence("_from", F.date_sub("available", 1))).alias("_base"))
    first = days.agg(F.min("available").alias("_first"))
    keyed = facts.withColumn("_base", base).crossJoin(F.broadcast(first))
    hit = keyed.join(inner, "_base", "left")
    return hit.withColumn("available", F.when(F.col("_base") < F.col("_first"), F.col("_first")).otherwise(F.col("available"))).drop("_base", "_first")


def primary_links(link: DataFrame) -> DataFrame:
    """Primary, reliable links with a security; an open end becomes a far date, to be compared and never subtracted."""
    return link.where(F.col("linktype").isin("LU", "LC") & F.col("linkprim").isin("P", "C") & F.col("lpermno").isNotNull()).withColumn("linkenddt", F.coalesce("linkenddt", F.lit(FAR_FUTURE).cast("date")))


def interval_join(facts: DataFrame, spells: DataFrame, *, key: str, date: str, start: str, end: str, how: str = "inner") -> DataFrame:
    """Facts with the spells of their key that hold their date: a hash join on the key, the range as a residual."""
    other = spells.withColumnRenamed(key, "_key")
    joined = facts.join(other, (F.col(key) == F.col("_key")) & F.col(date).between(F.col(start), F.col(end)), how)
    return joined if how in ("left_semi", "left_anti") else joined.drop("_key")


def member_flag(facts: DataFrame, spells: DataFrame, *, key: str = "permno", date: str = "date", start: str = "start", end: str = "ending", name: str = "in_index") -> DataFrame:
    """Adds whether any spell of the key holds the date; several spells never multiply rows."""
    inside = interval_join(facts.select(key, date).distinct(), spells.select(key, start, end), key=key, date=date, start=start, end=end, how="left_semi").withColumn(name, F.lit(True))
    return facts.join(inside, [key, date], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def spells_in(spells: DataFrame, start: str, end: str, *, begin: str = "start", stop: str = "ending") -> DataFrame:
    """Spells that overlap [start, end], their end clamped, and ``censored`` where it reaches the last known end or the window's."""
    last = spells.agg(F.max(stop).alias("_last"))
    hit = spells.where((F.col(stop) >= F.lit(start).cast("date")) & (F.col(begin) <= F.lit(end).cast("date"))).crossJoin(F.broadcast(last))
    return hit.withColumn("censored", F.col(stop) >= F.least(F.lit(end).cast("date"), F.col("_last"))).withColumn(stop, F.least(F.col(stop), F.lit(end).cast("date"))).drop("_last")


def admit_delistings(admitted: DataFrame, delistings: DataFrame, *, key: str = "permno", value: str = "dlret") -> DataFrame:
    """Admitted rows merged one to one with delisting rows within ten days of the security's last admitted row."""
    last = admitted.groupBy(key).agg(F.max("date").alias("_last"))
    near = delistings.join(last, key).where((F.col("date") >= F.col("_last")) & (F.datediff("date", "_last") <= DELIST_MAX_GAP)).groupBy(key, "date").agg(F.max(value).alias(value))
    return admitted.join(near, [key, "date"], "full_outer")


def attach(facts: DataFrame, dimension: DataFrame, key: str, columns: list[str], when: str) -> DataFrame:
    """Many-to-one left join of attributes, null unless ``when`` holds on the row; a key twice in the dimension raises."""
    checked = dimension.groupBy(key).agg(*[F.max(c).alias(c) for c in columns], F.count("*").alias("_n")).withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.lit(f"{key} is not unique in the dimension"))).otherwise(True))
    joined = facts.join(checked, key, "left").where(F.coalesce("_ok", F.lit(True)))
    for c in columns:
        joined = joined.withColumn(c, F.when(F.expr(when), F.col(c)))
    return joined.drop("_n", "_ok")


UNIVERSE = "sharetype = 'NS' and securitytype = 'EQTY' and securitysubtype = 'COM' and usincflg = 'Y' and issuertype in ('ACOR', 'CORP') and primaryexch in ('N', 'A', 'Q')"
DESCRIPTORS = ("sharetype", "securitytype", "securitysubtype", "usincflg", "issuertype", "primaryexch")


def universe_flag(daily: DataFrame, *, predicate: str = UNIVERSE, descriptors: tuple[str, ...] = DESCRIPTORS, status: str = "tradingstatusflg", member: str = "in_sp500") -> DataFrame:
    """Adds ``in_universe``: index membership and the descriptor rules, a delisted row judged by the row before."""
    alive = F.coalesce(F.col(status) != "D", F.lit(True))
    run = by_security().rowsBetween(Window.unboundedPreceding, 0)
    judged = daily
    for c in descriptors:
        judged = judged.withColumn(f"_{c}", F.last(F.when(alive, F.col(c)), ignorenulls=True).over(run))
    rule = predicate
    for c in descriptors:
        rule = rule.replace(f"{c} ", f"_{c} ")
    return judged.withColumn("in_universe", F.coalesce(F.expr(rule), F.lit(False)) & flag(member)).drop(*[f"_{c}" for c in descriptors])


def permute_cross_section(rows: DataFrame, seed: int, *, key: str = "permno", identity: tuple[str, ...] = ()) -> DataFrame:
    """Within each date, identities (the key and its companions) are dealt anew to the payload rows, always as a tuple.

    Two orders of the same date are joined on their position: one by key, one by a seeded hash.
    """
    names = [key, *identity]
    by_key = Window.partitionBy("date").orderBy(key)
    by_hash = Window.partitionBy("date").orderBy(F.xxhash64(F.lit(seed), F.col("date").cast("string"), F.col(key)), key)
    ids = rows.select("date", *names, F.row_number().over(by_key).alias("_n"))
    payload = rows.drop(*identity).withColumn("_n", F.row_number().over(by_hash)).drop(key)
    return payload.join(ids, ["date", "_n"]).select(*rows.columns)


def placebo(rows: DataFrame, method: str, seed: int, version: str, *, identity: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """(rows, version id): passed through for "none", permuted for "permute"; the id names what was done."""
    if method == "none":
        return rows, version
    if method == "permute":
        return permute_cross_section(rows, seed, identity=identity), f"{version}+permute-{seed}"
    raise ValueError(f"unknown placebo method {method!r}")
