"""Append-only ledgers: counting trials after corrections and retractions, searches by hypothesis, latest views."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelyard.functions import typed_json as tj
from panelyard.operators import scan

CORRECTION = "ledger-correction"
SCHEMA = "ts_utc string, user string, git_sha string, name string, seed bigint, params string, metrics string, tags array<string>, notes string"


def append(path: str, entry: dict) -> None:
    """One JSON line, written and synced by a single writer; a torn last line is closed first."""
    line = json.dumps(entry, sort_keys=True, allow_nan=False)
    with open(path, "a+b") as f:
        f.seek(0, os.SEEK_END)
        if f.tell():
            f.seek(-1, os.SEEK_END)
            if f.read(1) != b"\n":
                f.write(b"\n")
        f.write(line.encode() + b"\n")
        f.flush()
        os.fsync(f.fileno())


def read(spark: SparkSession, path: str) -> DataFrame:
    """The ledger in line order: line, ts_utc, ..., params and metrics as JSON text. A line that isn't JSON raises."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "raw")).where(F.length(F.trim("raw")) > 0)
    parsed = lines.select(F.col("line"), F.from_json("raw", SCHEMA, {"mode": "FAILFAST"}).alias("e"))
    return parsed.select("line", "e.*")


def in_scope(*, name: str | None = None, include_tags: Sequence[str] | str | None = None, exclude_tags: Sequence[str] | str | None = None) -> Column:
    """Entries of a name, with any of some tags, with none of others; one tag may be given as plain text."""
    listed = lambda t: [t] if isinstance(t, str) else list(t)
    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
    out = F.lit(True) if name is None else F.coalesce(F.col("name") == name, F.lit(False))
    if include_tags is not None:
        out = out & F.arrays_overlap(tags, F.array(*map(F.lit, listed(include_tags))))
    if exclude_tags is not None:
        out = out & ~F.arrays_overlap(tags, F.array(*map(F.lit, listed(exclude_tags))))
    return out


def corrected(numbered: Iterable[tuple[int, dict]]) -> tuple[list[dict], list[dict], int]:
    """(trials, excluded, unmatched) of a ledger in order.

    A correction excludes earlier entries by name, time and any parameters it lists; a later retraction undoes it,
    and may itself be retracted. Items take the earliest entry they fit, one each. An entry with metrics was seen and
    stays a trial. This is one sequential pass over one ledger; :func:`trial_count` groups by ledger name first.
    """
    entries = list(numbered)
    same = lambda x: json.dumps(x, sort_keys=True)
    fixes: list[tuple[int, dict]] = []
    known: set[str] = set()
    for at, (line, e) in enumerate(entries):
        if e.get("name") != CORRECTION or same(e) in known:
            continue
        known.add(same(e))
        p = e.get("params") or {}
        if not isinstance(p.get("reason"), str) or not p["reason"].strip() or ("retracts" in p) == ("excludes" in p):
            raise ValueError(f"line {line}: a correction needs a reason and either excludes or retracts")
        fixes.append((at, e))
    undone: set[int] = set()
    wanted: dict[tuple[str, str], list[list]] = {}
    for at, e in reversed(fixes):
        if at in undone:
            continue
        p = e["params"]
        if "retracts" in p:
            for ts in p["retracts"]:
                targets = [b for b, f in fixes if b < at and f["ts_utc"] == ts]
                if not targets:
                    raise ValueError(f"retracts {ts!r}, which is no earlier correction")
                undone.update(targets)
    for at, e in fixes:
        if at not in undone and "excludes" in e["params"]:
            for item in e["params"]["excludes"]:
                wanted.setdefault((e["params"]["ledger_name"], item["ts_utc"]), []).append([at, item, False])
    trials, excluded = [], []
    for at, (_, e) in enumerate(entries):
        if e.get("name") == CORRECTION:
            continue
        params = e.get("params") or {}
        fits = (w for w in wanted.get((e.get("name"), e.get("ts_utc")), ()) if not w[2] and w[0] > at and all(k in params and same(params[k]) == same(v) for k, v in w[1].items() if k != "ts_utc"))
        hit = next(fits, None)
        if hit:
            hit[2] = True
            excluded.append(e)
        if not hit or e.get("metrics"):
            trials.append(e)
    return trials, excluded, sum(not w[2] for group in wanted.values() for w in group)


def entries_for(ledger: DataFrame, name: str, config_hash: str) -> DataFrame:
    """The entries of a name that were logged for one configuration, oldest first."""
    return ledger.where((F.col("name") == name) & (tj.text_at(F.col("params"), "$.config_hash") == config_hash)).orderBy("line")


def as_json(rows: DataFrame) -> DataFrame:
    """(json): each row as one JSON object; a text that is a JSON object or list is put in as such, other texts as strings."""

    def cell(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind != "string":
            return F.coalesce(F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", ""), F.lit("null"))
        nested = F.when(F.substring(F.ltrim(c), 1, 1).isin("{", "["), F.to_json(F.try_parse_json(c)))
        quoted = F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
        return F.when(c.isNull(), "null").otherwise(F.coalesce(nested, quoted))

    parts = [F.concat(F.lit(json.dumps(f.name) + ":"), cell(f.name, f.dataType.simpleString())) for f in rows.schema.fields]
    return rows.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("json"))


def active_corrections(ledger: DataFrame) -> DataFrame:
    """(line, ts_utc, params) of exclusions that no retraction undoes.

    A correction line that is repeated as it stands counts once. A retraction undoes earlier corrections by their time and may
    itself be retracted; as it only points backwards, the set that is undone settles after as many rounds as the longest
    chain of retractions is long.
    """
    fixes = ledger.where(F.col("name") == CORRECTION).groupBy("ts_utc", tj.canonical(F.col("params")).alias("_p")).agg(F.min("line").alias("line"), F.min_by("params", "line").alias("params"))
    fixes = scan.kept(fixes.select("line", "ts_utc", "params"))
    undoing = fixes.select("line", F.explode(F.from_json(F.get_json_object("params", "$.retracts"), "array<string>")).alias("ts_utc"))
    aims = scan.kept(undoing.join(fixes.select(F.col("line").alias("target"), "ts_utc"), "ts_utc").where("target < line").select("line", "target"))
    undone = scan.kept(aims.select("target").distinct())
    while True:
        after = scan.kept(aims.join(undone.withColumnRenamed("target", "line"), "line", "left_anti").select("target").distinct())
        if after.exceptAll(undone).isEmpty() and undone.exceptAll(after).isEmpty():
            break
        undone = after
    excluding = fixes.where(F.get_json_object("params", "$.excludes").isNotNull())
    return excluding.join(after.withColumnRenamed("target", "line"), "line", "left_anti")


def excluded_runs(ledger: DataFrame) -> DataFrame:
    """(line): entries that active exclusions take away, seen or not.

    An item names its runs by ledger name and time and by any parameters it lists, each of which must be there as the same
    JSON value, before the correction. Items take the earliest entry that they fit and that no item before has taken, one each: among
    entries of one name and moment that is done in order, beside one another for all names and moments.
    """
    items = active_corrections(ledger).select(F.get_json_object("params", "$.ledger_name").alias("name"), F.col("line").alias("fix"), F.posexplode(F.try_variant_get(tj.typed(F.col("params")), "$.excludes", "array<variant>")).alias("i", "item"))
    asked = scan.kept(items.select("name", "fix", "i", F.try_variant_get("item", "$.ts_utc", "string").alias("ts_utc"), F.map_filter(tj.fields_of("item"), lambda k, _: k != "ts_utc").alias("asked")))
    runs = ledger.where(F.col("name") != CORRECTION).join(asked.select("name", "ts_utc").distinct(), ["name", "ts_utc"], "left_semi").select("name", "ts_utc", "line", tj.fields(F.col("params")).alias("has"))

    def taken(wanted: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        free = [(line, dict(has or {})) for line, has in there.sort_values("line")[["line", "has"]].itertuples(index=False)]
        gone: list[int] = []
        for fix, fields in wanted.sort_values(["fix", "i"])[["fix", "asked"]].itertuples(index=False):
            fields = dict(fields or {})
            fit = next((at for at, (line, has) in enumerate(free) if line < fix and all(has.get(k) == v for k, v in fields.items())), None)
            if fit is not None:
                gone.append(free.pop(fit)[0])
        return pd.DataFrame({"line": gone}, dtype="int64")

    return asked.select("name", "ts_utc", "fix", "i", "asked").groupBy("name", "ts_utc").cogroup(runs.groupBy("name", "ts_utc")).applyInPandas(taken, "line bigint")


def trial_count(ledger: DataFrame, *, name: str | None = None, include_tags: Sequence[str] | None = None, exclude_tags: Sequence[str] | None = None) -> DataFrame:
    """One row (trials): entries in scope that active exclusions don't take away; one with metrics was seen and always counts."""
    gone = excluded_runs(ledger).withColumn("hit", F.lit(True))
    out = ledger.where(F.coalesce(F.col("name") != CORRECTION, F.lit(True))).join(gone, "line", "left")
    seen = F.coalesce(F.col("metrics"), F.lit("{}")) != "{}"
    kept = out.where((F.col("hit").isNull() | seen) & in_scope(name=name, include_tags=include_tags, exclude_tags=exclude_tags))
    return kept.agg(F.count("*").alias("trials"))


def search_intensity(rows: DataFrame, hypothesis: str) -> DataFrame:
    """(hypothesis, k): how many variants were tried under each; rows without one are left out."""
    return rows.where(F.col(hypothesis).isNotNull()).groupBy(F.col(hypothesis).alias("hypothesis")).agg(F.count("*").alias("k"))


def stats(ledger: DataFrame) -> DataFrame:
    """Entries and users of each name, most entries first."""
    return ledger.groupBy("name").agg(F.count("*").alias("entries"), F.countDistinct("user").alias("users")).orderBy(F.desc("entries"), "name")


def last_entries(ledger: DataFrame, n: int) -> DataFrame:
    """The last ``n`` entries, oldest first: a top-k by line, then a sort of n rows."""
    return ledger.orderBy(F.desc("line")).limit(n).orderBy("line")


def latest(events: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The newest event of each key."""
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")
