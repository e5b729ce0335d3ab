"""Authorities as append-only event tables: who may read what, what was revoked, and looks that can be spent once.

Every decision is a query over events, so it can be repeated and audited. Writing an event is one row appended by
the caller; a record's id is a digest of its content, so issuing it twice is the same record.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.sources.files import digest

#: Statuses of a protocol, in the order it goes through them.
STATUSES = ("sealed", "authorized", "spent")


def grant(vendor: str, *, start: str, end: str, fields: Sequence[str], by: str) -> dict:
    """An authorisation of a vendor's fields over a window, with its id."""
    if not vendor or not by or start > end or not fields:
        raise ValueError("an authorisation names vendor, window, fields and who gave it")
    body = {"vendor": vendor, "start": start, "end": end, "fields": sorted(set(fields)), "authorized_by": by}
    return {"record_id": digest(body), **body}


def issue(grants: DataFrame, record: dict) -> DataFrame:
    """``grants`` with the record, once."""
    row = grants.sparkSession.createDataFrame([record], grants.schema)
    return grants.unionByName(row.join(grants.select("record_id"), "record_id", "left_anti").select(grants.columns))


def covering(grants: DataFrame, revocations: DataFrame, *, vendor: str, start: str, end: str, fields: Sequence[str], active: bool = False) -> DataFrame:
    """Grants that cover a vendor's fields over a whole window and aren't revoked at its end; ``active``: not revoked at all."""
    wanted = F.array(*map(F.lit, fields))
    fit = grants.where((F.col("vendor") == vendor) & (F.col("start") <= start) & (F.col("end") >= end) & (F.size(F.array_except(wanted, "fields")) == 0))
    gone = revocations if active else revocations.where(F.col("effective") <= end)
    return fit.join(gone.select("record_id"), "record_id", "left_anti")


def require(grants: DataFrame, revocations: DataFrame, record_id: str, **window: object) -> None:
    """Raise unless the record covers the window (see :func:`covering`)."""
    if covering(grants.where(F.col("record_id") == record_id), revocations, **window).isEmpty():
        raise PermissionError(f"record {record_id} doesn't cover this read")


def tampered(records: DataFrame, body: Sequence[str], key: str = "record_id") -> DataFrame:
    """Records whose id isn't the digest of their content, by canonical JSON of the named columns."""
    text = F.to_json(F.struct(*[F.array_sort(c).alias(c) if records.schema[c].dataType.typeName() == "array" else F.col(c) for c in sorted(body)]))
    return records.where(F.col(key) != F.sha2(text.cast("binary"), 256))


def protocol_status(events: DataFrame) -> DataFrame:
    """(protocol, status): the furthest a protocol has come; one that was only registered is sealed."""
    step = F.when(F.col("event") == "opened", 2).when(F.col("event") == "authorized", 1).otherwise(0)
    return events.groupBy("protocol").agg(F.max(step).alias("_s")).select("protocol", F.element_at(F.array(*map(F.lit, STATUSES)), F.col("_s") + 1).alias("status"))


def look_spent(ledger: DataFrame, *, synthetic: str = "synthetic") -> DataFrame:
    """One row (spent): whether any look but a synthetic one was opened."""
    return ledger.agg(F.coalesce(F.bool_or((F.col("event") == "opened") & ~F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), synthetic)), F.lit(False)).alias("spent"))


def open_once(events: DataFrame, protocol: str, by: str, at: str) -> DataFrame:
    """The event that spends a protocol's only look, to be appended before anything is read; raises unless it is authorised and unspent."""
    row = protocol_status(events.where(F.col("protocol") == protocol)).first()
    status = row["status"] if row else None
    if status != "authorized":
        raise PermissionError(f"protocol {protocol} is {status or 'unknown'}")
    return events.sparkSession.createDataFrame([(protocol, "opened", by, at)], "protocol string, event string, who string, at string")


def missing_from_ledger(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """Opened looks that the ledger lacks, to be appended: recovery that can be repeated."""
    return events.where("event = 'opened'").select("protocol").distinct().join(ledger.select("protocol"), "protocol", "left_anti")


def first_reads(reads: DataFrame) -> DataFrame:
    """(look, source, at, allowed): a source may be read once a look; its first read, in order of time, is allowed."""
    from pyspark.sql import Window

    order = Window.partitionBy("look", "source").orderBy("at")
    return reads.select("look", "source", "at", (F.row_number().over(order) == 1).alias("allowed"))


def guard_window(start: str, end: str, *, after: str) -> None:
    """A live read lies strictly after the holdout and in order."""
    if start > end:
        raise ValueError("the window ends before it starts")
    if start <= after:
        raise PermissionError(f"live reads start after {after}")
