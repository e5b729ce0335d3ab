"""Column-pruned, date-bounded file reads, with checks that fail closed, and small text formats."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE_COLUMNS = ("date", "datadate", "rdq", "linkdt")


def manifest_version(manifest: dict[str, str]) -> str:
    """Twelve hexadecimal digits for a set of files and their checksums, in any order."""
    return hashlib.sha256("\n".join(f"{k}\t{v}" for k, v in sorted(manifest.items())).encode()).hexdigest()[:12]


def manifest_diff(want: DataFrame, have: DataFrame) -> DataFrame:
    """(name, status) of two (name, sha) tables: copy, up-to-date or remove."""
    both = want.select("name", F.col("sha").alias("w")).join(have.select("name", F.col("sha").alias("h")), "name", "full_outer")
    return both.select("name", F.when(F.col("h") == F.col("w"), "up-to-date").when(F.col("w").isNull(), "remove").otherwise("copy").alias("status"))


def load(spark: SparkSession, path: str, columns: Sequence[str] | None = None, start: str | None = None, end: str | None = None, *, date_column: str = "date") -> DataFrame:
    """Chosen columns between two dates; both reach the scan. The date column must be one of the known ones and a plain date."""
    return between(spark.read.parquet(path), columns, start, end, date_column=date_column)


def between(df: DataFrame, columns: Sequence[str] | None = None, start: str | None = None, end: str | None = None, *, date_column: str = "date") -> DataFrame:
    """As :func:`load`, of a table that has been opened."""
    if date_column not in DATE_COLUMNS:
        raise ValueError(f"{date_column!r} is not a known date column")
    if start is not None or end is not None:
        kind = df.schema[date_column].dataType
        if not isinstance(kind, T.DateType | T.TimestampNTZType):
            raise TypeError(f"{date_column} must be a date without a time zone, not {kind.simpleString()}")
    if start is not None:
        df = df.where(F.col(date_column) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(date_column) <= F.lit(end).cast("date"))
    return df.select(*columns) if columns is not None else df


def guard(end: str | None, boundary: str, *, protected: bool) -> None:
    """Refuses to read protected data without a bound, or with one past the boundary."""
    if protected and (end is None or date.fromisoformat(end) > date.fromisoformat(boundary)):
        raise PermissionError(f"protected data may be read up to {boundary} only")


def temporal_leaves(schema: T.DataType, path: str = "") -> Iterable[tuple[str, T.DataType, bool]]:
    """(path, type, repeated) of every date or time in a schema, however deep; those inside lists and maps are repeated."""

    def walk(kind: T.DataType, at: str, repeated: bool):
        if isinstance(kind, T.StructType):
            for f in kind:
                yield from walk(f.dataType, f"{at}.{f.name}" if at else f.name, repeated)
        elif isinstance(kind, T.ArrayType):
            yield from walk(kind.elementType, at, True)
        elif isinstance(kind, T.MapType):
            yield from walk(kind.keyType, at, True)
            yield from walk(kind.valueType, at, True)
        elif isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
            yield at, kind, repeated

    yield from walk(schema, path, False)


def bounded(df: DataFrame, before: str) -> DataFrame:
    """Rows whose every date is missing or before the bound; a repeated or zoned date raises, since it can't be bounded."""
    for path, kind, repeated in temporal_leaves(df.schema):
        if repeated or isinstance(kind, T.TimestampType):
            raise ValueError(f"{path} can't be bounded: {'repeated' if repeated else 'with a time zone'}")
        df = df.where((F.col(path) < F.lit(before).cast("date")) | F.col(path).isNull())
    return df


def footers_before(paths: Sequence[str], column: str, before: date) -> None:
    """Raises unless row-group statistics prove that no value of a column reaches the bound."""
    import pyarrow.parquet as pq

    for path in paths:
        meta = pq.ParquetFile(path).metadata
        for g in range(meta.num_row_groups):
            found = [meta.row_group(g).column(c) for c in range(meta.num_columns) if meta.row_group(g).column(c).path_in_schema == column]
            stats = found[0].statistics if found else None
            if stats is None or not stats.has_min_max:
                raise PermissionError(f"{path}: row group {g} has no statistics of {column}")
            last = stats.max.date() if hasattr(stats.max, "date") else stats.max
            if last >= before:
                raise PermissionError(f"{path}: {column} reaches {last}")


def factor_names(text: DataFrame, *, value: str = "value") -> list[str]:
    """The column names of a published factor table: the first line that begins with a comma, which is all the driver gets."""
    lines = text.select(F.posexplode(F.split(value, r"\r?\n")).alias("at", "line")).where(F.col("line").startswith(","))
    first = lines.orderBy("at").select("line").first()
    if first is None:
        raise ValueError("no header line: the file's layout may have changed")
    return [c.strip() for c in first["line"].split(",")[1:]]


def factor_table(text: DataFrame, names: Sequence[str] | None = None, *, value: str = "value") -> DataFrame:
    """A published factor table from (value) whole texts: its first block of dated rows, percent to decimals, under its own names or those given.

    The block starts after the first line that begins with a comma and ends at the first line that isn't a date and
    numbers. Six-digit dates stand for the month's end; -99.99 and -999 are missing.
    """
    names = factor_names(text, value=value) if names is None else names
    lines = text.select(F.posexplode(F.split(value, r"\r?\n")).alias("at", "line"))
    head = lines.where(F.col("line").startswith(",")).agg(F.min("at").alias("head"))
    after = lines.crossJoin(F.broadcast(head)).where("at > head").withColumn("row", F.col("line").rlike(r"^\s*\d{6}(\d{2})?\s*,"))
    end = after.where("not row").agg(F.min("at").alias("stop"))
    rows = after.crossJoin(F.broadcast(end)).where("row and (stop is null or at < stop)")
    cells = F.split("line", ",")
    stamp = F.trim(cells[0])
    day = F.when(F.length(stamp) == 8, F.to_date(stamp, "yyyyMMdd")).otherwise(F.last_day(F.to_date(F.concat(F.substring(stamp, 1, 6), F.lit("01")), "yyyyMMdd")))
    number = lambda i: F.try_to_number(F.trim(cells[i + 1]), F.lit("S9999999D999999")).cast("double") / 100
    return rows.select(day.alias("date"), *[F.when(number(i) > -0.99, number(i)).alias(n) for i, n in enumerate(names)])


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """A table read from ``path``, written there first if it isn't yet."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(conf).exists(p):
        make().write.parquet(path)
    return spark.read.parquet(path)


def toml_papers(text: str, keys: Sequence[str] | None = None) -> list[dict]:
    """The ``[[papers]]`` of a TOML text, all or by key in the order asked; an unknown key raises."""
    import tomllib

    papers = tomllib.loads(text).get("papers", [])
    if keys is None:
        return papers
    by = {p["key"]: p for p in papers}
    missing = [k for k in keys if k not in by]
    if missing:
        raise KeyError(f"unknown papers: {missing}")
    return [by[k] for k in keys]


def canonical(value: object) -> str:
    """JSON with sorted keys; a number that isn't finite raises."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)


def digest(value: object) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()
