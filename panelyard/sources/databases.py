"""Reads over JDBC and of service records as nested JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions import text


def pgpass_fields(line: str) -> list[str]:
    """Fields of a password-file line, where a backslash keeps the colon or backslash behind it."""
    out, field, kept = [], "", False
    for ch in line:
        if kept:
            field, kept = field + ch, False
        elif ch == "\\":
            kept = True
        elif ch == ":":
            out.append(field)
            field = ""
        else:
            field += ch
    return [*out, field]


def yearly(spark: SparkSession, url: str, table: str, columns: Sequence[str], start: int, end: int, *, date_column: str = "date", properties: dict[str, str] | None = None) -> DataFrame:
    """A table read by year, one JDBC partition each; credentials travel in ``properties``, never in SQL."""
    predicates = [f"{date_column} >= date '{y}-01-01' and {date_column} < date '{y + 1}-01-01'" for y in range(start, end + 1)]
    return spark.read.jdbc(url, table, predicates=predicates, properties=properties or {}).select(*columns)


def available_columns(df: DataFrame, wanted: Sequence[str]) -> tuple[list[str], list[str]]:
    """Wanted columns that are there, and those that are missing."""
    have = set(df.columns)
    return [c for c in wanted if c in have], [c for c in wanted if c not in have]


WORK = (
    "id string, doi string, title string, publication_date string, language string, abstract_inverted_index map<string, array<int>>, "
    "authorships array<struct<author: struct<display_name: string>, institutions: array<struct<display_name: string, country_code: string>>>>, "
    "primary_location struct<landing_page_url: string, source: struct<display_name: string>>"
)


def works(raw: DataFrame, *, value: str = "value", found_via: str = "") -> DataFrame:
    """Flat paper records of nested work records in JSON text: names, institutions and countries as distinct lists."""
    w = raw.select(F.from_json(value, WORK).alias("w")).select("w.*")
    institutions = F.flatten(F.transform("authorships", lambda a: F.coalesce(a["institutions"], F.array())))
    doi = text.normalize_doi(F.col("doi"))
    title_norm = text.normalize_title(F.col("title"))
    return w.select(
        F.col("id").alias("openalex_id"), doi.alias("doi"), "title", title_norm.alias("title_norm"), F.col("publication_date").alias("published"), "language",
        text.abstract_from_index(F.col("abstract_inverted_index")).alias("abstract"),
        F.filter(F.transform("authorships", lambda a: a["author"]["display_name"]), lambda n: n.isNotNull()).alias("authors"),
        F.array_distinct(F.filter(F.transform(institutions, lambda i: i["display_name"]), lambda n: n.isNotNull())).alias("institutions"),
        F.array_distinct(F.filter(F.transform(institutions, lambda i: i["country_code"]), lambda n: n.isNotNull())).alias("countries"),
        F.coalesce("primary_location.landing_page_url", F.concat(F.lit("https://doi.org/"), doi), F.col("id")).alias("url"),
        F.col("primary_location.source.display_name").alias("venue"), F.array(F.lit(found_via)).alias("found_via"),
    )


def entries_since(entries: DataFrame, since: str) -> DataFrame:
    """Records published or updated on or after a date."""
    return entries.where(F.greatest("published", "updated") >= since)
