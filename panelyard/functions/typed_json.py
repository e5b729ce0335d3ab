"""JSON texts as typed values: a canonical text in which keys are in order and 1, 1.0, "1" and true stay four different values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A string, a number, a word or a sign of a JSON text; and a number with a fraction or an exponent.
TOKEN = r'"(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|[\[\]{},:]'
FRACTION = r"^-?\d+(?:\.\d+(?:[eE][+-]?\d+)?|[eE][+-]?\d+)$"
#: The key under which a fraction is kept, so that no parser takes it for a whole number; no ordinary key begins so.
TAG = "\\u0001"


def typed(c: Column) -> Column:
    """The text as a VARIANT whose fractions are tagged; null where it isn't JSON or repeats a key.

    A fraction becomes an object of its shortest text as a double, so 100.0 and 1e2 are one value and 100 another.
    """
    tagged = F.transform(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), lambda t: F.when(t.rlike(FRACTION), F.concat(F.lit(f'{{"{TAG}":"'), t.cast("double").cast("string"), F.lit('"}'))).otherwise(t))
    # Parsed inside a list, since a parser may stop after the first value; a text of one value alone is a list of one.
    whole = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), F.array_join(tagged, " "), F.lit("]"))), "$", "array<variant>")
    return F.when(F.regexp_replace(c, TOKEN, "").rlike(r"^\s*$") & (F.size(whole) == 1), F.get(whole, F.lit(0)))


def canonical(c: Column) -> Column:
    """One text for one JSON value, however its keys are ordered and its numbers written; null where it isn't JSON."""
    return F.to_json(typed(c))


def same(a: Column, b: Column) -> Column:
    """Whether two texts are equal as JSON values; two texts that aren't JSON are not."""
    return F.coalesce(canonical(a) == canonical(b), F.lit(False))


def text_at(c: Column, path: str) -> Column:
    """The string at a path of a JSON text; null where there is none, or something else than a string stands there."""
    found = F.try_variant_get(F.try_parse_json(c), path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(F.try_parse_json(c), path, "string"))


def fields_of(v: Column | str) -> Column:
    """The fields of an object in a VARIANT of :func:`typed` as a map of canonical texts; empty for anything else."""
    entries = F.map_entries(F.try_variant_get(v, "$", "map<string, variant>"))
    made = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], F.coalesce(F.to_json(e["value"]), F.lit("null")))))
    return F.coalesce(made, F.create_map().cast("map<string,string>"))


def fields(c: Column) -> Column:
    """:func:`fields_of` a JSON text."""
    return fields_of(typed(c))


def holds(mine: Column, asked: Column) -> Column:
    """Whether a map of :func:`fields` has every field that another one has, with the same value."""
    return F.forall(F.map_entries(asked), lambda e: F.coalesce(F.try_element_at(mine, e["key"]) == e["value"], F.lit(False)))
