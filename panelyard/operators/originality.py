"""Originality of factors: the largest part of a formula that a zoo, or the store of factors, has already.

Formulas are read into an inverted index, a row for each shape of a subtree and its owner; two formulas share what their
shapes share. A candidate asks each of its shapes once: the index is first reduced to the two earliest owners of a shape,
since only the earliest can be named, or the second where the earliest is the candidate itself. So a shape that every
formula has, such as a single field, costs a row and not a list.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions import grammar
from panelyard.functions.zoo import default_zoo

PARSED = "pos bigint, expression string, id string, nodes int, structure string, problem string, shapes array<struct<shape: string, nodes: int>>"


@dataclass(frozen=True)
class Limits:
    """Most nodes of a factor, and the shares of it from which the zoo or the store has too much of it."""

    nodes: int = 30
    zoo_share: float = 0.75
    store_share: float = 1.0

    def __post_init__(self) -> None:
        if self.nodes < 3 or not 0 < self.zoo_share <= 1 or not 0 < self.store_share <= 1:
            raise ValueError("at least 3 nodes, and shares above 0 up to 1")


def parsed(rows: DataFrame) -> DataFrame:
    """(pos, expression) read by the grammar, an Arrow batch at a time: content id, nodes, structural key, and the largest size of each subtree shape.

    A text that isn't of the language, null among them, has its problem and no shapes.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("shape", pa.string()), ("nodes", pa.int32())]))
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(1).to_pylist():
                try:
                    e = grammar.parse(text or "")
                    out.append((grammar.factor_id(e), e.nodes, grammar.structural_key(e), None, [{"shape": s, "nodes": n} for s, n in grammar.shapes(e).items()]))
                except grammar.GrammarError as problem:
                    out.append((None, None, None, str(problem), []))
            columns = [[r[i] for r in out] for i in range(5)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string(), kind), strict=True))],
                names=["pos", "expression", "id", "nodes", "structure", "problem", "shapes"],
            )

    return rows.select(F.col("pos").cast("long"), "expression").mapInArrow(read, PARSED)


def subtree_index(formulas: DataFrame) -> DataFrame:
    """(shape, pos, owner) of parsed formulas with an ``owner``: one row for each shape that an owner has."""
    return formulas.select("pos", "owner", F.explode("shapes").alias("s")).select(F.col("s.shape").alias("shape"), "pos", "owner")


def earliest(index: DataFrame) -> DataFrame:
    """(shape, first, second): the two earliest owners of a shape as (pos, owner), the second null where there is one alone.

    Partial minima; no list of owners is gathered.
    """
    least = F.min(F.struct("pos", "owner"))
    first = index.groupBy("shape").agg(least.alias("first"))
    rest = index.join(first, "shape").where("owner <> first.owner").groupBy("shape").agg(least.alias("second"))
    return first.join(rest, "shape", "left")


def nearest(candidates: DataFrame, owners: DataFrame, prefix: str, *, few: bool = False) -> DataFrame:
    """``candidates`` (parsed) with prefix_nodes, prefix_share and nearest_prefix: their largest subtree shared with the owners of :func:`earliest`.

    The nearest is the earliest owner of any shared subtree of that size. A candidate's own id is no owner. Without a
    shared subtree the size is 0 and the name empty. ``few`` owners are sent to all executors; the shapes that are asked
    never are, although the planner, which can't see how many a formula has, takes them for few.
    """
    asked = candidates.select("pos", "id", F.explode("shapes").alias("s")).select("pos", "id", "s.shape", "s.nodes")
    met = (asked.join(F.broadcast(owners), "shape") if few else asked.hint("merge").join(owners, "shape")).withColumn("by", F.when(F.col("first.owner").eqNullSafe(F.col("id")), F.col("second")).otherwise(F.col("first"))).where("by is not null")
    best = met.groupBy("pos").agg(F.min(F.struct((-F.col("nodes")).alias("n"), F.col("by.pos").alias("p"), F.col("by.owner").alias("o"))).alias("b"))
    found = best.select("pos", (-F.col("b.n")).alias(f"{prefix}_nodes"), F.col("b.o").alias(f"nearest_{prefix}"))
    out = candidates.join(found, "pos", "left").withColumn(f"{prefix}_nodes", F.coalesce(f"{prefix}_nodes", F.when(F.col("problem").isNull(), 0)))
    return out.withColumn(f"nearest_{prefix}", F.coalesce(f"nearest_{prefix}", F.lit(""))).withColumn(f"{prefix}_share", F.col(f"{prefix}_nodes") / F.col("nodes"))


def zoo_index(spark: SparkSession, members: list[tuple[str, str]] | None = None) -> DataFrame:
    """:func:`earliest` of a zoo given as (name, formula) in order, by default the published one."""
    zoo = default_zoo() if members is None else members
    rows = spark.createDataFrame([(i, f, n) for i, (n, f) in enumerate(zoo)], "pos bigint, expression string, name string")
    read = parsed(rows).join(rows.select("pos", F.col("name").alias("owner")), "pos")
    return earliest(subtree_index(read))


def judge(candidates: DataFrame, zoo: DataFrame, stored: DataFrame | None = None, limits: Limits | None = None) -> DataFrame:
    """(pos, expression, id, nodes, zoo and store shares and names, status, reason) of each candidate (pos, expression).

    Status is "stored", "duplicate" (a factor that is there already, however it is written), "rejected" or "unparsable". A
    factor is too complex beyond ``limits.nodes``; not original where the zoo has ``zoo_share`` of it, or the store
    ``store_share`` of it, which for a share of 1 means a factor of the same structure. ``stored`` is parsed formulas with
    their ids as owners. Candidates of one batch are compared with the store as it stood and, by structure, with
    those before them that are stored: the first of a structure stays, and later ones repeat it or are rejected.
    """
    limits = limits or Limits()
    read = parsed(candidates)
    near = nearest(read, zoo, "zoo", few=True)
    if stored is not None:
        near = nearest(near, earliest(subtree_index(stored)), "store")
        known = stored.groupBy(F.col("structure").alias("_s")).agg(F.min(F.struct("pos", "owner")).alias("_held"))
        ids = stored.select(F.col("owner").alias("_id")).distinct()
        near = near.join(known, F.col("structure") == F.col("_s"), "left").join(ids, F.col("id") == F.col("_id"), "left")
    else:
        near = near.select("*", F.lit(0).alias("store_nodes"), F.lit("").alias("nearest_store"), F.lit(0.0).alias("store_share"), F.lit(None).cast("struct<pos: bigint, owner: string>").alias("_held"), F.lit(None).cast("string").alias("_id"))
    there = F.col("_id").isNotNull()
    percent = lambda share: F.format_string("%.0f%%", 100 * share)
    copies = (F.col("store_share") >= limits.store_share) & (F.lit(limits.store_share < 1) | F.col("_held").isNotNull()) & ~there
    reason = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col("nodes") > limits.nodes, F.format_string(f"too complex: %d nodes, limit {limits.nodes}", "nodes"))
        .when(F.col("zoo_share") >= limits.zoo_share, F.concat(F.lit("not original: "), percent(F.col("zoo_share")), F.lit(" of it is in "), F.col("nearest_zoo")))
        .when(copies, F.concat(F.lit("not original: "), percent(F.col("store_share")), F.lit(" of it is stored factor "), F.coalesce(F.nullif(F.col("nearest_store"), F.lit("")), F.col("_held.owner"))))
    )
    judged = near.withColumn("reason", reason)
    fresh = judged.where("reason is null").groupBy(F.col("structure").alias("_t")).agg(F.min(F.struct("pos", "id")).alias("_first"))
    held = judged.join(fresh, F.col("structure") == F.col("_t"), "left")
    later = F.col("reason").isNull() & (F.col("pos") > F.col("_first.pos"))
    other = later & ~there & (F.col("id") != F.col("_first.id"))
    status = (
        F.when(F.col("problem").isNotNull(), "unparsable").when(F.col("reason").isNotNull() | other, "rejected").when(there | later, "duplicate").otherwise("stored")
    )
    why = F.when(other, F.concat(F.lit("not original: 100% of it is stored factor "), F.col("_first.id"))).otherwise(F.coalesce("reason", F.lit("")))
    return held.select("pos", "expression", "id", "nodes", "zoo_nodes", "zoo_share", "nearest_zoo", "store_nodes", "store_share", "nearest_store", status.alias("status"), why.alias("reason"))
