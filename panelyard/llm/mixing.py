"""Mixing sources to target weights: repetition rates from token totals, then whole copies plus one random copy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm import scratch

#: Words are runs of anything but the six white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Hash values are the first and second 13 hexadecimal digits of an MD5, below 2^52 and so exact as doubles.
HASH_SPAN = 1 << 52
SEEDS = 32


def word_count(text: str) -> Column:
    """Number of words of a text column; null counts 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), max_rate: int = 3) -> DataFrame:
    """For each source of (source, size): source, n_docs, source_size, target.

    Sources stand in code-point order, null last, and take the weights in turn. Their targets share the
    total size by weight; a target stops at ``max_rate`` times the source's own size, and what it leaves is
    shared again among the others until no target is above. That is water filling: with sources sorted by
    size over weight, the capped ones come first, and the rest share what remains by weight.

    Everything here is one row a source, so the two windows over all sources see totals and never documents.
    """
    totals = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    weighed = totals.withColumn("_pos", F.row_number().over(order)).withColumn("weight", F.element_at(cycle, (F.pmod(F.col("_pos") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    tight = Window.orderBy(F.col("source_size") / F.col("weight"), "_pos")
    everything = Window.partitionBy()
    cap = F.lit(int(max_rate)) * F.col("source_size")
    filled = weighed.select(
        "*",
        F.sum("source_size").over(everything).alias("_all"),
        F.coalesce(F.sum(cap).over(tight.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_capped"),
        F.sum("weight").over(tight.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("_open"),
    ).withColumn("_left", F.col("_all") - F.col("_capped"))
    free = F.col("_left") * F.col("weight") <= cap * F.col("_open")
    level = F.max(F.when(free, F.col("_left") / F.col("_open"))).over(everything)
    first = filled.withColumn("_free", free).withColumn("_level", level)
    num = F.max(F.when(F.col("_free") & (F.col("_left") / F.col("_open") == F.col("_level")), F.struct("_left", "_open"))).over(everything)
    return first.withColumn("_best", num).select(
        "source", "n_docs", "source_size",
        F.when(F.col("_free"), (F.col("weight") * F.col("_best._left")).cast("double") / F.col("_best._open")).otherwise(cap.cast("double")).alias("target"),
    )


def _draw(key: Column, seed: Column) -> Column:
    """A number in [0, 1) from a key and a small seed: h1 + seed * h2 modulo 2^52, with both halves from the key's MD5."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")))
    half = lambda at: F.conv(F.substring(digest, at, 13), 16, 10).cast("long")
    return F.pmod(half(1) + seed * half(14), F.lit(HASH_SPAN)) / F.lit(float(HASH_SPAN))


def _copies(rate: Column, key: Column, seed: Column) -> Column:
    """floor(rate) copies, and one more where the key's draw falls below the fraction."""
    return (F.floor(rate) + (_draw(key, seed) < rate - F.floor(rate)).cast("long")).cast("long")


def mixing_plan(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_rate: int = 3, *, key: str = "doc_id", source: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(sizes, plan): (key, source, size) for each row, and source, source_size, target, rate, seed for each source.

    A document's extra copy is a Bernoulli draw from the hash of its key and a seed. Sources with few or
    very uneven documents would stray from their target by chance, so each source tries ``SEEDS`` seeds
    and keeps the one whose realised total is nearest. Any one draw is still a plain hash draw with the
    fraction as its probability; given the plan, the choice among seeds favours draws near the target. Copies are
    then known from a row alone: no shuffle of texts.
    """
    sizes = scratch.written(docs.select(F.col(key).alias("_key"), F.col(source).alias("source"), word_count(text).alias("size")), "sizes")
    targets = source_targets(sizes, weights, max_rate).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rates = scratch.written(targets, "rates")
    joined = sizes.join(rates.select(F.col("source").alias("_source"), "rate"), F.col("source").eqNullSafe(F.col("_source")))
    realised = joined.groupBy("source").agg(*[F.sum(F.col("size") * _copies(F.col("rate"), F.col("_key"), F.lit(k))).alias(f"_{k}") for k in range(SEEDS)])
    best = realised.join(rates.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).select(
        "source", "n_docs", "source_size", "target", "rate",
        F.array_min(F.array(*[F.struct(F.abs(F.col(f"_{k}") - F.col("target")).alias("miss"), F.lit(k).cast("long").alias("seed")) for k in range(SEEDS)])).getField("seed").alias("seed"),
    )
    return sizes, scratch.written(best, "mix")


def mix_sizes(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_rate: int = 3, *, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row for each document: key, size, source_size, target, taken (size times its copies).

    Null text has size 0. Null is a source of its own, the last. Rows that repeat a key share its draw. A
    source whose texts hold no word has target 0. An empty table gives an empty result.
    """
    sizes, plan = mixing_plan(docs, weights, max_rate, key=key, source=source, text=text)
    plan = plan.withColumnRenamed("source", "_source")
    return sizes.join(plan, F.col("source").eqNullSafe(F.col("_source"))).select(
        F.col("_key").alias(key), "size", "source_size", "target",
        (F.col("size") * _copies(F.col("rate"), F.col("_key"), F.col("seed"))).alias("taken"),
    )


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_rate: int = 3, *, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as its copies say, with the columns of ``docs``.

    Null and empty texts have no words and so follow their source's rate like any text. Null is a source of its own.
    Rows that repeat a key share its draw, each with its copies. A source whose texts hold no word has rate 0, so its
    rows go. An empty table gives an empty result. Columns of any name are kept as they are. Only the plan, a row a
    source, is sent to where texts are; texts aren't shuffled.
    """
    _, plan = mixing_plan(docs, weights, max_rate, key=key, source=source, text=text)
    of, rate, seed, copies, copy = scratch.free(docs, "_of", "_rate", "_seed", "_copies", "_copy")
    rates = plan.select(F.col("source").alias(of), F.col("rate").alias(rate), F.col("seed").alias(seed))
    counted = docs.join(rates, F.col(source).eqNullSafe(F.col(of))).withColumn(copies, _copies(F.col(rate), F.col(key), F.col(seed)).cast("int"))
    repeated = counted.where(F.col(copies) > 0).withColumn(copy, F.explode(F.array_repeat(F.lit(True), F.col(copies))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])
