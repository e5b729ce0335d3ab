"""Importance resampling towards a target: documents whose word runs look like the target's are drawn more often.

Words become integers through a dictionary, word runs become tuples of such integers, and the bytes of a distinct tuple
are put together and hashed once for each slab of texts; counts are then joined back through the tuple's number. Only
``BUCKETS`` sums for each side meet, so nothing that is shuffled or sent out grows with the vocabulary.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm import scratch
from panelyard.llm.buffers import utf8

BUCKETS, LONGEST_RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Bytes of whole texts that share a dictionary; a longer text has one of its own.
SLAB = 4 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Digits, small letters and whatever lies beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of all words of the rows: their ids, their rows, and the dictionary that the ids point into."""
    low = _LOWER[data]
    inside = _WORD[low]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[edges] = inside[edges]
    ends[:-1] &= ~inside[1:]
    ends[edges - 1] = inside[edges - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    bounds = np.concatenate([[0], np.cumsum(last - first + 1)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(low[inside])]).dictionary_encode()
    return words.indices.to_numpy(), np.searchsorted(offsets, first, side="right") - 1, words.dictionary.to_pylist()


def bucketed(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every run of 1 to ``longest`` words; each distinct run is put together and hashed once."""
    ids, rows, words = word_ids(data, offsets)
    for n in range(1, longest + 1):
        if len(ids) < n:
            break
        at = np.flatnonzero(rows[: len(rows) - n + 1] == rows[n - 1 :])
        if n == 1:
            tuples, which = np.arange(len(words))[:, None], ids
        else:
            tuples, which = np.unique(np.stack([ids[at + k] for k in range(n)], axis=1), axis=0, return_inverse=True)
        hashes = np.fromiter((zlib.crc32(b" ".join([words[i] for i in run])) % buckets for run in tuples.tolist()), np.int64, len(tuples))
        yield rows[at], hashes[which.ravel()]


def _slabs(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    """(batch, first row, end row, bytes, offsets) of runs of whole rows of about ``SLAB`` bytes, one row at least."""
    for batch in batches:
        data, offsets = utf8(batch.column(column))
        at, rows = 0, len(offsets) - 1
        while at < rows:
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLAB, side="right")) - 1)
            yield batch, at, stop, data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at]
            at = stop


def bucket_counts(texts: DataFrame, text: str = "text", longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many word runs of all texts fall into each bucket; a task gives at most ``buckets`` rows.

    Null and empty texts have none, and an empty table gives no rows.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, _, _, data, offsets in _slabs(batches, 0):
            for _, found in bucketed(data, offsets, longest, buckets):
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return texts.select(F.col(text).alias("text")).mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text: str = "text", longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> list[int]:
    """For each bucket the thousandfold log ratio, rounded down, of its smoothed shares in ``target`` and in ``docs``.

    What reaches the driver are ``buckets`` numbers, whatever the tables' sizes.
    """
    spark = docs.sparkSession
    ours = bucket_counts(docs, text, longest, buckets).withColumnRenamed("n", "s")
    theirs = bucket_counts(target, text, longest, buckets).withColumnRenamed("n", "t")
    counts = spark.range(buckets).withColumnRenamed("id", "bucket").join(ours, "bucket", "left").join(theirs, "bucket", "left").na.fill(0)
    both = scratch.written(counts, "buckets")
    sums = both.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    ratio = (F.col("t") + 1.0) * (F.col("all_s") + float(buckets)) / ((F.col("s") + 1.0) * (F.col("all_t") + float(buckets)))
    gains = both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain")).orderBy("bucket").collect()
    scratch.drop(both)
    return [r["gain"] for r in gains]


def weights(docs: DataFrame, gains: list[int], *, key: str = "doc_id", text: str = "text", longest: int = LONGEST_RUN) -> DataFrame:
    """(key, n_words, n_features, weight) of every row: its words, its word runs, and the sum of their buckets' gains."""
    gain = np.array(gains, np.int64)
    kind = docs.schema[key].dataType.simpleString()

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, end, data, offsets in _slabs(batches, 1):
            n_words, n_features, weight = (np.zeros(end - first, np.int64) for _ in range(3))
            for n, (rows, found) in enumerate(bucketed(data, offsets, longest, len(gain)), 1):
                n_features += (size := np.bincount(rows, minlength=end - first))
                if n == 1:
                    n_words = size
                sums = np.concatenate([[0], np.cumsum(gain[found])])
                bounds = np.concatenate([[0], np.cumsum(size)])
                weight += sums[bounds[1:]] - sums[bounds[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(n_words), pa.array(n_features), pa.array(weight)], names=[key, "n_words", "n_features", "weight"])

    return docs.select(key, text).mapInArrow(weigh, f"`{key}` {kind}, n_words bigint, n_features bigint, weight bigint")


def resample(
    docs: DataFrame, target: DataFrame, *, key: str = "doc_id", text: str = "text", longest: int = LONGEST_RUN, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED
) -> DataFrame:
    """One row for each row of ``docs``: key, n_features, weight, score, rank.

    The score is the weight plus noise, -1000 ln(-ln u) rounded down, with u from the SHA-256 of ``seed:key``; the
    highest scores are then a draw without replacement by weight. Of the rows with at least ``least_words`` words,
    ``percent`` of a hundred are drawn, rounded down; rank counts them from 1 by score, ties to the smaller key, and is
    null for all others.

    Ranks are dealt in two levels: rows are sorted by ranges of the score, and the ranges' counts give each its first
    rank. Texts are read twice and never shuffled. Null and empty texts, and texts without words, have no features and
    weight 0. A null key counts as empty text in the noise and stands before other keys in ties; rows that repeat a key
    and tie are ranked in any order. Empty ``docs`` give an empty result, and an empty ``target`` only its smoothing.
    Other columns are ignored, whatever their names.
    """
    weighed = weights(docs, bucket_gains(docs, target, text, longest, buckets), key=key, text=text, longest=longest)
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("long") + 0.5) / F.lit(4294967296.0)
    scored = weighed.withColumn("score", (F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform)))).cast("long"))
    order = [F.col("_in").desc(), F.col("score").desc(), F.col(key).asc_nulls_first()]
    sorted_rows = scored.withColumn("_in", F.col("n_words") >= least_words).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = scratch.written(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), "scores")
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.count_if("_in").alias("_of"))
    starts = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"), F.sum("_of").over(Window.partitionBy()).alias("_all"))
    rank = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    drawn = F.expr(f"(_all * {int(percent)}) div 100")
    return rows.withColumn("_part", part).join(F.broadcast(starts), "_part").select(F.col(key), "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
