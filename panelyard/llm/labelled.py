"""Labelled rows, bounded samples of them, folds and logistic calibration for the trained operators."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm import scratch


def fold(key: str | Column, parts: int) -> Column:
    """CRC-32 of the key as text, modulo ``parts``; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


#: Words of 64 bits that a sieve has at most; with more labels, it lets more rows through.
SIEVE_WORDS = 1 << 20


def sieved(rows: DataFrame, known: DataFrame, n: int, *, key: str = "_k") -> DataFrame:
    """The ``rows`` whose key may be one of the ``n`` that are ``known``: none of these is missing, about one in nine of the others stays.

    Eight bits a known key, of which its hash sets one, go to all executors, so that rows without a label are left out before any shuffle.
    """
    words = max(1, min(SIEVE_WORDS, -(-n // 8)))
    bit = fold(key, 64 * words)
    word = lambda b: F.floor(b / 64).alias("_at")
    bits = known.select(bit.alias("_b")).groupBy(word(F.col("_b"))).agg(F.bit_or(F.expr("shiftleft(1L, cast(_b % 64 as int))")).alias("_held"))
    met = rows.withColumn("_b", bit).withColumn("_at", word(F.col("_b"))).join(F.broadcast(bits), "_at")
    return met.where("shiftrightunsigned(_held, cast(_b % 64 as int)) & 1L = 1").drop("_at", "_b", "_held")


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, train: Column, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_k, _t, _y): the texts, null as empty, of all rows of ``docs`` with a ``label`` of 0 or 1 that ``train`` admits.

    Labels are joined by a merge on tables of any size, as they outgrow a broadcast; texts without a label are sieved out before.
    """
    known = labels.where(F.col(label).isin(0, 1) & train).select(F.col(key).alias("_k"), F.col(label).cast("long").alias("_y"))
    texts = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_t")).where("_k is not null")
    return sieved(texts, known, known.count()).join(known.hint("merge"), "_k")


def bounded_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, *, rows_a_class: int, bytes_a_class: int, key: str = "doc_id", text: str = "text") -> tuple[list[tuple[int, str]], dict[int, int]]:
    """((label, text) pairs, labelled rows by class), of training rows only.

    A class gives labelled documents in the order of a hash of their key, whole texts each: at most ``rows_a_class``,
    which together have at most ``bytes_a_class`` bytes; a text that would pass that sum is passed over and the next
    ones are still taken. Where no text fits, the class gives its shortest one, so that a class with rows is never empty.
    These two parameters bound what reaches the driver. Labels are joined on narrow columns, and only the chosen keys
    go back to the texts, as a broadcast of bounded size. Null text counts as empty. Rows that repeat a key all count
    towards the bounds.
    """
    known = labels.where(F.col(label).isin(0, 1) & train).select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y"))
    present = known.join(docs.select(F.col(key).alias("_k")).where(F.col("_k").isNotNull()), "_k", "left_semi")
    sizes = {r["_y"]: r["count"] for r in present.groupBy("_y").count().collect()}
    chosen = None
    for y in (0, 1):
        part = present.where(F.col("_y") == y).orderBy(F.xxhash64("_k"), "_k").limit(rows_a_class)
        chosen = part if chosen is None else chosen.unionAll(part)
    picked = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_t")).join(F.broadcast(chosen), "_k")
    drawn = scratch.written(picked.select("_y", "_t", F.xxhash64("_k").alias("_h"), F.xxhash64("_t").alias("_g"), F.octet_length("_t").alias("_n")), "labelled")
    out: list[tuple[int, int, int, str]] = []
    for y in (0, 1):
        mine = drawn.where(F.col("_y") == y)
        reach = mine.select("_h", "_g", "_n").orderBy("_h", "_g").limit(rows_a_class).collect()
        taken: Counter[tuple[int, int]] = Counter()
        total = 0
        for r in reach:
            if total + r["_n"] <= bytes_a_class:
                total += r["_n"]
                taken[r["_h"], r["_g"]] += 1
        if reach and not taken:
            shortest = min(reach, key=lambda r: r["_n"])
            taken[shortest["_h"], shortest["_g"]] = 1
        if taken:
            names = mine.sparkSession.createDataFrame(list(taken), "_h bigint, _g bigint")
            texts = mine.join(F.broadcast(names), ["_h", "_g"]).groupBy("_h", "_g").agg(F.first("_t").alias("_t")).collect()
            out += [(r["_h"], r["_g"], y, r["_t"]) for r in texts for _ in range(taken[r["_h"], r["_g"]])]
    scratch.drop(drawn)
    return [(y, t) for _, _, y, t in sorted(out)], sizes


class Logistic:
    """Ridge logistic regression on standardised columns; with one class alone, its share of ``prior``."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> None:
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        a = self._columns(x)
        self.w = np.zeros(a.shape[1])
        if not len(x) or y.min() == y.max():
            self.w[0] = 0.0 if not len(x) else (3.0 if y[0] else -3.0)
            return
        penalty = np.full(a.shape[1], ridge)
        penalty[0] = 0.0
        loss = self._loss(a, y, weight, penalty, self.w)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a @ self.w, -35, 35)))
            slope = a.T @ (weight * (y - p)) - penalty * self.w
            step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-6), slope)
            size = 1.0
            while size > 1e-4 and self._loss(a, y, weight, penalty, self.w + size * step) > loss:
                size /= 2
            if size <= 1e-4 or np.abs(size * step).max() < 1e-8:
                break
            self.w = self.w + size * step
            loss = self._loss(a, y, weight, penalty, self.w)

    @classmethod
    def over(cls, rows: DataFrame, columns: Callable[[np.ndarray], np.ndarray], width: int, ridge: float = 1.0) -> Logistic:
        """The same fit on all of ``rows`` (y, x), whose ``columns`` are made of x: each step adds up sums of tasks."""

        def summed(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
            def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total: np.ndarray | None = None
                for batch in batches:
                    if batch.num_rows:
                        x = np.array(batch.column(1).to_pylist(), float)
                        mine = f(columns(x), batch.column(0).to_numpy(zero_copy_only=False).astype(float))
                        total = mine if total is None else total + mine
                if total is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

            return np.array([r["s"] for r in rows.select("y", "x").mapInArrow(part, "s array<double>").collect()]).sum(0)

        out = cls(np.zeros((0, width)), np.zeros(0), np.zeros(0), ridge)
        moments = summed(lambda x, y: np.r_[len(y), y.sum(), x.sum(0), (x * x).sum(0)])
        if not moments.shape:
            return out
        n, ones, out.mean = moments[0], moments[1], moments[2 : 2 + width] / moments[0]
        if ones in (0, n):
            out.w[0] = 3.0 if ones else -3.0
            return out
        out.scale = np.sqrt(np.maximum(0, moments[2 + width :] / n - out.mean**2)) + 1e-9
        penalty = np.full(width + 1, ridge)
        penalty[0] = 0.0

        def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            def part(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                a = out._columns(x)
                p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
                one = np.ones(len(y))
                return np.r_[cls._loss(a, y, one, 0 * penalty, w), a.T @ (y - p), ((a * (p * (1 - p))[:, None]).T @ a).ravel()]

            s = summed(part)
            k = width + 1
            return s[0] + 0.5 * float((penalty * w * w).sum()), s[1 : 1 + k] - penalty * w, s[1 + k :].reshape(k, k) + np.diag(penalty + 1e-6)

        loss, slope, curve = at(out.w)
        for _ in range(60):
            step, size = np.linalg.solve(curve, slope), 1.0
            if np.abs(step).max() < 1e-6:
                break
            after = at(out.w + step)
            while size > 1e-4 and after[0] > loss:
                size /= 2
                after = at(out.w + size * step)
            if size <= 1e-4:
                break
            out.w = out.w + size * step
            loss, slope, curve = after
        return out

    def _columns(self, x: np.ndarray) -> np.ndarray:
        return np.c_[np.ones(len(x)), (x - self.mean) / self.scale]

    @staticmethod
    def _loss(a: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: np.ndarray, w: np.ndarray) -> float:
        z = a @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (penalty * w * w).sum())

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._columns(x) @ self.w, -35, 35)))


def class_weights(y: np.ndarray, sizes: dict[int, int]) -> np.ndarray:
    """Weights that give each class its share of all labelled rows, with mean 1."""
    if not len(y):
        return np.ones(0)
    total = max(1, sum(sizes.values()))
    share = {c: sizes.get(c, 0) / total for c in (0, 1)}
    have = {c: max(1e-9, float((y == c).mean())) for c in (0, 1)}
    return np.array([share[int(v)] / have[int(v)] for v in y])
