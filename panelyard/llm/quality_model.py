"""Compression classifier: texts go with the class whose dictionary packs them smaller."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm import scratch
from panelyard.llm.buffers import utf8
from panelyard.llm.labelled import Logistic, class_weights, fold, labelled_texts

FOLDS = 5
#: Bytes that train one dictionary together.
GROUP_BYTES = 8 << 20
BLOCK, LEVEL, DICTIONARY = 512, 3, 192 << 10


class CompressionModel:
    """Two Zstandard dictionaries and a calibration of the difference they make.

    A text is packed in independent blocks of ``BLOCK`` bytes, whole text and all, so that a long text can't
    drown the dictionaries in its own history. With g and b the sizes by the good and the bad dictionary:
    the sum of (g - b) over the sum of (g + b), its largest and smallest value over blocks, and the packed
    size for each byte, go through a logistic calibration fitted on labelled rows the dictionaries haven't seen.
    """

    def __init__(self, rows: list[tuple[int, str]], sizes: dict[int, int]) -> None:
        parts: dict[int, list[bytes]] = {0: [], 1: []}
        held: list[tuple[int, str]] = []
        for i, (label, text) in enumerate(rows):
            if i % 10 < 6:
                parts[label].append(text.encode())
            else:
                held.append((label, text))
        self.dictionaries = [dictionary(parts[0]), dictionary(parts[1])]
        x = self.features_of([t.encode() for _, t in held])
        y = np.array([label for label, _ in held], float)
        self.calibration = Logistic(x, y, class_weights(y, sizes))

    @classmethod
    def of(cls, dictionaries: list[bytes], calibration: Logistic | None = None) -> CompressionModel:
        """A model of what was trained elsewhere."""
        out = cls.__new__(cls)
        out.dictionaries, out.calibration = dictionaries, calibration
        return out

    def packers(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for raw in self.dictionaries:
            options = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
            if raw:
                options["dict_data"] = zstandard.ZstdCompressionDict(raw)
                options["dict_data"].precompute_compress(LEVEL)
            made.append(zstandard.ZstdCompressor(**options))
        return made

    def features_of(self, texts: Iterable[bytes], packers: list[zstandard.ZstdCompressor] | None = None) -> np.ndarray:
        bad, good = (p.compress for p in packers or self.packers())
        out = []
        for text in texts:
            less = both = 0
            most, least = -1.0, 1.0
            for i in range(0, max(1, len(text)), BLOCK):
                block = text[i : i + BLOCK]
                g, b = len(good(block)), len(bad(block))
                less += g - b
                both += g + b
                if len(block) >= 64 or not i:
                    most, least = max(most, (g - b) / (g + b)), min(least, (g - b) / (g + b))
            out.append((less / both, most, least, both / (2 * len(text) + 16)))
        return np.array(out, float).reshape(-1, 4)


def dictionary(texts: list[bytes], share: int = 6) -> bytes:
    """A dictionary trained on the blocks of all texts; where there is too little for that, the texts themselves."""
    blocks = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(2048, sum(map(len, blocks)) // share)), blocks, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        raw = b"".join(blocks)
        return raw if len(raw) >= 8 else b""


def _dictionaries(rows: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> list[bytes]:
    """A dictionary a class (_y) of all texts (_t): groups of bounded size train one each, and these are trained on again until one is left."""

    def trained(share: int) -> Callable[[pa.Table], pa.Table]:
        def fit(group: pa.Table) -> pa.Table:
            group = group.sort_by("_h")
            texts = [t if isinstance(t, bytes) else t.encode() for t in group.column("_t").to_pylist()]
            made = texts[0] if share == 1 and len(texts) == 1 else dictionary(texts, share)
            return pa.table({"_y": group.column("_y").slice(0, 1), "_t": pa.array([made], pa.binary()), "_h": group.column("_h").slice(0, 1)})

        return fit

    share = 6
    while True:
        sums = {r["_y"]: r for r in rows.groupBy("_y").agg(F.count("*").alias("n"), F.sum(F.octet_length("_t")).alias("b")).collect()}
        if share == 1 and all(r["n"] == 1 for r in sums.values()):
            break
        groups = F.greatest(*[F.when(F.col("_y") == y, F.lit(int(sums[y]["b"]) // GROUP_BYTES + 1) if y in sums else F.lit(1)).otherwise(1) for y in (0, 1)])
        dealt = rows.withColumn("_g", F.pmod(F.xxhash64("_h", F.lit(share)), groups))
        rows = keep(dealt.groupBy("_y", "_g").applyInArrow(trained(share), "_y long, _t binary, _h long"), "dictionaries")
        share = 1
    found = {r["_y"]: bytes(r["_t"]) for r in rows.collect()}
    return [found.get(y, b"") for y in (0, 1)]


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text") -> CompressionModel:
    """A model from all labelled training rows that are in ``docs``: those whose fold isn't 0.

    Six tenths of them, by a hash of the key, make the dictionaries, the others the calibration, whose steps add up sums
    of tasks. A dictionary has a fixed size, and a task sees a group of bounded size; the driver gets the two last ones.
    """
    drawn = labelled_texts(docs, labels, "quality", fold(key, FOLDS) != 0, key=key, text=text).select("_y", F.xxhash64("_k").alias("_h"), "_t")
    with scratch.workspace() as keep:
        rows = keep(drawn, "quality-rows")
        tenth = F.pmod("_h", F.lit(10))
        model = CompressionModel.of(_dictionaries(rows.where(tenth < 6), keep))

        def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packers = model.packers()
            for batch in batches:
                x = model.features_of((t.as_py().encode() for t in batch.column(1)), packers)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["y", "x"])

        measures = keep(rows.where(tenth >= 6).select("_y", "_t").mapInArrow(measured, "y long, x array<double>"), "quality-measures")
        return CompressionModel.of(model.dictionaries, Logistic.over(measures, lambda x: x, 4))


def score(docs: DataFrame, model: CompressionModel, *, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted for every row.

    Null text counts as empty and is scored like an empty text. Without any labelled rows every score is 0.5.
    Repeated rows each get a row, an empty table none; other columns are ignored. A map without a shuffle.
    """
    kind = docs.schema[key].dataType.simpleString()

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = model.packers()
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            raw = memoryview(np.ascontiguousarray(data))
            x = model.features_of((raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)), packers)
            scores = model.calibration(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=[key, "held_out", "score", "predicted"])

    rows = docs.select(F.col(key), (fold(key, FOLDS) == 0).alias("held_out"), F.col(text).alias("_text"))
    return rows.mapInArrow(judge, f"`{key}` {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: CompressionModel, *, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with all their columns, whatever their names.

    Null text is judged as empty text, whole texts however long. Repeated rows are judged alike and all stay or go;
    a score equal to the threshold keeps. An empty table gives an empty result. A map without a shuffle.
    """
    fields = docs.schema

    def sift(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = model.packers()
        for batch in batches:
            data, offsets = utf8(batch.column(batch.schema.names.index(text)))
            raw = memoryview(np.ascontiguousarray(data))
            x = model.features_of((raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)), packers)
            yield batch.filter(pa.array(model.calibration(x) >= threshold))

    return docs.mapInArrow(sift, fields)
