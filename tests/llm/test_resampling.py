"""Importance resampling against plain code, with runs of up to three words."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from tests.llm.fixtures import frame, odd, ordinary

from panelyard.llm import resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def plain(docs, target, longest, buckets, least, percent, seed):
    def features(text):
        w = WORD.findall((text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s = Counter(b for _, t, _ in docs for b in features(t)[1])
    t = Counter(b for x in target for b in features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets))))
    rows = []
    for d, text, _ in docs:
        n, f = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        rows.append((d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((-r[4], r[0] is not None, r[0] or 0, i) for i, r in enumerate(rows) if r[1] >= least)
    rank = {i: k for k, (_, _, _, i) in enumerate(able[: len(able) * percent // 100], 1)}
    return Counter((r[0], r[2], r[3], r[4], rank.get(i)) for i, r in enumerate(rows))


@pytest.mark.parametrize(("longest", "buckets", "percent"), [(1, 10_000, 10), (3, 64, 35), (2, 1000, 100)])
def test_against_plain_code(spark, longest, buckets, percent):
    docs = ordinary() + [x for x in odd() if x[0] != 7] + [(900, "A-b_c 9zé中 \x7f\x00q", "s")]
    target = [t for _, t, _ in ordinary(20, 8)] + [None, ""]
    held = spark.createDataFrame([(t, 1, 2) for t in target], "text string, s int, t int")
    got = resampling.resample(frame(spark, docs), held, longest=longest, buckets=buckets, percent=percent, least_words=20, seed=7)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == plain(docs, target, longest, buckets, 20, percent, 7)


def test_empty_tables_ties_and_repeats(spark):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(frame(spark, []), none).count() == 0
    same = [(5, "one two three " * 9, "a")] * 6 + [(6, "one two three " * 9, "a")] * 4
    got = resampling.resample(frame(spark, same), none, percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5] and len(got) == 10
    first = {r["score"] for r in got if r["rank"] == 1}
    assert first == {max(r["score"] for r in got)}


def test_slabs_share_nothing(spark, monkeypatch):
    monkeypatch.setattr(resampling, "SLAB", 200)
    docs = ordinary(40)
    target = [t for _, t, _ in ordinary(9, 3)]
    held = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(frame(spark, docs), held, longest=2).collect()
    assert Counter(tuple(r) for r in got) == plain(docs, target, 2, 10_000, 20, 10, 2024)
