"""Small tables for the corpus operators: ordinary, odd and empty."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, shard string, score string, kept string, h string, k string, t string, text_hash string"
EXTRA = ("size", "shard", "score", "kept", "h", "k", "t", "th")
VOWELS, CONSONANTS = "aeiou", "bcdfghklmnprstv"


def word(r: random.Random) -> str:
    return "".join(r.choice(CONSONANTS) + r.choice(VOWELS) for _ in range(r.randrange(1, 4)))


def prose(r: random.Random, n: int) -> str:
    words = [word(r) for _ in range(n)]
    for i in range(0, n, 9):
        words[i] = words[i].capitalize()
        if i:
            words[i - 1] += "." + ("\n" if i % 27 == 0 else "")
    return " ".join(words).replace("\n ", "\n") + "."


def rows(texts: list[tuple]) -> list[tuple]:
    return [(d, t, "en", s, len(t or ""), *EXTRA) for d, t, s in texts]


def frame(spark: SparkSession, texts: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows(texts), SCHEMA)


def ordinary(n: int = 120, seed: int = 5) -> list[tuple]:
    """Documents with exact copies, near copies, junk and insults among them."""
    r = random.Random(seed)
    out = [(i, prose(r, r.choice([3, 12, 40, 120, 260])), f"src{i % 5}") for i in range(n)]
    for i in range(0, n, 10):
        base = out[i + 1][1]
        out[i] = (i, base, out[i][2])
        words = base.split(" ")
        if len(words) > 60:
            words[7] = "changed"
            out[i + 2] = (i + 2, " ".join(words), out[i + 2][2])
    out[3] = (3, "Twice said line here now\n" * 6 + prose(r, 30), "src3")
    return out


def odd() -> list[tuple]:
    """Null and empty values, white space alone, one very long text, ties and repeated rows."""
    r = random.Random(9)
    long = prose(r, 60_000) + " " + "x" * 3000
    repeated = (7, "the same row stands here three times over and over again", "b")
    return [
        (1, None, "a"), (2, "", "a"), (3, " \t\n\x0b\x0c\r ", None), (None, "a text without a key but with several words", "a"), (None, None, None), (4, long, "b"), repeated, repeated, repeated,
        (8, "Ünïcode wörds — 中文字 😀 ﬁ Σς", "c"), (9, "ONE two  three\n\n four", "c"), (10, "<|endoftext|> and <|startoftext|> inside", "c"),
    ]
