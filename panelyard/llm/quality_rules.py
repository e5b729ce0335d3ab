"""Quality rules as a short-circuit cascade, in DataFrame functions only."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: What a rule costs apart from the characters it reads, in characters.
STEP = 10.0


@dataclass(frozen=True)
class Rule:
    """A named reason to reject: SQL over text and the base columns, true for a rejected document; read only where ``guard`` holds."""

    name: str
    rejects: str
    guard: str = "true"

    @property
    def condition(self) -> str:
        return self.rejects if self.guard == "true" else f"({self.guard}) and ({self.rejects})"

    @property
    def passes(self) -> int:
        """How often the condition goes over the text."""
        return len(re.findall(r"\btext\b", self.rejects))


#: Thresholds are far from ordinary prose, so that a clean document is never near one.
RULES = (
    Rule("symbols_to_words", "2 * n_symbols > n_words"),
    Rule("repeated_lines", "3 * n_dup_lines > size(split(text, '\n'))", "n_dup_lines >= 3"),
    Rule("word_length", "word_chars > 20 * n_words or word_chars < 2 * n_words"),
    Rule("shouting", "2 * length(regexp_replace(text, '[^A-Z]+', '')) > word_chars"),
    Rule("exclamations", "4 * regexp_count(text, '!!') > n_words"),
    Rule("digits", "3 * length(regexp_replace(text, '[^0-9]+', '')) > word_chars"),
)


def base_measures(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text (null: empty), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Repeated windows are found on 64-bit hashes: word hashes are combined by doubling, 1 to 2 to 4 to 8
    words, so no window is ever sliced out. Only texts that have fewer distinct windows than windows sort
    them, and the covered words follow from the gaps between repeated positions. Each step is a projection
    of its own, and each of its inputs is used more than once, so that the optimizer doesn't fold steps
    together and compute arrays again and again. All of it is one narrow stage without a shuffle.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    one = docs.select(F.col(key).alias("_key"), body.alias("text"))
    two = one.select("*", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("_words"), F.filter(F.split("text", "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    three = two.select(
        "_key", "text", F.size("_words").cast("long").alias("n_words"),
        (F.length("text") - F.length(F.regexp_replace("text", WORD, ""))).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"),
    )
    for step in (1, 2, 4):
        pairs = F.zip_with("_h", F.slice("_h", step + 1, F.greatest(F.size("_h") - step, F.lit(0))), lambda a, b: F.xxhash64(a, b))
        three = three.withColumn("_h", F.slice(pairs, 1, F.greatest(F.size("_h") - step, F.lit(0))))
    four = three.withColumn("_some", F.size(F.array_distinct("_h")) < F.size("_h"))
    placed = F.when(F.col("_some"), F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    five = four.select("_key", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", placed.alias("_s"))
    n = F.size("_s")
    ahead = F.zip_with("_s", F.slice("_s", 2, n - 1), lambda a, b: F.struct(a["i"].alias("i"), F.coalesce(a["h"] == b["h"], F.lit(False)).alias("same")))
    behind = F.concat(F.array(F.lit(False)), F.zip_with(F.slice("_s", 1, n - 1), F.slice("_s", 2, n - 1), lambda a, b: a["h"] == b["h"]))
    six = five.withColumn("_p", F.when(F.col("_s").isNotNull(), F.zip_with(ahead, behind, lambda a, b: F.when(a["same"] | b, a["i"]))))
    seven = six.select("_key", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.array_sort(F.filter("_p", lambda p: p.isNotNull())).alias("_p"))
    gaps = F.zip_with("_p", F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g), F.lit(0).cast("long"))
    return seven.select(F.col("_key").alias(key), "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.when(F.col("_p").isNotNull(), covered).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"))


BASE_FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


def rejection_order(docs: DataFrame, rules: Sequence[Rule], *, key: str = "doc_id", text: str = "text", sample_rows: int = 1000) -> list[tuple[Rule, float, float]]:
    """The rules with (share rejected, cost), best rejection per cost first, as estimated on a sample.

    The sample holds about ``sample_rows`` rows, each drawn by a hash of its key and its place in the input, so that rows that
    repeat a key are drawn one by one. One job measures it and takes all shares and the texts' mean length together. A
    rule's cost is the characters that it reads of a row in the mean, where its guard holds, and ``STEP`` besides: a count and no clock, so
    the same rows give the same order. The order decides only how much is computed: a document is kept if no rule
    rejects it, in any order.
    """
    span = 1 << 40
    below = span * sample_rows // max(sample_rows, docs.count())
    placed = docs.select(F.col(key), F.col(text), F.monotonically_increasing_id().alias("_place"))
    sample = base_measures(placed.where(F.pmod(F.xxhash64(key, "_place"), F.lit(span)) < F.lit(below)), key=key, text=text)
    share = lambda sql: F.coalesce(F.avg(F.expr(f"case when {sql} then 1.0d else 0.0d end")), F.lit(0.0))
    taken = sample.agg(F.coalesce(F.avg(F.length("text")), F.lit(0.0)).alias("chars"), *[f(sql).alias(f"{name}{i}") for i, r in enumerate(rules) for name, f, sql in (("s", share, r.condition), ("g", share, r.guard))]).first()
    found = [(r, taken[f"s{i}"], STEP + taken[f"g{i}"] * r.passes * taken["chars"]) for i, r in enumerate(rules)]
    return sorted(found, key=lambda r: (-r[1] / r[2], r[2]))


def cascade(rules: Sequence[Rule]) -> Column:
    """The name of the first rule that rejects, or null; CASE stops at the first that holds, so later rules aren't computed."""
    verdict = None
    for rule in rules:
        held = F.expr(rule.condition)
        verdict = F.when(held, rule.name) if verdict is None else verdict.when(held, rule.name)
    return F.lit(None).cast("string") if verdict is None else verdict


def judge_quality(docs: DataFrame, rules: Sequence[Rule] = RULES, *, key: str = "doc_id", text: str = "text", sample_rows: int = 1000) -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by.

    The base test stands first in the cascade, since its measures are returned in any case. Null text counts
    as empty; with under 20 words it fails the base. Repeated rows each get a row. An empty table gives an
    empty result, with the cheapest rules first. Other columns are ignored, whatever their names.
    """
    order = [r for r, _, _ in rejection_order(docs, rules, key=key, text=text, sample_rows=sample_rows)]
    measured = base_measures(docs, key=key, text=text).withColumn("base_failed", F.expr(BASE_FAILED))
    judged = measured.withColumn("rejected_by", F.when(F.col("base_failed"), "base").otherwise(cascade(order)))
    return judged.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")
