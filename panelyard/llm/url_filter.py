"""URL rules as one bit-parallel automaton: all globs run at once over each canonical URL."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm.buffers import utf8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, rule): a host, a slash and a path prefix. A rule holds for its host and all subdomains; the longest that fits wins.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Blocking globs for URLs that no rule fits: ``*`` is any run without a slash, ``**`` any run.
BLOCKED = ("**casino**", "**pills**", "**free-bets**", "**spam**", "**ads-track**")
_AUTHORITY = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: str | Column) -> Column:
    """What stands after the first ``://`` up to a slash, question mark or hash, A-Z in lower case; empty where there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, _AUTHORITY, 1), UPPER, LOWER), F.lit(""))


def url_path(url: str | Column) -> Column:
    """What follows the host up to a question mark or hash; empty where there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, _AUTHORITY, 2), F.lit(""))


class GlobAutomaton:
    """Globs packed into multiword Shift-And masks.

    A glob of m literal bytes takes m + 1 neighbouring bits; bit i is on when its first i bytes have been
    read. A wildcard before byte i is a loop on bit i, over every byte (``**``) or every byte but the slash
    (``*``). For one input byte all globs step together:

        D = ((D << 1) & reach[byte]) | (D & loop[byte])

    with the carry passed from each 64-bit word to the next. Globs are anchored at both ends.
    """

    def __init__(self, globs: Sequence[str]) -> None:
        starts, finals, at = [], [], 0
        reach: list[tuple[int, int]] = []
        loops: list[tuple[int, bool]] = []
        for glob in globs:
            raw, bit, i = glob.encode(), at, 0
            starts.append(bit)
            while i < len(raw):
                if raw[i] == 0x2A:
                    anything = raw[i + 1 : i + 2] == b"*"
                    loops.append((bit, anything))
                    i += 1 + anything
                else:
                    bit += 1
                    reach.append((bit, raw[i]))
                    i += 1
            finals.append(bit)
            at = bit + 1
        self.words = max(1, -(-at // 64))
        self.start, self.reach, self.loop = np.zeros(self.words, np.uint64), np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        one = np.uint64(1)
        for bit in starts:
            self.start[bit // 64] |= one << np.uint64(bit % 64)
        for bit, byte in reach:
            self.reach[byte, bit // 64] |= one << np.uint64(bit % 64)
        for bit, anything in loops:
            mask = one << np.uint64(bit % 64)
            self.loop[:, bit // 64] |= mask
            if not anything:
                self.loop[0x2F, bit // 64] &= ~mask
        self.finals = np.array(finals, np.int64)

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A boolean for each (string, glob); strings are slices of one byte buffer."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        begin, lengths = offsets[:-1][order], lengths[order]
        state = np.tile(self.start, (len(order), 1))
        live = len(order)
        for i in range(int(lengths[0]) if len(order) else 0):
            live = int(np.searchsorted(-lengths[:live], -i, side="left"))  # those longer than i
            now = state[:live]
            byte = data[begin[:live] + i]
            shifted = now << np.uint64(1)
            shifted[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (shifted & self.reach[byte]) | (now & self.loop[byte])
        found = (state[:, self.finals // 64] >> (self.finals % 64).astype(np.uint64)) & np.uint64(1)
        out = np.empty((len(order), len(self.finals)), bool)
        out[order] = found.astype(bool)
        return out


def rule_globs(rule: str) -> tuple[str, str]:
    """The two globs of a host-and-path rule: the host itself and its subdomains."""
    return f"{rule}**", f"*.{rule}**"


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, blocked: Sequence[str] = BLOCKED, *, key: str = "page_id", url: str = "url"
) -> DataFrame:
    """One row for each page: key, host, path, rule, verdict.

    The longest rule that fits decides; of equally long ones a blocking rule does. Where none fits, rule is
    null and the verdict is block if a glob of ``blocked`` matches host and path, else allow. Globs match
    bytes of the UTF-8 text, and host case is folded for A-Z only.

    A null URL, and one without ``://``, has empty host and path; it fits no rule and no glob that needs a
    byte, and so is allowed. Repeated rows each get a row, an empty table none, and other columns are ignored.
    Work is a map over narrow rows: no shuffle, and rules reach the executors as part of the function.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1]))
    globs = [g for _, rule in ordered for g in rule_globs(rule)] + list(blocked)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = GlobAutomaton(globs)
        names = pa.array([rule for _, rule in ordered] + [None], pa.string())
        verdicts = np.array([verdict for verdict, _ in ordered], object)
        for batch in batches:
            found = automaton.matches(*utf8(batch.column("_canonical")))
            n = len(ordered)
            fits = found[:, 0 : 2 * n : 2] | found[:, 1 : 2 * n : 2]
            fits = np.concatenate([fits, np.ones((len(fits), 1), bool)], axis=1)
            best = fits.argmax(axis=1)
            other = np.where(found[:, 2 * n :].any(axis=1), "block", "allow").astype(object)
            verdict = np.where(best < n, np.append(verdicts, None)[best], other)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], names.take(pa.array(best)), pa.array(verdict.tolist(), pa.string())], names=[key, "host", "path", "rule", "verdict"])

    parts = pages.select(F.col(key), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    kind = parts.schema[0].dataType.simpleString()
    return parts.withColumn("_canonical", F.concat("host", "path")).mapInArrow(judge, f"`{key}` {kind}, host string, path string, rule string, verdict string")
