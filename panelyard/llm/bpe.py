"""BPE as a bounded-lookahead streaming transducer, and its decoder as a byte-to-text state machine.

Encoding reads a pre-token symbol by symbol and keeps only a window of them. Let two inputs agree on their
first n symbols. Merging by rank, their tokenisations can come to differ left of n only through a chain of
merges of rising rank: each takes the last token A on which both still agree together with a token B that
starts where they differ, and moves that place left by the length of A; the next merge of the chain then has
a right part that begins with A. The longest such chain, summed over the lengths of its A, is a *sufficient
lookahead*: tokens that end that far from the last symbol read are final, whatever follows. It is computed
once from the merge list. And since no merge crosses the boundary of final tokens, what follows them can be
tokenised afresh, so the window never grows beyond the lookahead and the longest token.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from copy import copy
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from panelyard.llm.buffers import SPACE_BYTES, utf8
from panelyard.llm.pieces import PieceMemory, tails


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others, in order, for the code points from 256.
    """
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Transducer:
    """Merges over one pre-token's symbols, with final tokens given out as soon as they are certain."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "") -> None:
        self.vocab, self.suffix = vocab, suffix
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.lookahead = sufficient_lookahead(merges, suffix)
        self.longest = max((len(t.removesuffix(suffix)) for t in vocab), default=1)
        self.window = 2 * (self.lookahead + self.longest)

    def merged(self, symbols: list[str]) -> list[str]:
        """All merges over a bounded list of symbols, lowest rank first, left to right."""
        rank, none = self.rank.get, len(self.rank)
        ranks = [rank(p, none) for p in pairwise(symbols)]
        while ranks and (best := min(ranks)) != none:
            i = ranks.index(best)
            symbols[i] += symbols.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank((symbols[i - 1], symbols[i]), none)
            if i < len(ranks):
                ranks[i] = rank((symbols[i], symbols[i + 1]), none)
        return symbols

    def stream(self) -> TokenStream:
        """A run of the transducer over one pre-token."""
        return TokenStream(self)

    def tokens(self, symbols: Iterable[str]) -> Iterator[str]:
        """The tokens of one pre-token, given as byte-alphabet characters in any chunks."""
        run = self.stream()
        for chunk in symbols:
            yield from run.feed(chunk)
        yield from run.close()


class TokenStream:
    """The state of a run: a window of symbols that aren't in final tokens yet, at most ``Transducer.window`` + 1."""

    def __init__(self, transducer: Transducer) -> None:
        self.transducer, self.window = transducer, []

    def feed(self, symbols: str) -> list[str]:
        """Read more symbols; the tokens that are final by now."""
        machine, given = self.transducer, []
        room = machine.window + 1 - len(self.window)
        while len(symbols) >= room:
            self.window.extend(symbols[:room])
            symbols = symbols[room:]
            done, final = 0, len(self.window) - 1 - machine.lookahead
            for token in machine.merged(self.window[:-1]):  # the last symbol may yet get the suffix
                if done + len(token) > final:
                    break
                done += len(token)
                given.append(token)
            del self.window[:done]
            room = machine.window + 1 - len(self.window)
        self.window.extend(symbols)
        return given

    def close(self) -> list[str]:
        """The tokens of what is left, now that the pre-token has ended."""
        if not self.window:
            return []
        self.window[-1] += self.transducer.suffix
        left, self.window = self.window, []
        return self.transducer.merged(left)


def sufficient_lookahead(merges: list[tuple[str, str]], suffix: str = "") -> int:
    """Symbols that must follow a token for it to be final; see the module's text."""
    lefts: dict[str, set[str]] = {}
    for a, b in merges:
        lefts.setdefault(a + b, set()).add(a)
    spines: dict[str, frozenset[str]] = {}

    def spine(token: str) -> frozenset[str]:
        if token not in spines:
            spines[token] = frozenset([token]).union(*(spine(x) for x in lefts.get(token, ())))
        return spines[token]

    reach: dict[str, int] = {}
    for a, b in merges:
        before = max((reach[x] for x in spine(b) if x in reach), default=0)
        reach[a] = max(reach.get(a, 0), before + len(a.removesuffix(suffix)))
    return max(reach.values(), default=0) + 1


class TextDecoder:
    """Ids in, text out: keeps the unfinished bytes of at most one character between calls.

    Each id has its bytes, with ``between`` before all but the first. Bytes that can't be part of a character become
    U+FFFD, as the usual replacing decoder has it, wherever the ids are cut into chunks.
    """

    def __init__(self, pieces: list[bytes], between: bytes = b"") -> None:
        self.table, self.skip, self.pending = ByteTable([between + p for p in pieces]), len(between), b""

    def feed(self, ids: np.ndarray) -> str:
        raw = self.table.join(ids)
        if len(ids) and self.skip:
            raw, self.skip = raw[self.skip :], 0
        raw = self.pending + raw
        cut = len(raw)
        for back in range(1, min(3, len(raw)) + 1):
            byte = raw[-back]
            if byte >= 0xC0:
                width = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                if width > back and raw[-back:].decode("utf-8", "replace").count("\ufffd") == 1:
                    cut = len(raw) - back
                break
            if byte < 0x80:
                break
        self.pending = raw[cut:]
        return raw[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.pending = self.pending, b""
        return rest.decode("utf-8", "replace")


class ByteTable:
    """Byte strings by number, joined for a whole array of numbers at once."""

    def __init__(self, values: list[bytes]) -> None:
        self.size = np.array([len(v) for v in values], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(values), np.uint8)

    def join(self, numbers: np.ndarray) -> bytes:
        size = self.size[numbers]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.first[numbers] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()


class WordTokenizer:
    """The lower-casing, word-end BPE of a tokenizer file, by transducer.

    Texts are cut at ASCII white space, which the tokenizer drops in any case, and ASCII signs at a piece's end are
    cut off; A to Z are lower-cased at once. A piece is normalised (NFC, then lower case character by character), cut
    into pre-tokens by the file's pattern, and each pre-token runs through the transducer. Beyond Latin, where
    Unicode versions differ in what is a letter, the library's own normaliser and pre-tokenizer do the cutting. What
    came out for a piece is remembered (see :class:`PieceMemory`); ids then run through one decoder for each text.
    """

    MEMO_PIECES = 1_000_000
    #: Bytes worked on at once; a longer text is cut at white space.
    SLAB = 1 << 20
    SPACE = np.isin(np.arange(256), SPACE_BYTES)

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        if model["type"] != "BPE" or spec["decoder"] is not None:
            raise ValueError("a BPE file without a decoder is needed here")
        self.library = Tokenizer.from_file(path)
        self.vocab = {**model["vocab"], **{a["content"]: a["id"] for a in added}}
        if max(self.vocab.values()) >= 1 << 16:
            raise ValueError("ids must fit two bytes")
        self.transducer = Transducer(model["vocab"], [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"] or "")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special = regex.compile("|".join(regex.escape(a["content"]) for a in added) or r"(?!)")
        self.alphabet = dict(enumerate(byte_alphabet()))
        names = [""] * (max(self.vocab.values()) + 1)
        for name, i in self.vocab.items():
            names[i] = name
        self.pieces = [name.encode() for name in names]
        self.decimals = ByteTable([b" %d" % i for i in range(len(names))])
        self.machine = TextDecoder(self.pieces, b" ")
        self.memory = PieceMemory(self.learn, self.MEMO_PIECES)

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens, as byte-alphabet characters."""
        if text.isascii() and text.isprintable():
            return [text.lower()] if text.isalpha() else self.pattern.findall(text.lower())
        if max(text, default="") < "\u0250":
            cut = self.pattern.findall("".join([c.lower() for c in unicodedata.normalize("NFC", text)]))
            return [found.encode().decode("latin-1").translate(self.alphabet) for found in cut]
        return [found for found, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def tokens(self, text: str) -> Iterator[str]:
        """Token names of any text, one after another, in constant memory beyond the text."""
        at = 0
        for found in [*self.special.finditer(text), None] if "<|" in text else [None]:
            for word in self.pretokens(text[at : found.start() if found else len(text)]):
                yield from self.transducer.tokens((word,))
            if found:
                yield found[0]
                at = found.end()

    def stream(self, text: str) -> Iterator[int]:
        """Ids of any text, one after another."""
        return map(self.vocab.__getitem__, self.tokens(text))

    def decoder(self) -> TextDecoder:
        """The decoder of a file without one of its own: token names with a space between."""
        fresh = copy(self.machine)
        fresh.skip, fresh.pending = 1, b""
        return fresh

    def decode(self, ids: Iterable[int]) -> str:
        machine = self.decoder()
        return machine.feed(np.fromiter(ids, np.int64)) + machine.close()

    def learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each) of pieces, by the transducer."""
        run, number, coded = self.transducer.stream(), self.vocab.__getitem__, []
        for piece in pieces:
            text = piece.decode()
            if "<|" in text:
                coded.append(list(self.stream(text)))
                continue
            ids: list[int] = []
            for word in self.pretokens(text):
                ids += map(number, run.feed(word))
                ids += map(number, run.close())
            coded.append(ids)
        return np.fromiter(chain.from_iterable(coded), np.uint16), np.fromiter(map(len, coded), np.int64, len(coded))

    def slab(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each text)."""
        n = len(data)
        shown = ~self.SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        begins = shown.copy()
        begins[1:] &= ~shown[:-1] | edge[1:n]
        ends = shown.copy()
        ends[:-1] &= ~shown[1:] | edge[1:n]
        first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        if not len(first):
            return np.zeros(0, np.uint16), np.zeros(len(offsets) - 1, np.int64)
        cut = tails(data, first, last)
        first, last = np.sort(np.append(first, cut)), np.sort(np.append(last, cut))
        fold = (data >= 65) & (data < 91)
        marks = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
        for k in np.unique(np.searchsorted(first, marks, side="right") - 1).tolist():
            fold[first[k] : last[k]] = False
        ids, size = self.memory.look_up(data | (fold.view(np.uint8) << np.uint8(5)), first, last - first)
        row = np.searchsorted(offsets, first, side="right") - 1
        return ids, np.bincount(row, size, minlength=len(offsets) - 1).astype(np.int64)

    def measure(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, str, str]]:
        """For each text: number of ids, SHA-256 of the ids in decimal joined by spaces, SHA-256 of the decoded text.

        A text goes slab by slab through the encoder, one decoder and the two hashes.
        """
        at, rows = 0, len(offsets) - 1
        while at < rows:
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + self.SLAB, side="right")) - 1)
            begin, end = int(offsets[at]), int(offsets[stop])
            if stop > at + 1 or end - begin <= 2 * self.SLAB:
                ids, counts = self.slab(data[begin:end], offsets[at : stop + 1] - begin)
                lots = ([some] for some in np.split(ids, np.cumsum(counts)[:-1]))
            else:
                lots = [self.segments(data, begin, end)]
            for parts in lots:
                decimal, words, machine, count = hashlib.sha256(), hashlib.sha256(), self.decoder(), 0
                for some in parts:
                    decimal.update(self.decimals.join(some)[0 if count else 1 :])
                    words.update(machine.feed(some).encode())
                    count += len(some)
                words.update(machine.close().encode())
                yield count, decimal.hexdigest(), words.hexdigest()
            at = stop

    def segments(self, data: np.ndarray, begin: int, end: int) -> Iterator[np.ndarray]:
        """Ids of one long text, slab by slab."""
        while begin < end:
            cut = min(end, begin + self.SLAB)
            while cut < end:
                spaces = np.flatnonzero(self.SPACE[data[cut : min(end, cut + (1 << 16))]])
                if len(spaces):
                    cut += int(spaces[0])
                    break
                cut = min(end, cut + (1 << 16))
            yield self.slab(data[begin:cut], np.array([0, cut - begin]))[0]
            begin = cut


_LOADED: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a worker process, whose memory of pieces outlives a task."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def encode_decode(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: key, n_tokens, ids_sha256, decoded_sha256, for the tokenizer file at ``path``.

    The file must be at that path on every executor. Null text counts as empty, and an empty text has no ids
    and the hashes of no bytes. Repeated rows each get a row, an empty table none; other columns are ignored.
    A map without a shuffle; a worker holds one Arrow batch, one tokenizer and its bounded memory of pieces.
    """
    kind = docs.schema[key].dataType.simpleString()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        for batch in batches:
            rows = list(tokenizer.measure(*utf8(batch.column(1))))
            counts, ids, words = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(words, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, text).mapInArrow(encode, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
