"""Token-id files compressed by Re-Pair grammars, with random access by document and by position.

A file table has one row for each block, in ascending order of (part, block), and blocks hold their
documents in ascending key order. A block is one shard of the grammar: its ids, with frequent neighbouring
pairs replaced by nonterminals over and over, and the rules that undo it.

Payload, all little endian:

    4 bytes   b"RPG1"
    5 x u32   documents n, terminals t, rules r, symbols s, bytes w of a symbol (2 or 4)
    r x 2 u32 rules: nonterminal t + i stands for these two symbols, each below t + i
    r x u32   expansion length of each rule
    n+1 x u32 first symbol of each document, and the end
    n x u32   ids of each document
    s x w     symbols
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from panelyard.llm import scratch
from panelyard.llm.bpe import byte_alphabet
from panelyard.llm.buffers import utf8
from panelyard.llm.pieces import BYTES, LETTER_OR_DIGIT, SHOWN, PieceMemory, tails

MAGIC, HEAD = b"RPG1", struct.Struct("<5I")


@dataclass(frozen=True)
class Grammar:
    """Symbols below ``terminals`` are ids; ``terminals`` + i is rule i."""

    terminals: int
    rules: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray
    starts: np.ndarray


def re_pair(ids: np.ndarray, starts: np.ndarray, terminals: int, *, rounds: int = 32, pairs_a_round: int = 4096, least: int = 32, gain: float = 0.02) -> Grammar:
    """Replace frequent neighbouring pairs by nonterminals, never across the start of a document.

    ``starts`` are the documents' first positions. Each round gives the most frequent ``pairs_a_round`` pairs a
    nonterminal each and replaces them where they stand; where two chosen pairs overlap, the more frequent one takes
    its place. Rounds go on while pairs occur ``least`` times and a round shortens the text by the share ``gain``;
    what stays unreplaced costs length, never ids. Pairs are counted in a table of hashes without a sort: a slot
    stands for the last of its pairs, whose occurrences are then counted exactly. Another pair of that slot waits for
    the next round, which hashes anew.
    """
    symbols = ids.astype(np.uint32)
    begins = np.asarray(starts, np.int64)
    rules: list[np.ndarray] = []
    made = 0
    for turn in range(rounds):
        n = len(symbols)
        if n < 2:
            break
        slot = symbols[:-1] * np.uint32(_SLOT[turn % len(_SLOT)])
        slot += symbols[1:] * np.uint32(0x85EBCA6B)
        slot ^= slot >> np.uint32(15)
        slot *= np.uint32(0xC2B2AE35)
        slot >>= np.uint32(12)
        counts = np.bincount(slot, minlength=1 << 20)
        edges = begins[(begins > 0) & (begins < n)] - 1
        counts -= np.bincount(slot[edges], minlength=1 << 20)
        many = np.flatnonzero(counts >= least)
        if not len(many):
            break
        if len(many) > 2 * pairs_a_round:
            many = many[np.argpartition(counts[many], -2 * pairs_a_round)[-2 * pairs_a_round :]]
        number = np.full(1 << 20, -1, np.int32)
        number[many] = np.arange(len(many), dtype=np.int32)
        which = number[slot]
        which[edges] = -1
        at = np.flatnonzero(which >= 0)
        which = which[at]
        one, two = symbols[at], symbols[at + 1]
        key = (one.astype(np.uint64) << np.uint64(32)) | two
        stands = np.zeros(len(many), np.uint64)
        stands[which] = key
        same = key == stands[which]
        at, which = at[same], which[same]
        exact = np.bincount(which, minlength=len(many))
        chosen = np.flatnonzero(exact >= least)
        if not len(chosen):
            continue
        chosen = chosen[np.lexsort((stands[chosen], -exact[chosen]))][:pairs_a_round]
        rank = np.zeros(len(many), np.int32)
        rank[chosen] = np.arange(len(chosen), 0, -1)
        here = np.zeros(n + 1, np.int32)
        here[at] = rank[which]
        at = at[here[at] > 0]
        mine = here[at]
        at = at[(mine >= here[at + 1]) & ((mine > here[at - 1]) | (at == 0))]
        pair = stands[chosen]
        rules.append(np.stack([pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF)], axis=1).astype(np.int64))
        symbols[at] = terminals + made + len(chosen) - here[at]
        gone = np.ones(n, bool)
        gone[at + 1] = False
        symbols = symbols[gone]
        begins = begins - np.searchsorted(at, begins)
        made += len(chosen)
        if len(at) < gain * n:
            break
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    lengths = np.ones(terminals + len(table), np.int64)
    done = terminals
    for group in rules:
        lengths[done : done + len(group)] = lengths[group[:, 0]] + lengths[group[:, 1]]
        done += len(group)
    return Grammar(terminals, table, lengths[terminals:], symbols, begins)


#: Odd multipliers, one a round in turn.
_SLOT = (0x9E3779B1, 0xB5297A4D, 0x68E31DA5, 0x1B56C4E9)


def pack(grammar: Grammar, counts: np.ndarray) -> bytes:
    """A block's payload; ``counts`` are the ids of each document, none of them 0."""
    width = 2 if grammar.terminals + len(grammar.rules) <= 1 << 16 else 4
    u32 = lambda a: np.ascontiguousarray(a).astype("<u4").tobytes()
    head = MAGIC + HEAD.pack(len(counts), grammar.terminals, len(grammar.rules), len(grammar.symbols), width)
    return b"".join([head, u32(grammar.rules), u32(grammar.lengths), u32(np.append(grammar.starts, len(grammar.symbols))), u32(counts), grammar.symbols.astype(f"<u{width}").tobytes()])


class Block:
    """A payload read back. Documents, and positions in them, are decoded without what stands before them."""

    def __init__(self, payload: bytes) -> None:
        if payload[:4] != MAGIC:
            raise ValueError("not a token block")
        n, self.terminals, r, s, width = HEAD.unpack_from(payload, 4)
        at = 4 + HEAD.size

        def take(count: int, kind: str = "<u4") -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, count, at)
            at += out.nbytes
            return out

        self.rules, lengths = take(2 * r).reshape(r, 2), take(r)
        self.starts, self.counts, self.symbols = take(n + 1), take(n), take(s, f"<u{width}")
        self.lengths = np.concatenate([np.ones(self.terminals, np.int64), lengths.astype(np.int64)])
        self._places: np.ndarray | None = None

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """All expansions end to end, and where each symbol's begins; terminals come first."""
        if self._places is None:
            begin = np.cumsum(self.lengths) - self.lengths
            flat = np.empty(int(self.lengths.sum()), np.uint32)
            flat[: self.terminals] = np.arange(self.terminals, dtype=np.uint32)
            for i, (a, b) in enumerate(self.rules.tolist()):
                at, la, lb = begin[self.terminals + i], self.lengths[a], self.lengths[b]
                flat[at : at + la] = flat[begin[a] : begin[a] + la]
                flat[at + la : at + la + lb] = flat[begin[b] : begin[b] + lb]
            self._places, self._flat = begin, flat
        return self._places, self._flat

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that a run of symbols stands for."""
        begin, flat = self._expansions()
        wide = symbols.astype(np.int64)
        size = self.lengths[wide]
        ends = np.cumsum(size)
        return flat[np.repeat(begin[wide] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.symbols[self.starts[i] : self.starts[i + 1]])

    def token(self, i: int, position: int) -> int:
        """One id of a document: expansion lengths lead to its symbol, and then down the rules."""
        symbols = self.symbols[self.starts[i] : self.starts[i + 1]].astype(np.int64)
        ends = np.cumsum(self.lengths[symbols])
        k = int(np.searchsorted(ends, position, side="right"))
        symbol, left = int(symbols[k]), position - int(ends[k] - self.lengths[symbols[k]])
        while symbol >= self.terminals:
            a, b = (int(x) for x in self.rules[symbol - self.terminals])
            symbol, left = (a, left) if left < self.lengths[a] else (b, left - int(self.lengths[a]))
        return symbol


#: ASCII letters, and the bytes of U+00C0 to U+017F.
_LATIN = ((BYTES | 32) >= 97) & ((BYTES | 32) < 123) & (BYTES < 128) | (BYTES >= 0x80) & (BYTES < 0xC0) | (BYTES >= 0xC3) & (BYTES < 0xC6)
_SPACED = dict(enumerate(byte_alphabet())) | {0x20: " \u0120"}


class ByteTokenizer:
    """The tokenizers library over texts, with what it made of each piece remembered.

    A byte-level pre-token that holds a visible character ends before the next white space, and none looks back. So
    a text may be cut before every space or line feed that follows a visible character, and after a line feed with
    visible characters on both sides: its pieces have the ids they have within the whole. ASCII signs behind an
    ASCII or Latin-1 letter or digit at a piece's end are a pre-token of their own and are cut off too, but not
    where the piece holds ``<|``, with which special tokens begin.

    All of that is found on byte buffers, and the library sees each new piece once (see :class:`PieceMemory`).
    Words of Latin letters alone are one pre-token, so they go to the library's model without its pre-tokenizer.
    """

    #: Bytes worked on at once; a longer text is cut where a piece begins.
    SLAB = 1 << 20

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        self.library, self.model = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for tokenizer in (self.library, self.model):
            tokenizer.no_truncation()
            tokenizer.no_padding()
        self.model.pre_tokenizer = WhitespaceSplit()
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit two bytes")
        self.opens = np.array([(self.library.id_to_token(i) or "").startswith("\u0120") for i in range(self.library.get_vocab_size())])
        self.memory = PieceMemory(self.learn)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, with ``end_id`` behind each, number of ids of each)."""
        parts: list[np.ndarray] = []
        counts = np.ones(len(offsets) - 1, np.int64)
        at, rows = 0, len(offsets) - 1
        while at < rows:
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + self.SLAB, side="right")) - 1)
            begin, end = int(offsets[at]), int(offsets[stop])
            if end - begin <= 2 * self.SLAB:
                ids, size, row = self.slab(data[begin:end], offsets[at : stop + 1] - begin)
                here = np.bincount(row, size, minlength=stop - at).astype(np.int64)
                counts[at:stop] += here
                parts.append(np.insert(ids, np.cumsum(here), end_id))
            else:
                while begin < end:
                    cut = self.piece_start(data, begin + self.SLAB, end)
                    ids, _, _ = self.slab(data[begin:cut], np.array([0, cut - begin]))
                    parts.append(ids)
                    counts[at] += len(ids)
                    begin = cut
                parts.append(np.array([end_id], np.uint16))
            at = stop
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint16)), counts

    @staticmethod
    def piece_start(data: np.ndarray, at: int, end: int) -> int:
        """The first space from ``at`` on that follows an ASCII letter or digit, or the end."""
        while at < end:
            some = data[at - 1 : min(end, at + (1 << 16))]
            found = np.flatnonzero((some[1:] == 0x20) & LETTER_OR_DIGIT[some[:-1]])
            if len(found):
                return at + int(found[0])
            at += 1 << 16
        return end

    @staticmethod
    def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces begin."""
        n = len(data)
        begins = np.zeros(n + 1, bool)
        begins[offsets] = True
        begins[n] = False
        gaps = np.flatnonzero((data == 0x20) | (data == 0x0A))
        gaps = gaps[gaps > 0]
        one, two, three = data[gaps - 1], data[np.maximum(gaps - 2, 0)], data[np.maximum(gaps - 3, 0)]
        blank = (two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (two == 0x9A) & (three == 0xE1) | (two == 0xA0) & (three == 0xE1) | (two == 0x81) & (three == 0xE2) & (one == 0x9F) | (two == 0x80) & (three == 0xE3) & (one == 0x80)
        blank |= (two == 0x80) & (three == 0xE2) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))
        cut = SHOWN[one] | (one >= 0x80) & ~blank
        gaps = gaps[cut]
        begins[gaps] = True
        lines = gaps[(data[gaps] == 0x0A) & (gaps + 1 < n)]
        lines = lines[SHOWN[data[lines + 1]]]
        begins[lines + 1] = True
        first = np.flatnonzero(begins)
        if not len(first):
            return first
        begins[tails(data, first, np.append(first[1:], n))] = True
        return np.flatnonzero(begins)

    def slab(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids end to end, and for each piece its number of ids and its row)."""
        first = self.cuts(data, offsets)
        ids, size = self.memory.look_up(data, first, np.diff(np.append(first, len(data))))
        return ids, size, np.searchsorted(offsets, first, side="right") - 1

    def learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each) of pieces, by the library."""
        kinds = self.kinds(pieces)
        coded = [how([pieces[i] for i in np.flatnonzero(kinds == k).tolist()]) for k, how in enumerate((self.words, self.spaced, self.alone))]
        flat, size = np.concatenate([c[0] for c in coded]), np.concatenate([c[1] for c in coded])
        order = np.argsort(kinds, kind="stable")
        starts, sizes = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        starts[order], sizes[order] = np.cumsum(size) - size, size
        ends = np.cumsum(sizes)
        return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(len(flat))], sizes

    @staticmethod
    def kinds(pieces: list[bytes]) -> np.ndarray:
        """0: a space and Latin letters (up to U+017F); 1: opens with its only space and ends visibly; 2: any other."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        first = np.cumsum(length) - length
        fits = _LATIN[data]
        fits[first] = data[first] == 0x20
        fits[1:] &= ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
        words = np.logical_and.reduceat(fits, first) & (length > 1)
        spaces = np.add.reduceat((data == 0x20).astype(np.int64), first)
        rest = (data[first] == 0x20) & (spaces == 1) & (length > 1) & SHOWN[data[first + length - 1]]
        return np.where(words, 0, np.where(rest, 1, 2))

    def alone(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each) of pieces as they stand, one call of the library for many."""
        coded = [c.ids for i in range(0, len(pieces), 4096) for c in self.library.encode_batch_fast([p.decode() for p in pieces[i : i + 4096]], add_special_tokens=False)]
        return np.array([x for c in coded for x in c], np.uint16), np.array([len(c) for c in coded], np.int64)

    def words(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As ``alone`` for a space and letters: one pre-token each, given to the model in the alphabet of bytes."""
        return self.together(self.model, pieces, lambda lot: b"".join(lot).decode("latin-1").translate(_SPACED))

    def spaced(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As ``alone`` for pieces that open with their only space and end visibly."""
        return self.together(self.library, pieces, lambda lot: b"".join(lot).decode())

    def together(self, tokenizer: Tokenizer, pieces: list[bytes], join: Callable[[list[bytes]], str]) -> tuple[np.ndarray, np.ndarray]:
        """64 pieces to a text: each begins with the only token that opens with a space. If their number is off, they go one by one."""
        flat, sizes = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
        for k in range(0, len(pieces), 4096):
            some = pieces[k : k + 4096]
            coded = tokenizer.encode_batch_fast([join(some[i : i + 64]) for i in range(0, len(some), 64)], add_special_tokens=False)
            ids = np.array([x for c in coded for x in c.ids], np.uint16)
            at = np.flatnonzero(self.opens[ids])
            if len(at) == len(some) and at[0] == 0:
                flat.append(ids)
                sizes.append(np.diff(np.append(at, len(ids))))
            else:
                ids, size = self.alone(some)
                flat.append(ids)
                sizes.append(size)
        return np.concatenate(flat), np.concatenate(sizes)


_LOADED: dict[str, ByteTokenizer] = {}


def byte_tokenizer(path: str) -> ByteTokenizer:
    """One tokenizer a worker process, whose memory of pieces outlives a task."""
    if path not in _LOADED:
        _LOADED[path] = ByteTokenizer(path)
    return _LOADED[path]


def token_blocks(docs: DataFrame, path: str, *, end_id: int = 2, block_ids: int = 1 << 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The file table: part, block, n_docs, n_ids, keys, payload.

    Texts are range-partitioned by key, and equal keys by a hash of their text, so that even a key that many
    rows share is dealt over several parts; each part is then one pass that encodes about a megabyte of texts at
    a time (or one very long document), fills a block of at least ``block_ids`` ids and compresses it.
    """
    kind = docs.schema[key].dataType.simpleString()
    terminals_min = end_id + 1

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, number = byte_tokenizer(path), TaskContext.get().partitionId(), 0
        terminals = max(terminals_min, tokenizer.library.get_vocab_size())
        keys: list[pa.Array] = []
        coded: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, keys, coded, sizes, held
            counts = np.concatenate(sizes)
            grammar = re_pair(np.concatenate(coded), np.cumsum(counts) - counts, terminals)
            all_keys = pa.concat_arrays(keys)
            row = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(counts)], pa.int64()), pa.array([int(counts.sum())], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(all_keys)], pa.int32()), all_keys), pa.array([pack(grammar, counts)], pa.binary())]
            number, keys, coded, sizes, held = number + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays(row, names=["part", "block", "n_docs", "n_ids", "keys", "payload"])

        for batch in batches:
            data, offsets = utf8(batch.column(1))
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + tokenizer.SLAB, side="right")) - 1)
                ids, counts = tokenizer.encode(data, offsets[at : stop + 1], end_id)
                coded.append(ids)
                sizes.append(counts)
                keys.append(batch.column(0).slice(at, stop - at))
                held += len(ids)
                at = stop
                if held >= block_ids:
                    yield flush()
        if coded:
            yield flush()

    tied = docs.select(F.col(key), F.col(text), F.xxhash64(F.col(text)).alias("_tie"))
    ordered = tied.repartitionByRange(F.col(key).asc_nulls_first(), "_tie").sortWithinPartitions(F.col(key).asc_nulls_first(), "_tie", text)
    return ordered.select(key, text).mapInArrow(blocks, f"part int, block int, n_docs bigint, n_ids bigint, keys array<{kind}>, payload binary")


def block_starts(files: DataFrame) -> DataFrame:
    """(part, block, block_start): ids in all blocks before. Parts' totals are summed first, then blocks within a part."""
    sizes = files.select("part", "block", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_all")).select("part", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_part_start"))
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_within", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(parts, "part").select("part", "block", (F.col("_part_start") + F.col("_within")).alias("block_start"))


def read_index(files: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """From the files alone: key, start, n_tokens, ids_crc32 of every document."""
    kind = files.schema["keys"].dataType.elementType.simpleString()

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch.column(4)[i].as_py())
                counts = block.counts.astype(np.int64)
                firsts = np.cumsum(counts) - counts
                crcs = []
                step = 256
                for d in range(0, len(counts), step):
                    last = min(d + step, len(counts))
                    ids = block.expand(block.symbols[block.starts[d] : block.starts[last]]).astype("<u4", copy=False)
                    if len(ids) != int(counts[d:last].sum()):
                        raise ValueError("a block's documents don't add up")
                    base = firsts[d]
                    crcs += [zlib.crc32(ids[firsts[j] - base : firsts[j] - base + counts[j]]) for j in range(d, last)]
                n = len(counts)
                rows = [pa.array(np.full(n, batch.column(0)[i].as_py()), pa.int32()), pa.array(np.full(n, batch.column(1)[i].as_py()), pa.int32()), batch.column(3)[i].values, pa.array(firsts), pa.array(counts), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(rows, names=["part", "block", key, "_first", "n_tokens", "ids_crc32"])

    rows = files.select("part", "block", "n_docs", "keys", "payload").mapInArrow(read, f"part int, block int, `{key}` {kind}, _first bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(block_starts(files), ["part", "block"]).select(key, (F.col("block_start") + F.col("_first")).alias("start"), "n_tokens", "ids_crc32")


def write_and_index(docs: DataFrame, path: str, out: str | None = None, *, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the token files (to ``out``, or to the cluster's shared folder) and return :func:`read_index` of them.

    Blocks travel through Spark's own writer, so files are committed whole, on any file system, and a lost
    executor only repeats its parts. Null text counts as empty: its document is the end id alone. A null key
    sorts first; rows that repeat a key stand side by side in the order of a hash of their text. An empty
    table gives an empty file table and index. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    out = out or scratch.table_path(spark, "token-files")
    blocks = token_blocks(docs, path, end_id=end_id, key=key, text=text)
    blocks.write.parquet(out)
    return read_index(spark.read.schema(blocks.schema).parquet(out), key=key)
