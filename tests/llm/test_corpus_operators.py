from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm.fixtures import frame, odd, ordinary, prose
from tokenizers import Tokenizer

from panelyard.llm import bpe, mixing, near_duplicates, quality_rules, sharding, shingles, sketches, token_files, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tables(spark):
    return [("ordinary", ordinary()), ("odd", odd()), ("empty", [])]


@pytest.mark.parametrize("which", ["ordinary", "odd", "empty"])
class TestEveryTable:
    @pytest.fixture
    def texts(self, which):
        return {"ordinary": ordinary(), "odd": odd(), "empty": []}[which]

    @pytest.fixture
    def docs(self, spark, texts):
        return frame(spark, texts)

    def test_shards(self, docs, texts):
        got = sharding.assign_shards(docs).collect()
        assert len(got) == len(texts)
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
            assert r["grown_shard"] in (r["shard"], 16)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        key = lambda d, s, c: (d is not None, d or 0, s, c)
        assert sorted(key(r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted(key(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in texts)
        assert len({(r["doc_id"], r["shard"]) for r in got}) == len({d for d, _, _ in texts})

    def test_mix(self, docs, texts):
        got = mixing.mix_sizes(docs).collect()
        assert len(got) == len(texts)
        assert sum(r["size"] for r in got) == sum(len(WORD.findall(t or "")) for _, t, _ in texts)
        assert all(r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] for r in got)
        again = mixing.mix_sizes(docs.repartition(3)).collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, again))
        copies = mixing.mix(docs)
        assert copies.columns == docs.columns
        assert sum(len(WORD.findall(r["text"] or "")) for r in copies.collect()) == sum(r["taken"] for r in got)

    def test_quality_rules(self, docs, texts):
        got = quality_rules.judge_quality(docs).collect()
        measured = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got)
        expected = Counter()
        for d, t, _ in texts:
            t = t or ""
            w = WORD.findall(t)
            count = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
            covered = {j for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
            lines = [x for x in t.split("\n") if WORD.search(x)]
            failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
            expected[(d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed)] += 1
        assert measured == expected
        assert all(not r["kept"] for r in got if r["base_failed"])

    def test_fingerprints(self, docs, texts):
        got = sketches.fingerprints(docs).collect()
        assert len(got) == len(texts)
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
        if all(d is not None for d, _, _ in texts) and len({d for d, _, _ in texts}) == len(texts):
            pattern = re.compile(sketches.PARAGRAPH)
            order = sorted(texts, key=lambda x: -x[0])
            by = {r["doc_id"]: r for r in got}
            same = {}
            for i, (d, t, _) in enumerate(order):
                after = order[(i + 1) % len(order)][1]
                cut = len(t) // 3
                edited = t[: len(t) - cut] + after[:cut]
                a, b, n = (set(pattern.findall(x)) for x in (t, edited, after))
                dice = lambda x, y: 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0
                r = by[d]
                assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
                assert r["n_chars"] == len(t)
                assert r["near_edited"] == pytest.approx(dice(a, b)) and r["near_next"] == pytest.approx(dice(a, n))
                assert same.setdefault(t, r["fingerprint"]) == r["fingerprint"]

    def test_bpe(self, docs, texts):
        library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
        got = Counter(map(tuple, bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json")).collect()))
        expected = Counter()
        for d, t, _ in texts:
            ids = library.encode(t or "", add_special_tokens=False).ids
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            expected[(d, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))] += 1
        assert got == expected

    def test_token_files(self, docs, texts):
        library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        got = token_files.write_and_index(docs, public_tokenizers.path("byte_bpe_50k.json")).orderBy("start").collect()
        ids = [(d, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for d, t, _ in texts]
        crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((d, len(x), crc(x)) for d, x in ids)
        at, last = 0, None
        for r in got:
            assert r["start"] == at
            at += r["n_tokens"]
            assert last is None or r["doc_id"] >= last
            last = r["doc_id"]

    def test_near_duplicates(self, docs, texts):
        got = near_duplicates.near_duplicates(docs).collect()
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == Counter(components(texts))
        kept = near_duplicates.keep_one(docs)
        assert kept.columns == docs.columns


def components(texts: list[tuple]) -> list[tuple]:
    sets = []
    for _, t, _ in texts:
        w = WORD.findall((t or "").translate(FOLD))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and texts[i][0] is not None and texts[j][0] is not None and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(texts):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), d if d is None else least[find(i)], True if d is None else least[find(i)] == d) for i, (d, _, _) in enumerate(texts)]


def test_near_duplicates_of_chains_and_hubs(spark):
    """Copies of copies reach one another, and a text near a hub but not near its other neighbours is found."""
    base = [f"w{i}" for i in range(220)]
    texts = []
    for g in range(12):
        changed = list(base)
        for j in range(6):
            changed[(g * 17 + j * 35) % 220] = f"g{g}x{j}"
        texts.append((g, " ".join(changed), "s"))
    texts.append((50, " ".join(base), "s"))
    texts += [(60 + i, " ".join(base[: 210 - 20 * i] + [f"n{i}y{j}" for j in range(10 + 20 * i)]), "s") for i in range(4)]
    got = near_duplicates.near_duplicates(frame(spark, texts)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == Counter(components(texts))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_a_slab_of_few_words(n):
    data = np.frombuffer(" ".join(["hello", "world", "a", "b", "c"][:n]).encode(), np.uint8)
    (first, flat, bounds), = shingles.shingle_sets(data, np.array([0, len(data)]))
    assert (first, len(flat), bounds.tolist()) == (0, 1, [0, 1])
    alone = flat[0]
    more = np.concatenate([data, np.frombuffer(b"one two three four five six seven", np.uint8)])
    (_, flat, bounds), = shingles.shingle_sets(more, np.array([0, len(data), len(more)]))
    assert flat[0] == alone and bounds.tolist() == [0, 1, 4]


def test_url_rules_against_plain_code(spark):
    urls = [
        None, "", "no scheme", "http://example.org/es/1", "http://EXAMPLE.org/en/17?x", "https://a.example.org/en/2", "http://example.com/fr/", "http://x.com/de/9#z", "http://org/", "http://a.org", "http://forg/", "http://notexample.org/es/",
        "ftp://u:p@www.casino-win.net/x", "http://h.net/a://b/c", "http:///path", "http://é.com/fr/ü", "http://example.org/es", "http://spam.example.com/fr/1", "http://" + "a" * 400 + ".net/" + "b" * 3000,
    ]
    rows = [(i, u, "<html>", "x") for i, u in enumerate(urls)]
    got = {r["page_id"]: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string, rule string")).collect()}
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(FOLD), m[2]) if m else ("", "")
        best = None
        for verdict, rule in url_filter.RULES:
            h, p = rule.split("/", 1)
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
                best = (verdict, rule)
        blocked = any(g.strip("*") in host + path for g in url_filter.BLOCKED)
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        assert (got[i]["rule"], got[i]["verdict"]) == ((best[1], best[0]) if best else (None, "block" if blocked else "allow"))
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def test_automaton_spans_words():
    globs = ["ab*cd", "**" + "x" * 100 + "**", "a/*/z", "**end"]
    texts = ["abcd", "ab--cd", "ab/cd", "1" + "x" * 100 + "2", "x" * 99, "a/b/z", "a/b/c/z", "the end", "end", ""]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    got = url_filter.GlobAutomaton(globs).matches(data, offsets)
    plain = [re.compile("".join("(?s:.*)" if p == "**" else "[^/]*" if p == "*" else re.escape(p) for p in re.split(r"(\*\*|\*)", g)) + r"\Z") for g in globs]
    assert got.tolist() == [[bool(p.match(t)) for p in plain] for t in texts]


def test_jump_moves_only_into_the_added_shard():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 20_000, dtype=np.uint64)
    before = sharding.jump(keys, 16)
    after = sharding.jump(keys, 17)
    moved = before != after
    assert (after[moved] == 16).all() and 0.045 < moved.mean() < 0.075
    assert np.bincount(before, minlength=16).min() > 1000


def test_lookahead_is_sufficient():
    merges = [("a", "b"), ("b", "c"), ("c", "d"), ("ab", "cd"), ("d", "a"), ("bc", "da")]
    tokens = {"a", "b", "c", "d"} | {x + y for x, y in merges}
    t = bpe.Transducer({x: i for i, x in enumerate(sorted(tokens))}, merges)
    r = np.random.default_rng(3)
    for _ in range(300):
        s = "".join(r.choice(list("abcd"), r.integers(1, 120)))
        assert list(t.tokens(s)) == t.merged(list(s))


def test_re_pair_round_trip_and_random_access():
    r = np.random.default_rng(4)
    ids = np.tile(r.integers(0, 50, 40), 200).astype(np.uint16)
    starts = np.arange(0, len(ids), 250)
    grammar = token_files.re_pair(ids, starts, 50_257, least=2)
    assert len(grammar.symbols) < len(ids) / 4
    block = token_files.Block(token_files.pack(grammar, np.diff(np.append(starts, len(ids)))))
    for i, a in enumerate(starts):
        assert (block.document(i) == ids[a : a + 250]).all()
        assert block.token(i, 99) == ids[a + 99]


def plain_sketch(digests, cells):
    """Cells in use by (table, place): count and XOR, from the definition."""
    out = {}
    for d in digests:
        u = d & (2**64 - 1)
        for table, h in enumerate((u >> 48, (u >> 32) ^ u, u >> 16)):
            n, x = out.get((table, h & (cells - 1)), (0, 0))
            out[table, h & (cells - 1)] = (n + 1, x ^ u)
    return {at: c for at, c in out.items() if c != (0, 0)}


def read_sketch(text):
    cells, _, rest = text.partition(":")
    out = {}
    for part in filter(None, rest.split(",")):
        place, n, x = part.split(".")
        table, at = place.split("/")
        out[int(table), int(at, 16)] = (int(n, 16), int(x, 16))
    return int(cells, 16), out


def plain_peel(one, other, cells):
    """(mine, theirs) of two sketches of as many cells, or None: one pure cell at a time."""
    left = {at: [one.get(at, (0, 0))[0] - other.get(at, (0, 0))[0], one.get(at, (0, 0))[1] ^ other.get(at, (0, 0))[1]] for at in {*one, *other}}
    found = {1: 0, -1: 0}
    while True:
        pure = next(((n, x) for n, x in left.values() if abs(n) == 1 and len(plain_sketch([x], cells)) and all(at in left for at in plain_sketch([x], cells)) and checked(x)), None)
        if pure is None:
            return (found[1], found[-1]) if all(c == [0, 0] for c in left.values()) else None
        n, x = pure
        found[n] += 1
        for at in plain_sketch([x], cells):
            left[at][0] -= n
            left[at][1] ^= x


CHECKED = {}


def checked(x):
    return CHECKED.get(x, False)


def test_sketches_against_plain_code(spark):
    """Cells, folding and peeling of the fingerprints themselves; retries then find the exact difference at any size."""
    lists = [(list(range(1, n + 1)), list(range(n // 3, n + n // 5))) for n in (0, 1, 9, 40, 400)] + [([], list(range(30))), (list(range(700)), list(range(9000, 9900)))]
    df = spark.createDataFrame(lists, "a array<bigint>, b array<bigint>")
    make = lambda c: sketches.digests(F.array_join(F.transform(c, lambda v: F.concat(F.lit("line "), v.cast("string"))), "\n"))
    rows = sketches.sketched(df.select("a", "b", make(F.col("a")).alias("x_d"), make(F.col("b")).alias("y_d")), "x", "y")
    least = F.least("x_c", "y_c")
    rows = rows.withColumn("first", sketches.peeled(sketches.subtracted(F.col("x_s"), F.col("y_s"), least), least))
    rows = rows.withColumn("xt", sketches.shown(F.col("x_s"), F.col("x_c"))).withColumn("yt", sketches.shown(F.col("y_s"), F.col("y_c")))
    ended = 0
    for r in sketches.with_likeness(rows, "x", "y", "like").collect():
        a, b = set(r["a"]), set(r["b"])
        assert r["like"] == pytest.approx(2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0)
        mask = 2**64 - 1
        CHECKED.update({d & mask: True for d in r["x_d"] + r["y_d"]})
        for d, text in ((r["x_d"], r["xt"]), (r["y_d"], r["yt"])):
            cells, got = read_sketch(text)
            assert cells >= max(16, len(d)) and cells & (cells - 1) == 0
            assert got == plain_sketch(d, cells)
        cells = min(read_sketch(r["xt"])[0], read_sketch(r["yt"])[0])
        expected = plain_peel(plain_sketch(r["x_d"], cells), plain_sketch(r["y_d"], cells), cells)
        assert (None if r["first"] is None else tuple(r["first"])) == expected
        ended += expected is not None
    assert ended >= 4


def test_short_texts_share_the_paragraphs_they_keep(spark):
    """A text of 300 characters whose last third is replaced still shares the sentences before it."""
    texts = [(i, " ".join(f"Text {i} has a sentence with the number {j} that is about seventy letters." for j in range(4)), "s") for i in range(2)]
    assert all(280 < len(t) < 320 for _, t, _ in texts)
    got = sketches.fingerprints(frame(spark, texts)).collect()
    assert all(0.4 < r["near_edited"] < 0.7 and r["near_next"] == 0 for r in got)


def test_text_decoder_keeps_unfinished_characters():
    raw = "añ中😀z".encode() + b"\xff\xe4\xb8"
    machine = bpe.TextDecoder([bytes([b]) for b in range(256)])
    pieces = [machine.feed(np.array([b])) for b in raw]
    assert "".join(pieces) + machine.close() == raw.decode("utf-8", "replace")
    assert pieces[1] == "" and pieces[2] == "ñ"
    r = np.random.default_rng(8)
    for _ in range(300):
        odd_bytes = r.choice(np.frombuffer(raw + b"\xc0\x80\xed\xa0\x80\xf5\x90ab", np.uint8), 12)
        machine = bpe.TextDecoder([bytes([b]) for b in range(256)])
        assert "".join(machine.feed(x) for x in np.split(odd_bytes, sorted(r.integers(0, 12, 3)))) + machine.close() == odd_bytes.tobytes().decode("utf-8", "replace")


def test_window_never_grows():
    tokenizer = bpe.word_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    machine, r = tokenizer.transducer, np.random.default_rng(6)
    word = "".join(r.choice(list("etaoinshr"), 20_000))
    run, out, widest = machine.stream(), [], 0
    for i in range(0, len(word), 97):
        out += run.feed(word[i : i + 97])
        widest = max(widest, len(run.window))
    out += run.close()
    assert widest <= machine.window
    assert [tokenizer.vocab[t] for t in out] == tokenizer.library.encode(word, add_special_tokens=False).ids


ATOMS = [
    "a", "B", "word", "the", " ", " ", "  ", "\n", "\n\n", "\t", ".", ",", "…", "”", "™", "—", "-", "中", "é", "É", "ß", "1", "23", "'s", "'S", "'", "\u3000", "\u2009", "\xa0", "\x1c", "\x85",
    "<|", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "|>", "😀", "e\u0301", "×", "²", "®", "\r\n", "$", "\u200b", "ª", "ñandú", "Über", "İ", "Σ", "x" * 60,
]


def fuzzed(n, seed):
    r = np.random.default_rng(seed)
    return ["".join(r.choice(ATOMS, r.integers(0, 14))) for _ in range(n)] + ["ab" * 5000 + " " + "word, " * 400_000, ""]


def test_word_tokenizer_against_the_library():
    tokenizer = bpe.word_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    texts = fuzzed(20_000, 1)
    got = tokenizer.measure(*bpe.utf8(pa.array(texts)))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for text, row in zip(texts, got, strict=True):
        ids = tokenizer.library.encode(text, add_special_tokens=False).ids
        assert row == (len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.library.decode(ids, skip_special_tokens=False))), text[:200]


def test_byte_tokenizer_against_the_library():
    tokenizer = token_files.byte_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    texts = fuzzed(50_000, 2) + ['word abc…" next', "x™: y", "a—\" b", "c®, d", "e….. f", "—- g", "中…. h"]
    ids, counts = tokenizer.encode(*token_files.utf8(pa.array(texts)), 2)
    for text, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert got.tolist() == [*tokenizer.library.encode(text, add_special_tokens=False).ids, 2], text[:200]


def test_families_of_near_copies_in_blocks(spark):
    """Some hundred copies of one text, many of them just under the threshold to one another, against brute force."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for d in range(330):
        words = list(base)
        for at in r.sample(range(100), r.choice([0, 1, 2, 3, 4, 5])):
            words[at] = f"d{d}x{at}"
        texts.append((d, " ".join(words), "s"))
    got = near_duplicates.near_duplicates(frame(spark, texts)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == Counter(components(texts))
    assert len({r["component_id"] for r in got}) > 3


def test_keep_one_keeps_what_near_duplicates_keeps(spark):
    """Rows without key take no part, though they are near copies of keyed ones; of a row that repeats key and text one stays."""
    r = random.Random(4)
    base = prose(r, 60)
    texts = odd() + [(None, base, "s"), (None, base + " more", "s"), (50, base + " other", "s"), (51, base, "s"), (51, None, "s"), (51, None, "s"), (52, " ", "s"), (52, " ", "s"), (53, prose(r, 30), "s"), (53, prose(r, 31), "s")]
    expected: Counter = Counter()
    for (d, t, _), (_, n, _, kept) in zip(texts, components(texts), strict=True):
        if kept:
            expected[d, t] = expected[d, t] + 1 if d is None or not n else 1
    assert Counter((x["doc_id"], x["text"]) for x in near_duplicates.keep_one(frame(spark, texts)).collect()) == expected
    assert expected[50, base + " other"] == 1 and expected[51, None] == 2 and expected[None, base] == 1


def test_block_links_equal_plain_sets():
    r = np.random.default_rng(7)
    sets = [np.unique(r.choice(np.arange(60), r.integers(30, 60))).astype(np.int64) for _ in range(80)]
    bounds = np.cumsum([0, *map(len, sets)])
    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(np.concatenate(sets)))
    left, right = np.arange(0, 40), np.arange(30, 80)
    got = near_duplicates._shared_counts(lists, left, right)
    assert got.tolist() == [[len(set(sets[i]) & set(sets[j])) for j in right] for i in left]


def plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_are_the_published_jump_hash(spark):
    keys = np.random.default_rng(2).integers(0, 1 << 63, 3000, dtype=np.uint64)
    for shards in (1, 2, 16, 17, 1000):
        assert sharding.jump(keys, shards).tolist() == [plain_jump(int(k), shards) for k in keys]
    docs = frame(spark, ordinary())
    hashes = {r["doc_id"]: r["x"] % 2**64 for r in docs.select("doc_id", F.xxhash64("doc_id").alias("x")).collect()}
    for r in sharding.assign_shards(docs).collect():
        assert (r["shard"], r["grown_shard"]) == (plain_jump(hashes[r["doc_id"]], 16), plain_jump(hashes[r["doc_id"]], 17))


def test_written_shards_hold_every_row_once(spark, tmp_path):
    docs = frame(spark, ordinary(40) + odd())
    sharding.write_shards(docs, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((d, t) for d, t, _ in ordinary(40) + odd())
    assert back.groupBy("doc_id").agg(F.count_distinct("shard").alias("n")).where("n > 1").isEmpty()


def test_clashing_column_names(spark):
    docs = frame(spark, ordinary(30))
    clashing = docs.withColumnsRenamed({"size": "_mix_copies", "shard": "_mix_seed", "score": "_gone_k", "kept": "_mix_source", "h": "_gone_t", "k": "_key", "t": "_text", "text_hash": "_mix_rate"})
    assert clashing.count() == 30
    for made in (mixing.mix(clashing), near_duplicates.keep_one(clashing)):
        assert made.columns == clashing.columns
        assert {r["_mix_copies"] for r in made.collect()} == {"size"} and {r["_gone_k"] for r in made.collect()} == {"score"}
    for made in (near_duplicates.near_duplicates(clashing), sketches.fingerprints(clashing), sharding.assign_shards(clashing), quality_rules.judge_quality(clashing), mixing.mix_sizes(clashing)):
        assert made.count() == 30


def test_the_cascade_orders_rules_by_rejection_per_character_read(spark):
    """Shares and costs against plain code over the whole table as sample, the same order every time, and one hot key."""
    texts = ordinary(80) + [(500, "A shouted line HERE!! " * 9, "s")] * 60 + [(None, None, None)]
    docs = frame(spark, texts)
    runs = [quality_rules.rejection_order(docs.repartition(1 + i % 3), quality_rules.RULES, sample_rows=10_000) for i in range(5)]
    names = [[r.name for r, _, _ in run] for run in runs]
    assert all(n == names[0] for n in names) and sorted(names[0]) == sorted(r.name for r in quality_rules.RULES)
    chars = sum(len(t or "") for _, t, _ in texts) / len(texts)
    rows = quality_rules.judge_quality(docs).collect()
    for rule, share, cost in runs[0]:
        if rule.name == "symbols_to_words":
            assert (share, cost) == (sum(2 * r["n_symbols"] > r["n_words"] for r in rows) / len(rows), quality_rules.STEP)
        if rule.name == "repeated_lines":
            assert cost == pytest.approx(quality_rules.STEP + chars * sum(r["n_dup_lines"] >= 3 for r in rows) / len(rows))
        if rule.name == "shouting":
            assert cost == pytest.approx(quality_rules.STEP + chars)
    worth = [share / cost for _, share, cost in runs[0]]
    assert worth == sorted(worth, reverse=True)
    few = quality_rules.rejection_order(docs, quality_rules.RULES, sample_rows=20)
    assert {r.name for r, _, _ in few} == set(names[0])
    kept = {(r["doc_id"], r["kept"]) for r in rows}
    assert kept == {(r["doc_id"], r["kept"]) for r in quality_rules.judge_quality(docs, tuple(reversed(quality_rules.RULES))).collect()}
