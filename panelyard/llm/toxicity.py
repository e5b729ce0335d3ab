"""Toxicity by noisy-channel deobfuscation: restore disguised words, then score what they say."""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections import Counter, defaultdict, deque
from collections.abc import Callable, Container, Iterable, Iterator
from itertools import compress, islice, product
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm import scratch
from panelyard.llm.labelled import Logistic, class_weights, fold, labelled_texts

FOLDS, HELD = 3, 1
#: What a character may stand for besides itself.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
#: Costs of the channel, in nats, besides those of the character model.
SWAP, STAY, STAY_LEET, DROP, DROP_LEET, SINGLE, DOUBLE, UNKNOWN = 0.4, 0.3, 4.0, 0.7, 6.0, 0.8, 0.4, 9.0
#: White space within a run of single characters: kept as a word's end or dropped, where it is as narrow as the narrowest of the run, and where it is wider.
NARROW, WIDE = (1.5, 0.2), (0.2, 2.0)
#: Costs that a character model remembers.
COSTS = 200_000
#: The word's edge, and all characters that no training word has, in a state.
EDGE, OTHER = "^", "\0"


def trigrams(words: Counter[str]) -> Counter[str]:
    """Trigrams of words that stand as often as their counts say."""
    out: Counter[str] = Counter()
    for word, n in words.items():
        padded = EDGE + EDGE + word + EDGE
        for i in range(2, len(padded)):
            out[padded[i - 2 : i + 1]] += n
    return out


class CharacterModel:
    """Interpolated character trigrams over words."""

    def __init__(self, lots: Iterable[Counter[str]]) -> None:
        three: Counter[str] = Counter()
        for words in lots:
            three.update(trigrams(words))
        self.counted(three)

    @classmethod
    def of(cls, three: Counter[str]) -> CharacterModel:
        """The model of trigrams counted elsewhere."""
        out = cls(())
        out.counted(three)
        return out

    def counted(self, three: Counter[str]) -> None:
        two: Counter[str] = Counter()
        one: Counter[str] = Counter()
        for gram, n in three.items():
            two[gram[1:]] += n
            one[gram[2]] += n
        over2: Counter[str] = Counter()
        over1: Counter[str] = Counter()
        for gram, n in three.items():
            over2[gram[:2]] += n
        for gram, n in two.items():
            over1[gram[0]] += n
        total = sum(one.values()) or 1
        self.one = {c: n / total for c, n in one.items()}
        self.two = {g: n / over1[g[0]] for g, n in two.items()}
        self.three = {g: n / over2[g[:2]] for g, n in three.items()}
        self.costs: dict[str, float] = {}

    def cost(self, history: str, char: str) -> float:
        gram = history + char
        out = self.costs.get(gram)
        if out is None:
            p = 0.6 * self.three.get(gram, 0.0) + 0.3 * self.two.get(gram[1:], 0.0) + 0.1 * self.one.get(char, 0.0)
            out = -math.log(p) if p > 0 else UNKNOWN
            if len(self.costs) >= COSTS:
                self.costs.clear()
            self.costs[gram] = out
        return out

    def text_cost(self, word: str) -> float:
        history, total = EDGE + EDGE, 0.0
        for char in word + EDGE:
            total += self.cost(history, char)
            history = history[1] + char
        return total


class Restorer:
    """Viterbi decoding of a word's character lattice.

    A run of one character is an arc set of the lattice: a letter stays as it is, or doubled and longer runs
    shrink to one or two; a leet sign becomes a letter it may stand for; any sign ends a word or is dropped, and so
    does white space, so that spaced-out words are closed up and told apart. States are the last two letters written, so that the best
    path under channel and character model is found exactly. Characters that the model never saw cost the same
    before and after any letter, so they are one letter of a state. The whole word is decoded, in time linear in
    its length: each run keeps back-pointers, and what was written is read off the best path at the end.
    """

    RUN = re.compile(r"\s+|(.)\1*", re.DOTALL)

    def __init__(self, model: CharacterModel) -> None:
        self.model = model

    @staticmethod
    def arcs(char: str, length: int) -> list[tuple[str, float]]:
        if char.isalpha():
            if length == 1:
                return [(char, 0.0)]
            if length == 2:
                return [(char * 2, 0.0), (char, SINGLE + 0.5)]
            return [(char, SINGLE), (char * 2, DOUBLE + SINGLE)]
        out = [(char * length, (STAY_LEET if char in LEET else STAY) * min(length, 2))]
        for letter in LEET.get(char, ""):
            out += [(letter, SWAP + (SINGLE if length > 1 else 0.0)), (letter * 2, SWAP + DOUBLE)] if length > 1 else [(letter, SWAP)]
        out.append(("", (DROP_LEET if char in LEET else DROP) * min(length, 2)))
        return out

    def readings(self, word: str) -> set[str] | None:
        """All words that the lattice of a piece without white space may write; None where it has more than ``READINGS`` paths."""
        arcs, paths = [], 1
        for run in self.RUN.finditer(word):
            arcs.append([out for out, _ in self.arcs(run[1], len(run[0]))])
            paths *= len(arcs[-1])
            if paths > READINGS:
                return None
        return {w for path in product(*arcs) for w in WORD_BREAK.split("".join(path))}

    def restore(self, word: str, space: tuple[float, float] | None = None) -> str:
        """What a word, or a run of pieces with white space between, most likely says; ``space`` costs keeping and dropping any white space."""
        cost, known, costs = self.model.cost, self.model.one, self.model.costs
        begin = EDGE + EDGE
        states: dict[str, float] = {begin: 0.0}
        back: list[tuple[list[tuple[str, float]], array]] = []
        narrow = min(map(len, SPACE.findall(word)), default=0)
        for run in self.RUN.finditer(word):
            if run[0].isspace():
                keep, drop = space or (WIDE if len(run[0]) > narrow else NARROW)
                arcs = [(" ", keep), ("", drop)]
            else:
                arcs = self.arcs(run[1], len(run[0]))
            after: dict[str, float] = {}
            came: dict[str, int] = {}
            for a, (out, channel) in enumerate(arcs):
                for h, (history, so_far) in enumerate(states.items()):
                    total, last = so_far + channel, history
                    for char in out:
                        if char.isalpha():
                            step = costs.get(last + char)
                            total += cost(last, char) if step is None else step
                            last = last[1] + (char if char in known else OTHER)
                        elif last != begin:
                            total, last = total + cost(last, EDGE), begin
                    if last not in after or total < after[last]:
                        after[last], came[last] = total, h * len(arcs) + a
            states = after
            back.append((arcs, array("L", came.values())))
        ends = [so_far + (cost(history, EDGE) if history != begin else 0.0) for history, so_far in states.items()]
        at, written = ends.index(min(ends)), []
        for arcs, came_from in reversed(back):
            at, a = divmod(came_from[at], len(arcs))
            written.append(arcs[a][0])
        return "".join(reversed(written))


STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„’‘…¿¡—–"
#: Signs that end ordinary words.
CLOSING = ".,;:!?\"')]}»”’…-"
#: Besides them signs that stand for no letter, so that at a word's ends they only end it.
OUTSIDE = CLOSING + "#%&*/<=>[\\^_`{~"
SPACE = re.compile(r"\s+")
#: A letter next to a leet sign or digit, any signs between letters, or a letter twice.
SUSPECT = re.compile(r"[^\W\d_][0-9@$!|+(€£¡]|[0-9@$!|+(€£¡][^\W\d_]|[^\W\d_](?:[^\w\s]|_)+[^\W\d_]|([^\W\d_])\1", re.DOTALL)
#: Three or more single characters in a row, signs beside them or not, with any white space between.
SPACED = re.compile(r"(?<!\S)(?:(?>[^\w\s]{0,2}+\w[^\w\s]{0,2}+|[@$!|+€£])\s++){2,}+(?>[^\w\s]{0,2}+\w[^\w\s]{0,2}+|[@$!|+€£])(?!\S)|(?<!\S)(?:(?>[^\w\s]{0,2}+\w[^\w\s]{0,2}+|[@$!|+€£])\s++){3,}+")
WORD_BREAK = re.compile(r"[\W\d_]+")
#: ASCII signs, for which nothing stands when pieces are joined.
SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
SINGLE_PIECE = re.compile(r"[^\w\s]{0,2}\w[^\w\s]{0,2}|[@$!|+€£]")
TWICE = re.compile(r"(.)\1", re.DOTALL)
DOUBLED = "|".join(c * 2 for c in "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100))))
THRICE = re.compile(r"(.)\1\1", re.DOTALL)
RUN = re.compile(r"(.)\1*", re.DOTALL)


def core(piece: str) -> str:
    """A piece in lower case, without signs and digits behind it and without signs before it, but for leet signs next to a letter."""
    low = piece.lower().rstrip(STRIP).rstrip("0123456789").rstrip(STRIP)
    bare = low.lstrip(STRIP)
    ahead = low[len(low) - len(bare) - 1 : len(low) - len(bare)]
    return ahead + bare if ahead and ahead in LEET else bare


def features(word: str) -> list[str]:
    """A word and its beginnings: stems matter in languages that inflect. One or two letters say nothing."""
    if len(word) < 3:
        return []
    out = ["=" + word]
    if len(word) > 4:
        out.append(word[:4])
    if len(word) > 5:
        out.append(word[:5])
    if len(word) > 6:
        out.append(word[:6])
    return out


def plain_words(text: str) -> Counter[str]:
    """Words of a text that don't look disguised; letters that stand twice are ordinary, three times they aren't."""
    return Counter(w for w in map(core, text.split()) if w.isalpha() and not THRICE.search(w))


#: Paths of a lattice that are written out to tell whether it is worth a search.
READINGS = 32
#: Toxic rows that a feature must be in.
LEAST_ROWS = 2


class ToxicityModel:
    """Log odds of restored words and their beginnings, with a calibration of the strongest in a document.

    The calibration is a logistic fit on the largest weight, with bends at 3 and 4 so that one sure word can decide, the
    sum of the four largest weights of distinct pieces, the share of pieces that carry weight, and the number of
    distinct pieces, also times a weak largest weight: many words hold a weak one by chance. It is fitted out of fold:
    each quarter of the labelled rows is measured with the weights of the other three; the weights kept are those of all rows.
    """

    MEMO_CHARS, MEMO_PIECES, MEMO_RUNS = 48, 150_000, 20_000
    #: Bytes of texts that are measured together; a longer text is measured alone.
    SLAB = 4 << 20
    LEAST, QUARTERS = 1.2, 4

    def __init__(self, rows: list[tuple[int, str]], sizes: dict[int, int]) -> None:
        self.restorer = Restorer(CharacterModel(plain_words(text) for _, text in rows))
        self.weights: dict[str, float] = {}
        self.memo: dict[str, float] = {}
        counts = [[Counter(), Counter()] for _ in range(self.QUARTERS)]
        totals = [[0, 0] for _ in range(self.QUARTERS)]
        # A feature needs two toxic rows to carry weight, so only those are counted in the rows that aren't toxic.
        among_toxic: Counter[str] = Counter()
        for found in self.row_features(text for label, text in rows if label):
            among_toxic.update(found)
        may = {f for f, n in among_toxic.items() if n >= LEAST_ROWS}
        del among_toxic
        for i, found in enumerate(self.row_features((text for _, text in rows), may)):
            counts[i % self.QUARTERS][rows[i][0]].update(found)
            totals[i % self.QUARTERS][rows[i][0]] += 1
        whole = [sum((c[y] for c in counts), Counter()) for y in (0, 1)]
        total = [sum(t[y] for t in totals) for y in (0, 1)]
        y = np.array([label for label, _ in rows], float)
        x = np.zeros((len(rows), 4))
        for q in range(self.QUARTERS):
            self.weigh([whole[y] - counts[q][y] for y in (0, 1)], [total[y] - totals[q][y] for y in (0, 1)])
            self.memo = {}
            x[q :: self.QUARTERS] = self.measures(pa.array([text for _, text in rows[q :: self.QUARTERS]], pa.string()))
        self.calibration = Logistic(bent(x), y, class_weights(y, sizes))
        self.weigh(whole, total)
        self.memo = {}

    @classmethod
    def of(cls, restorer: Restorer, weights: dict[str, float], calibration: Logistic | None = None) -> ToxicityModel:
        """A model of what was counted elsewhere."""
        out = cls.__new__(cls)
        out.restorer, out.memo, out.calibration = restorer, {}, calibration
        out.weighted(weights)
        return out

    def row_features(self, texts: Iterable[str], among: Container[str] | None = None) -> Iterator[set[str]]:
        """The distinct features of each text, all or those ``among``; what pieces say is remembered for a bounded number of them."""
        said: dict[str, tuple[str, ...]] = {}
        for text in texts:
            pieces = text.split()
            distinct = set(pieces)
            found: set[str] = set()
            for piece in distinct.union(spaced(text, pieces, distinct)):
                has = said.get(piece)
                if has is None:
                    said_words = self.words(piece) if among is None else self.words_among(piece, among)
                    has = tuple(f for w in said_words for f in features(w) if among is None or f in among)
                    if len(said) >= self.MEMO_PIECES:
                        said.clear()
                    said[piece] = has
                if has:
                    found.update(has)
            yield found

    def weigh(self, counts: list[Counter[str]], totals: list[int]) -> None:
        self.weighted(log_odds(counts, totals, self.LEAST))

    def weighted(self, weights: dict[str, float]) -> None:
        self.weights = weights
        self.heads = {f.removeprefix("=")[:4] for f in self.weights}
        self.lexicon = {f[1:].encode() for f in self.weights if f[0] == "=" and len(f) > 4}
        self.prefixes = {w[:k] for w in self.lexicon for k in range(1, len(w))}
        self.reach = self.prefixes | self.lexicon
        self.runs: dict[str, float] = {}
        self.whole = pa.array([f[1:] for f in self.weights if f[0] == "="], pa.string())
        self.stems = pa.array([f for f in self.weights if f[0] != "="], pa.string())

    def words(self, piece: str) -> list[str]:
        """The words a piece says: its letters as written, and as restored where they look disguised.

        A run of single characters with white space between is a piece too: it is restored with its white space in
        the lattice, and also read with all of it closed up.
        """
        low = piece.lower()
        letters = low.strip(OUTSIDE)
        if letters.isalpha():
            said = WORD_BREAK.split(self.restorer.restore(letters)) + [letters][: len(letters) > 3] if TWICE.search(letters) else [letters]
            return [w for w in dict.fromkeys(said) if w]
        if SPACE.search(low):
            said = WORD_BREAK.split(self.restorer.restore(low)) + self.words(SPACE.sub("", low))
            return [w for w in dict.fromkeys(said) if w]
        bare, said, suspect = self.plainly(piece)
        if suspect:
            restored = self.restorer.restore(low)
            if bare not in ("", low):
                restored += " " + self.restorer.restore(bare)
            said = WORD_BREAK.split(restored) + [w for w in said if len(w) > 3]
        return [w for w in dict.fromkeys(said) if w]

    @staticmethod
    def plainly(piece: str) -> tuple[str, list[str], bool]:
        """The core of a piece that isn't letters alone, its words as written, and whether it looks disguised."""
        bare = core(piece)
        return bare, [bare] if bare.isalpha() else WORD_BREAK.split(bare), SUSPECT.search(piece.lower().strip(CLOSING)) is not None

    def readings(self, piece: str, bare: str) -> set[str] | None:
        """All words that :meth:`words` may restore from a disguised piece; None where they are too many."""
        low = piece.lower()
        whole = self.restorer.readings(low)
        part = set() if bare in ("", low) else self.restorer.readings(bare)
        return None if whole is None or part is None else whole | part

    def words_among(self, piece: str, among: Container[str]) -> list[str]:
        """:meth:`words`, or the word as written where that has the same features ``among``.

        Restoring letters alone only shortens runs. Where no word with shorter runs has a feature ``among`` that the
        word as written hasn't, the lattice needn't be asked; nor where no word that a disguised piece may be read as has one.
        """
        letters = piece.lower().strip(OUTSIDE)
        if len(letters) > 3 and letters.isalpha() and TWICE.search(letters):
            runs = [(m[1], m[1] * 2) if m[0] != m[1] else (m[1],) for m in RUN.finditer(letters)]
            own = set(features(letters))
            if sum(len(r) > 1 for r in runs) <= 5 and not any(f not in own and f in among for f in {f for w in map("".join, product(*runs)) for f in features(w)}):
                return [letters]
        elif letters and not letters.isalpha() and not SPACE.search(piece):
            bare, said, suspect = self.plainly(piece)
            if suspect:
                said = [w for w in said if len(w) > 3]
                may, own = self.readings(piece, bare), {f for w in said for f in features(w)}
                if may is not None and not any(f not in own and f in among for w in may for f in features(w)):
                    return said
        return self.words(piece)

    def gathered(self, text: str) -> dict[str, float]:
        """Words of weight that stand in several neighbouring pieces, as ``clo wn`` or ``tr as h``, in any grouping, with their weights.

        Pieces without their signs are followed while, closed up, they begin a known word. What ends as one is a run with
        white space in the lattice, where closing it up has to be likelier than words that end at its spaces.
        """
        pieces = text.lower().encode("utf-8", "replace").translate(None, SIGNS).split()
        out: dict[str, float] = {}
        for i in compress(range(len(pieces) - 1), map(self.reach.__contains__, map(add, pieces, islice(pieces, 1, None)))):
            joined, j = pieces[i], i + 1
            while joined in self.prefixes and j < len(pieces):
                joined, j = joined + pieces[j], j + 1
                if joined in self.lexicon:
                    weight = self.run_weight(b" ".join(pieces[i:j]).decode())
                    if weight:
                        out[joined.decode()] = weight
        return out

    def run_weight(self, run: str) -> float:
        """The largest weight of what pieces with white space between say, remembered for a bounded number of them."""
        out = self.runs.get(run)
        if out is None:
            out = max(map(self.word_weight, WORD_BREAK.split(self.restorer.restore(run, WIDE))), default=0.0)
            if len(self.runs) >= self.MEMO_RUNS:
                self.runs.clear()
            self.runs[run] = out
        return out

    def word_weight(self, word: str) -> float:
        """The largest weight of a word's :func:`features`; most words begin like none that carries weight."""
        head, n = word[:4], len(word)
        if n < 3 or head not in self.heads:
            return 0.0
        get = self.weights.get
        out = get("=" + word, 0.0)
        if n > 4:
            out = max(out, get(head, 0.0), get(word[:5], 0.0) if n > 5 else 0.0, get(word[:6], 0.0) if n > 6 else 0.0)
        return out

    def gains(self, word: str, first: int) -> bool:
        """Whether a word of letters may carry more with shorter runs, the first of which stands at ``first``."""
        if first > 2 and word[:4] not in self.heads:
            return False
        own = self.word_weight(word)
        if not TWICE.search(word, first + 1):
            return self.word_weight(word[:first] + word[first + 1 :]) > own
        runs = [(m[1], m[1] * 2) if m[0] != m[1] else (m[1],) for m in RUN.finditer(word)]
        if sum(len(r) > 1 for r in runs) > 5:
            return True
        return any(self.word_weight(w) > own for w in map("".join, product(*runs)))

    def weight(self, piece: str) -> float:
        """The largest weight of what a piece says.

        Restoring letters alone only shortens runs, and the word as written counts too; so the lattice is asked only
        where a word with shorter runs carries more.
        """
        letters = piece.lower().strip(OUTSIDE)
        twice = TWICE.search(letters)
        if letters.isalpha() and (not twice or (len(letters) > 3 and not self.gains(letters, twice.start()))):
            out = self.word_weight(letters)
        else:
            out = self.disguised_weight(piece, letters)
        if len(piece) <= self.MEMO_CHARS:
            if len(self.memo) >= self.MEMO_PIECES:
                self.memo.clear()
            self.memo[piece] = out
        return out

    def disguised_weight(self, piece: str, letters: str) -> float:
        """The largest weight of the :meth:`words` of a piece; the lattice is asked only where a word it may write carries any."""
        if letters and not letters.isalpha() and not SPACE.search(piece):
            bare, said, suspect = self.plainly(piece)
            may = self.readings(piece, bare) if suspect else set()
            if may is not None and not any(map(self.word_weight, may)):
                return max((self.word_weight(w) for w in said if not suspect or len(w) > 3), default=0.0)
        return max(map(self.word_weight, self.words(piece)), default=0.0)

    def measure(self, text: str) -> tuple[float, float, float, float]:
        """The largest weight, the sum of the four largest, the share of pieces that carry any, and the log of the distinct pieces."""
        top, four, share, distinct = self.measures(pa.array([text])).tolist()[0]
        return top, four, share, distinct

    def measures(self, texts: pa.Array) -> np.ndarray:
        """:meth:`measure` of every text, ``SLAB`` bytes of texts at a time: a slab's distinct pieces are weighed once."""
        texts = texts.fill_null("")
        slab = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // self.SLAB
        edges = [0, *(np.flatnonzero(np.diff(slab)) + 1).tolist(), len(texts)]
        return np.concatenate([self._measured(texts.slice(i, j - i)) for i, j in zip(edges, edges[1:], strict=False)]) if len(texts) else np.zeros((0, 4))

    def _measured(self, texts: pa.Array) -> np.ndarray:
        split = pc.utf8_split_whitespace(texts)
        bounds = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        said, code = coded.dictionary, coded.indices.to_numpy()
        row = np.repeat(np.arange(len(texts)), np.diff(bounds))
        full = pc.binary_length(said).to_numpy()[code] > 0
        row, code = row[full], code[full]
        pairs = np.sort(row * len(said) + code)
        met, distinct_code = np.divmod(pairs[np.diff(pairs, prepend=-1) > 0], max(1, len(said)))
        weights = np.zeros(len(said))
        may = np.flatnonzero(self.may_carry(said).to_numpy(zero_copy_only=False))
        weights[may] = [self.weight(p) if (w := self.memo.get(p)) is None else w for p in said.take(may).to_pylist()]
        carried: list[dict[str, float]] = [{} for _ in range(len(texts))]
        heavy = weights[distinct_code] > 0
        for i, piece, w in zip(met[heavy].tolist(), said.take(distinct_code[heavy]).to_pylist(), weights[distinct_code[heavy]].tolist(), strict=True):
            carried[i][piece] = w
        hits = np.bincount(row[weights[code] > 0], minlength=len(texts)).tolist()
        sizes, kinds = np.bincount(row, minlength=len(texts)).tolist(), np.bincount(met, minlength=len(texts)).tolist()
        short = np.flatnonzero(pc.less(pc.utf8_length(said), 6).to_numpy(zero_copy_only=False))
        single = np.zeros(len(said), bool)
        single[short] = [is_single(p) for p in said.take(short).to_pylist()]
        flag = single[code]
        in_row = flag[2:] & flag[1:-1] & flag[:-2] & (row[2:] == row[:-2])
        runs = set(row[2:][in_row].tolist())
        out = np.zeros((len(texts), 4))
        for i, text in enumerate(texts.to_pylist()):
            mine = carried[i]
            for run in [m[0].strip() for m in SPACED.finditer(text)] if i in runs else ():
                w = self.weight(run) if (w := self.memo.get(run)) is None else w
                if w:
                    mine[run] = w
            for word, w in self.gathered(text).items():
                if word not in mine:
                    hits[i] += text.split().count(word)
                mine[word] = max(w, mine.get(word, 0.0))
            top = sorted(mine.values(), reverse=True)[:4]
            n = hits[i] or 1 if mine else 0
            out[i] = (top[0] if top else 0.0, sum(top), math.log1p(100 * n / (sizes[i] + 20)), math.log1p(kinds[i]))
        return out

    def may_carry(self, pieces: pa.Array) -> pa.Array:
        """Pieces whose weight isn't known to be 0: those that aren't Latin letters between signs, have a letter twice, or a word or beginning of weight."""
        bare = pc.utf8_trim(pieces, characters=OUTSIDE)
        letters = pc.utf8_lower(bare)
        odd = pc.or_(pc.invert(pc.match_substring_regex(bare, "^[A-Za-zÀ-ÖØ-öø-ÿ]+$")), pc.match_substring_regex(letters, DOUBLED))
        begins = [pc.is_in(pc.utf8_slice_codeunits(letters, 0, k), self.stems) for k in (4, 5, 6)]
        return pc.or_(odd, pc.or_(pc.is_in(letters, self.whole), pc.or_(begins[0], pc.or_(begins[1], begins[2]))))

    def scores(self, texts: pa.Array | Iterable[str | None]) -> np.ndarray:
        return self.calibration(bent(self.measures(texts if isinstance(texts, pa.Array) else pa.array(list(texts), pa.string()))))


def bent(x: np.ndarray) -> np.ndarray:
    """The calibration's columns from measures: largest weight, sum of four, share, log of the distinct pieces."""
    top, four, share, distinct = x.T
    return np.stack([top, np.maximum(0, top - 3), np.maximum(0, top - 4), four, share, distinct, np.minimum(top, 3) * distinct], 1)


def log_odds(counts: list[Counter[str]], totals: list[int], least: float) -> dict[str, float]:
    """Features with their log odds for the toxic class, where these are large and, times the count, more than chance among many features."""
    out = {}
    for f, toxic in counts[1].items():
        if toxic >= LEAST_ROWS:
            odds = math.log((toxic + 0.1) / (totals[1] + 1)) - math.log((counts[0].get(f, 0) + 0.5) / (totals[0] + 1))
            if odds >= least and toxic * odds >= 6:
                out[f] = min(odds, 6.0)
    return out


def is_single(piece: str) -> bool:
    """Whether a piece is a single character, signs beside it or not."""
    return len(piece) < 6 and (len(piece) < 2 or not piece.isalnum()) and SINGLE_PIECE.fullmatch(piece) is not None


def spaced(text: str, pieces: list[str], distinct: set[str]) -> list[str]:
    """Runs of single characters with white space between; the text is searched only where three such pieces follow one another."""
    single = set(filter(is_single, distinct))
    if not single or b"\1\1\1" not in bytes(map(single.__contains__, pieces)):
        return []
    return [m[0].strip() for m in SPACED.finditer(text)]


#: Counts that a task holds before it passes them on.
HELD_COUNTS = 300_000


def _passed_on(counts: Counter[str], name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=[name, "n"])


#: Bits of a table of marks.
MARKS = 1 << 24


class Marks:
    """Features by the bits of their hashes: none that was marked is missing, few others are in it, and its size is fixed."""

    def __init__(self, words: Iterable[tuple[int, int]]) -> None:
        bits = np.zeros(MARKS // 32, np.uint32)
        for at, held in words:
            bits[at] = held
        self.bits = bits.tobytes()

    def __contains__(self, feature: str) -> bool:
        h = zlib.crc32(feature.encode("utf-8", "replace")) % MARKS
        return self.bits[h >> 3] >> (h & 7) & 1 == 1


def _character_model(rows: DataFrame) -> CharacterModel:
    """Trigrams of all rows' words, counted by tasks and summed; as many rows reach the driver as there are trigrams."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        for batch in batches:
            pieces: Counter[str] = Counter()
            for t in batch.column(0):
                pieces.update(t.as_py().split())
            for piece, n in pieces.items():
                word = core(piece)
                if word.isalpha() and not THRICE.search(word):
                    words[word] += n
            if len(words) > HELD_COUNTS:
                yield _passed_on(trigrams(words), "gram")
                words.clear()
        if words:
            yield _passed_on(trigrams(words), "gram")

    grams = rows.select("_t").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return CharacterModel.of(Counter({r["gram"]: r["n"] for r in grams.toLocalIterator()}))


def _features(rows: DataFrame, restorer: Restorer, among: Marks | None) -> DataFrame:
    """(f, n0, n1, ...): rows of each quarter that hold a feature, counted by tasks and summed."""
    bare = ToxicityModel.of(restorer, {})

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quarters: deque[int] = deque()
        counts: defaultdict[int, Counter[str]] = defaultdict(Counter)

        def texts() -> Iterator[str]:
            for batch in batches:
                for q, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    quarters.append(q)
                    yield t.as_py()

        def passed_on() -> Iterator[pa.RecordBatch]:
            for q, mine in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(mine), pa.string()), pa.array([q] * len(mine), pa.int64()), pa.array(list(mine.values()), pa.int64())], names=["f", "q", "n"])
            counts.clear()

        for found in bare.row_features(texts(), among):
            counts[quarters.popleft()].update(found)
            if sum(map(len, counts.values())) > HELD_COUNTS:
                yield from passed_on()
        yield from passed_on()

    found = rows.select("_q", "_t").mapInArrow(count, "f string, q long, n long")
    return found.groupBy("f").agg(*[F.sum(F.when(F.col("q") == q, F.col("n")).otherwise(0)).alias(f"n{q}") for q in range(ToxicityModel.QUARTERS)])


def _marks(found: DataFrame) -> Marks:
    hashed = found.select(F.pmod(F.crc32(F.col("f").cast("binary")), F.lit(MARKS)).alias("h"))
    words = hashed.groupBy((F.col("h") / 32).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 32 as int))")).alias("held"))
    return Marks((r["at"], r["held"]) for r in words.toLocalIterator())


#: Of ``TURNS`` parts of the rows that aren't toxic, those that are counted before features are left out.
TURNS, FIRST = 5, 2


def _fits(rows: DataFrame, restorer: Restorer, totals: list[list[int]], keep: Callable[[DataFrame, str], DataFrame]) -> list[dict[str, float]]:
    """Weights without each quarter, and of all rows: features are counted by tasks and summed, and only what gets a weight is collected.

    A feature needs two toxic rows to carry weight, so those of toxic rows are marked first, and only they are counted in
    the other rows. Their odds only fall as more of these are counted; so after a part of them, features that can't
    carry weight in any fit any more are left out, and the rest is searched for those that still can.
    """
    quarters = range(ToxicityModel.QUARTERS)
    names = [f"n{q}" for q in quarters]

    def beside(toxic: DataFrame, others: DataFrame) -> DataFrame:
        """(f, t0, ..., n0, ...): features that carry weight in a fit if ``others`` are all rows that aren't toxic."""
        met = toxic.join(others, "f", "left").na.fill(0, names)
        heavy = F.lit(False)
        for left in (*quarters, None):
            have = [sum(t for q, t in enumerate(totals[y]) if q != left) for y in (0, 1)]
            sums = [sum((F.col(f"{c}{q}") for q in quarters if q != left), F.lit(0)) for c in "nt"]
            odds = F.log((sums[1] + 0.1) / F.lit(have[1] + 1.0)) - F.log((sums[0] + 0.5) / F.lit(have[0] + 1.0))
            # A hair below the line, which log_odds draws.
            heavy |= (sums[1] >= LEAST_ROWS) & (odds >= ToxicityModel.LEAST - 1e-9) & (sums[1] * odds >= 6 - 1e-9)
        return met.where(heavy)

    toxic = _features(rows.where("_y = 1"), restorer, None).where(sum(map(F.col, names), F.lit(0)) >= LEAST_ROWS)
    toxic = keep(toxic.select("f", *[F.col(f"n{q}").alias(f"t{q}") for q in quarters]), "toxic-features")
    civil = rows.where("_y = 0")
    first = keep(_features(civil.where(F.col("_s") < FIRST), restorer, _marks(toxic)), "civil-features")
    still = keep(beside(toxic, first).drop(*names), "open-features")
    rest = _features(civil.where(F.col("_s") >= FIRST), restorer, _marks(still))
    counted = beside(still, first.unionAll(rest).groupBy("f").agg(*[F.sum(n).alias(n) for n in names])).collect()
    out = []
    for left in (*quarters, None):
        mine = [Counter({r["f"]: sum(r[f"{c}{q}"] for q in quarters if q != left) for r in counted}) for c in "nt"]
        out.append(log_odds(mine, [sum(t for q, t in enumerate(totals[y]) if q != left) for y in (0, 1)], ToxicityModel.LEAST))
    return out


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text") -> ToxicityModel:
    """A model from all labelled training rows that are in ``docs``: those whose fold isn't 1.

    Tasks count trigrams and features, measure each row with the weights of the other quarters, and add up what a step
    of the calibration needs; sums, the trigrams and the features that carry weight are all that reaches the driver.
    """
    known = labelled_texts(docs, labels, "toxic", fold(key, FOLDS) != HELD, key=key, text=text)
    h = F.pmod(F.xxhash64("_k"), F.lit(ToxicityModel.QUARTERS * TURNS))
    drawn = known.select("_y", (h % ToxicityModel.QUARTERS).alias("_q"), F.floor(h / ToxicityModel.QUARTERS).alias("_s"), "_t")
    with scratch.workspace() as keep:
        rows = keep(drawn, "toxic-rows")
        totals = [[0] * ToxicityModel.QUARTERS for _ in (0, 1)]
        for r in rows.groupBy("_y", "_q").count().collect():
            totals[r["_y"]][r["_q"]] = r["count"]
        restorer = Restorer(_character_model(rows))
        *parts, whole = _fits(rows, restorer, totals, keep)

        def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models = [ToxicityModel.of(restorer, weights) for weights in parts]
            for batch in batches:
                for q, model in enumerate(models):
                    mine = batch.filter(pc.equal(batch.column(1), q))
                    yield pa.RecordBatch.from_arrays([mine.column(0), pa.array(model.measures(mine.column(2)).tolist(), pa.list_(pa.float64()))], names=["y", "x"])

        measures = keep(rows.select("_y", "_q", "_t").mapInArrow(measured, "y long, x array<double>"), "toxic-measures")
        return ToxicityModel.of(restorer, whole, Logistic.over(measures, bent, 7))


def score(docs: DataFrame, model: ToxicityModel, *, threshold: float = 0.7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted for every row.

    Null text counts as empty and is scored like an empty text. Without any labelled rows every score is 0.5.
    Repeated rows each get a row, an empty table none; other columns are ignored. A map without a shuffle: a
    worker holds one Arrow batch, the model and its bounded memory of pieces.
    """
    kind = docs.schema[key].dataType.simpleString()

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=[key, "held_out", "score", "predicted"])

    rows = docs.select(F.col(key), (fold(key, FOLDS) == HELD).alias("held_out"), F.col(text).alias("_text"))
    return rows.mapInArrow(judge, f"`{key}` {kind}, held_out boolean, score double, predicted int")


def keep_civil(docs: DataFrame, model: ToxicityModel, *, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with all their columns, whatever their names.

    Null text is judged as empty text, whole texts however long. Repeated rows are judged alike and all stay or go;
    a score equal to the threshold rejects. An empty table gives an empty result. A map without a shuffle.
    """

    def sift(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(batch.column(batch.schema.names.index(text)))
            yield batch.filter(pa.array(scores < threshold))

    return docs.mapInArrow(sift, docs.schema)
