"""Recurrent block labeller: a bidirectional LSTM reads a page's leaf blocks and says which belong to its main text.

Each block comes as a vector of hashed tag-path tokens, hashed words and a few measures; the two directions give every
block the page before and behind it. The network is trained here, on pages of made-up layouts whose words come from a
bounded sample of the table, so it learns what elements, names and neighbours say and not one site's layout.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.html_blocks import Block, Paths, blocks
from panelyard.llm.shingles import words as hashed_words

#: Sizes of the parts of a block's vector and of the network's state.
PATH, LEAF, WORDS, MEASURES, STATE = 160, 48, 32, 10, 16
WIDTH = PATH + LEAF + WORDS + MEASURES
#: Bounds of the sample that lends its words: pages of at most so many bytes, the first so many by a hash of their key.
SAMPLE_PAGES, SAMPLE_BYTES = 200, 1 << 16
LAYOUTS, EPOCHS, BATCH, RATE = 700, 9, 25, 0.02
#: Bytes of pages that are read together, cells of a padded group, and paths that are remembered at most.
SLAB, CELLS, MOST_PATHS = 2 << 20, 1 << 15, 50_000
#: Bytes of text whose words are hashed together.
PIECE = 1 << 19
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _bag(tokens: Iterable[str], size: int) -> np.ndarray:
    out = np.zeros(size, np.float32)
    for t in tokens:
        out[zlib.crc32(t.lower().encode()) % size] = 1
    return out


def word_lots(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many words of each block hash to each of ``WORDS``; long blocks are cut at spaces and added up."""
    out = np.zeros((len(offsets) - 1, WORDS), np.int64)
    at = 0
    while at < len(out):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
        begin, end = int(offsets[at]), int(offsets[stop])
        while begin < end:
            cut = end if stop > at + 1 else min(end, begin + PIECE)
            while cut < end and data[cut - 1] != 32:
                cut += 1
            bounds = offsets[at : stop + 1] - begin if stop > at + 1 else np.array([0, cut - begin])
            hashes, row = hashed_words(data[begin:cut], bounds)
            out[at:stop] += np.bincount(row * WORDS + (hashes % np.uint64(WORDS)).astype(np.int64), minlength=(stop - at) * WORDS).reshape(-1, WORDS)
            begin = cut
        at = stop
    return out


class Vectors:
    """Vectors of blocks; a path's part is made once."""

    def __init__(self) -> None:
        self.paths = Paths()
        self.rows: list[np.ndarray] = [np.zeros(PATH + LEAF, np.float32)]

    def _path_rows(self) -> np.ndarray:
        p = self.paths
        for i in range(len(self.rows), len(p.label)):
            tokens = TOKEN.findall(p.label[i])
            above = self.rows[p.parent[i]]
            self.rows.append(np.concatenate([np.maximum(above[:PATH], _bag(tokens, PATH)), _bag(tokens, LEAF)]))
        return np.array(self.rows)

    def __call__(self, pages: list[list[Block]]) -> np.ndarray:
        """One row for each block of all pages, end to end."""
        flat = [b for page in pages for b in page]
        out = np.zeros((len(flat), WIDTH), np.float32)
        if not flat:
            return out
        out[:, : PATH + LEAF] = self._path_rows()[[b.path for b in flat]]
        texts = [b.text.encode() for b in flat]
        size = np.array([len(t) for t in texts])
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum(size)])
        lots = word_lots(data, offsets)
        counts = lots.sum(1)
        out[:, PATH + LEAF : PATH + LEAF + WORDS] = lots / np.maximum(1, np.sqrt((lots * lots).sum(1)))[:, None]
        chars = np.array([len(b.text) for b in flat])
        ends = np.array([t[-1] in b".!?:" for t in texts])
        sums = lambda mask: np.add.reduceat(mask.astype(np.int32), offsets[:-1])
        lengths = [len(p) for p in pages]
        order = np.concatenate([np.arange(n) for n in lengths])
        of = np.repeat(lengths, lengths)
        measures = [
            np.log1p(counts) / 3, np.log1p(chars) / 6, np.array([b.links for b in flat]) / chars, ends, sums((data == 46) | (data == 44)) / np.maximum(1, counts), sums((data >= 48) & (data < 58)) / chars,
            sums((data >= 65) & (data < 91)) / chars, order / of, np.log1p(of) / 5, counts > 12,
        ]
        out[:, -MEASURES:] = np.stack(measures, 1)
        return out

    def trim(self) -> None:
        """Forget all paths once they are many; blocks read before can't be given vectors any more."""
        if len(self.rows) > MOST_PATHS:
            self.__init__()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """A bidirectional LSTM with one output for each block; trained by Adam on padded groups of pages."""

    def __init__(self, seed: int = 1) -> None:
        r = np.random.default_rng(seed)
        draw = lambda *shape: (r.normal(size=shape) * np.sqrt(1 / shape[0])).astype(np.float32)
        self.w = {f"{k}{d}": draw(n, 4 * STATE) for d in "fb" for k, n in (("x", WIDTH), ("h", STATE))}
        for d in "fb":
            self.w["c" + d] = np.zeros(4 * STATE, np.float32)
            self.w["c" + d][STATE : 2 * STATE] = 1
        self.w |= {"o": draw(2 * STATE), "p": np.zeros(1, np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, kept: list | None) -> np.ndarray:
        steps, n = mask.shape
        z = x @ self.w["x" + d] + self.w["c" + d]
        h, c = np.zeros((n, STATE), np.float32), np.zeros((n, STATE), np.float32)
        out = np.zeros((steps, n, STATE), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            gates = z[t] + h @ self.w["h" + d]
            i, f, o = (_sigmoid(gates[:, k * STATE : (k + 1) * STATE]) for k in range(3))
            g = np.tanh(gates[:, 3 * STATE :])
            m = mask[t][:, None]
            new = f * c + i * g
            tanh = np.tanh(new)
            if kept is not None:
                kept.append((t, i, f, o, g, c, h, tanh, m))
            h, c = np.where(m, o * tanh, h), np.where(m, new, c)
            out[t] = h
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray, kept: dict[str, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        both = np.concatenate([self._run(x, mask, d, None if kept is None else kept.setdefault(d, [])) for d in "fb"], axis=2)
        return both @ self.w["o"] + self.w["p"], both

    def slopes(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Derivatives of the mean log loss over the blocks of one padded group."""
        kept: dict[str, list] = {}
        z, both = self.logits(x, mask, kept)
        dz = np.where(mask, _sigmoid(z) - y, 0) / mask.sum()
        out = {"o": np.tensordot(dz, both, 2), "p": dz.sum(keepdims=True)[0]}
        for d, half in (("f", self.w["o"][:STATE]), ("b", self.w["o"][STATE:])):
            wh = self.w["h" + d]
            dh, dc = np.zeros((x.shape[1], STATE), np.float32), np.zeros((x.shape[1], STATE), np.float32)
            dgates = np.zeros((*mask.shape, 4 * STATE), np.float32)
            dwh = np.zeros_like(wh)
            for t, i, f, o, g, c, h, tanh, m in reversed(kept[d]):
                dh = dh + dz[t][:, None] * half
                dnew = np.where(m, dc + dh * o * (1 - tanh * tanh), 0)
                dg = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), np.where(m, dh * tanh * o * (1 - o), 0), dnew * i * (1 - g * g)], axis=1)
                dgates[t] = dg
                dwh += h.T @ dg
                dh, dc = np.where(m, dg @ wh.T, dh), np.where(m, dnew * f, dc)
            out |= {"x" + d: np.tensordot(x, dgates, ([0, 1], [0, 1])), "h" + d: dwh, "c" + d: dgates.sum((0, 1))}
        return out

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 2) -> BlockLabeller:
        r = np.random.default_rng(seed)
        first, second, step = {k: np.zeros_like(v) for k, v in self.w.items()}, {k: np.zeros_like(v) for k, v in self.w.items()}, 0
        total = epochs * -(-len(pages) // BATCH)
        for _ in range(epochs):
            order = r.permutation(len(pages))
            for at in range(0, len(pages), BATCH):
                group = [pages[k] for k in order[at : at + BATCH]]
                x, mask = padded([v for v, _ in group])
                y = np.zeros(mask.shape, np.float32)
                for k, (_, labels) in enumerate(group):
                    y[: len(labels), k] = labels
                step += 1
                rate = RATE * (1 - step / (total + 1))
                for k, slope in self.slopes(x, mask, y).items():
                    first[k] += 0.1 * (slope - first[k])
                    second[k] += 0.01 * (slope * slope - second[k])
                    self.w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def chosen(self, vectors: np.ndarray, lengths: list[int]) -> np.ndarray:
        """Whether each block is main text; pages are padded with others of like length."""
        starts = np.concatenate([[0], np.cumsum(lengths)])
        out = np.zeros(len(vectors), bool)
        order = [k for k in np.argsort(lengths, kind="stable") if lengths[k]]
        while order:
            longest, n = lengths[order[-1]], 1
            while n < len(order) and (n + 1) * longest <= CELLS:
                n += 1
            group, order = order[-n:], order[:-n]
            z, _ = self.logits(*padded([vectors[starts[k] : starts[k + 1]] for k in group]))
            for at, k in enumerate(group):
                out[starts[k] : starts[k + 1]] = z[: lengths[k], at] > 0
        return out


def padded(group: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(steps, pages, width) with a mask of the cells that are blocks."""
    steps = max(1, max(map(len, group)))
    x, mask = np.zeros((steps, len(group), WIDTH), np.float32), np.zeros((steps, len(group)), bool)
    for k, v in enumerate(group):
        x[: len(v), k], mask[: len(v), k] = v, True
    return x, mask


#: What layouts are made of: names of containers of main text and of everything else, and what stands in the latter.
MAIN_NAMES = "content post entry article story main body text entry-content post-body article-body main-content post-content story-body article__text page-content blog-post news-text".split()
NEUTRAL = "wrapper container row col inner page site wrap box grid layout left center block section outer".split()
OTHER = {
    "nav": "nav navbar menu main-menu navigation topnav breadcrumb breadcrumbs pagination pager tabs toc".split(),
    "header": "header site-header masthead top topbar banner branding logo page-header".split(),
    "footer": "footer site-footer bottom copyright colophon legal credits".split(),
    "aside": "sidebar side aside widget related related-posts recommended more-stories popular trending tags author-box right-rail".split(),
    "ad": "ad ads advert advertisement sponsored promo promotion banner-ad adsbox sponsor".split(),
    "notice": "notice cookie cookie-notice consent gdpr alert message popup modal newsletter subscribe paywall".split(),
    "form": "form search search-form login signup newsletter-form contact-form".split(),
    "comments": "comments comment comment-list commentlist responses replies discussion disqus respond reviews".split(),
    "share": "share social sharing social-links buttons follow".split(),
}
PHRASES = {
    "nav": ["Home", "About us", "Contact", "News", "Archive", "Next page", "Previous", "Blog", "Shop", "Sitemap"],
    "header": ["Welcome to our site", "The daily journal", "Menu", "Log in", "Search"],
    "footer": ["© 2024 All rights reserved", "Privacy policy", "Terms of use", "Imprint", "Powered by"],
    "aside": ["Related articles", "Most read", "You may also like", "Tags", "About the author", "Recent posts"],
    "ad": ["Advertisement", "Sponsored", "Buy now", "Special offer", "Ad"],
    "notice": ["We use cookies to improve your experience.", "Accept", "Please subscribe to continue reading.", "This site uses cookies"],
    "form": ["Search", "Your email", "Send", "Name", "Sign up for our newsletter", "Password"],
    "comments": ["Leave a reply", "3 comments", "Reply", "says:", "Add a comment"],
    "share": ["Share", "Tweet", "Share this article", "Follow us", "Print"],
}
MARK = "\x01"


class Layouts:
    """Made-up pages; text that isn't main text begins with ``MARK``."""

    def __init__(self, vocabulary: list[str], seed: int = 3) -> None:
        self.r, self.vocabulary = random.Random(seed), vocabulary or ["word"]
        self.words = self.vocabulary

    def invented(self) -> list[str]:
        """Some words of a language of the page's own, so that layouts and not words are learnt."""
        r, signs = self.r, self.r.choice(["abcdefghijklmnopqrstuvwxyz", "aeioubdglmnrst", "абвгдежзийклмнопрсту", "0123456789ab", "的一是不了人我在有他", "àéîöüabcdef"])
        return ["".join(r.choices(signs, k=r.randint(1, 9))) for _ in range(60)]

    def said(self, low: int, high: int) -> str:
        words = self.r.choices(self.words, k=self.r.randint(low, high))
        kind = self.r.random()
        words = words[:1] * len(words) if kind < 0.03 else words
        return (" | " if 0.03 < kind < 0.06 else " ").join(words).capitalize() + self.r.choice([".", ".", "", "!", "?"])

    def other_text(self, kind: str, low: int = 1, high: int = 9) -> str:
        return MARK + (self.r.choice(PHRASES[kind]) if self.r.random() < 0.4 else self.said(low, high))

    def named(self, tag: str, names: list[str], share: float = 0.8) -> str:
        r = self.r
        if r.random() > share:
            return f"<{tag}>"
        name = r.choice(names) + r.choice(["", "", "", f"-{r.choice(NEUTRAL)}", f" {r.choice(NEUTRAL)}"])
        return f'<{tag} {r.choice(["class", "class", "id"])}="{name}">'

    def other(self, kind: str) -> str:
        """A piece of page that isn't main text."""
        r = self.r
        plain = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}
        tag = plain[kind] if kind in plain and r.random() < 0.6 else r.choice(["div", "div", "section", "ul" if kind == "nav" else "div"])
        begin = self.named(tag, OTHER[kind], 0.3 if tag == kind else 1.0)
        link = lambda: f'<a href="/{r.randint(1, 99)}">{self.other_text(kind, 1, 4)}</a>'
        if kind in ("nav", "share") or kind in ("aside", "footer") and r.random() < 0.5:
            items = [link() for _ in range(r.randint(2, 8))]
            inside = "".join(f"<li>{i}</li>" for i in items) if tag == "ul" else "<ul>" + "".join(f"<li>{i}" for i in items) + "</ul>" if r.random() < 0.7 else " | ".join(items)
        elif kind == "form":
            inside = f'<label>{self.other_text(kind)}</label><input type="text"><button>{self.other_text(kind, 1, 2)}</button>'
        elif kind == "comments":
            one = r.choice([("div", "div"), ("li", "ol"), ("article", "div")])
            inside = f"<h3>{self.other_text(kind)}</h3><{one[1]}>" + "".join(
                f'<{one[0]} class="comment">' + f"<p>{self.other_text(kind, 1, 3)}</p>" * r.randint(0, 1) + f"<p>{self.other_text(kind, 4, 60)}</p></{one[0]}>" for _ in range(r.randint(1, 6))
            ) + f"</{one[1]}>"
        else:
            inside = r.choice(["", "", f"<h3>{self.other_text(kind, 1, 4)}</h3>", f"<h1>{self.other_text(kind, 1, 4)}</h1>" if kind == "header" else ""])
            inside += "".join(r.choice(["{}", "<p>{}</p>", "<div>{}</div>"]).format(self.other_text(kind, 2, 30 if kind != "header" else 8)) for _ in range(r.randint(1, 3)))
        return f"{begin}{inside}</{tag}>"

    def paragraph(self) -> str:
        """A block of main text, in one of its many forms."""
        r = self.r
        text = self.said(1, r.choice([4, 12, 40, 90, 150, 150, 900]))
        kind = r.random()
        if kind < 0.08:
            line = self.said(1, 3)
            return "".join(f"<p>{r.choice([line, line, self.said(1, 3)])}</p>" for _ in range(r.randint(2, 14))) + f"<p>{self.said(1, 1)}</p>"
        if kind < 0.62:
            return f"<p>{text}</p>" if r.random() < 0.8 else f"<p>{text}"
        if kind < 0.72:
            return f"<p><b>{text}<br>"
        if kind < 0.78:
            return f"<h{r.randint(2, 4)}>{self.said(1, 8)}</h2>"
        if kind < 0.84:
            return "<ul>" + "".join(f"<li>{self.said(2, 20)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.88:
            return f"<blockquote><p>{text}</p></blockquote>"
        if kind < 0.91:
            return f"<figure><figcaption>{self.said(3, 12)}</figcaption></figure>"
        if kind < 0.94:
            return "<table>" + "".join(f"<tr><td>{self.said(1, 4)}<td>{self.said(1, 4)}" for _ in range(r.randint(1, 4))) + "</table>"
        if kind < 0.97:
            return f"<pre>{text}</pre>"
        return f'<div>{text} <a href="/x">{self.said(1, 3)}</a></div>'

    def page(self) -> str:
        r = self.r
        self.words = r.choices(self.vocabulary, k=150) if r.random() < 0.5 else self.invented()
        style = r.random()
        if style < 0.45:
            begin, end = self.named("article", MAIN_NAMES, 0.3), "</article>"
        elif style < 0.6:
            begin, end = self.named("main", MAIN_NAMES, 0.3), "</main>"
        elif style < 0.92:
            begin, end = self.named("div", MAIN_NAMES, 1.0), "</div>"
        else:
            begin = end = ""
        title = f"<h1>{self.said(1, 14)}</h1>"
        body = [r.choice([title, title, f"<header>{title}</header>" if style < 0.6 else title, ""])]
        for _ in range(r.choice([1, 2, 4, 8, 14, 25])):
            body.append(self.paragraph())
            if begin and r.random() < 0.06:
                body.append(self.other(r.choice(["ad", "share", "notice", "aside", "form"])))
        if begin and r.random() < 0.15:
            body.append(self.other(r.choice(["share", "comments", "aside"])))
        text = begin + "".join(body) + end if r.random() < 0.97 else ""
        before = [self.other(k) for k in r.sample(["nav", "header", "notice", "ad", "form", "aside", "nav", "ad"], r.randint(0, 4))]
        after = [self.other(k) for k in r.sample(["comments", "aside", "footer", "share", "ad", "nav", "form", "comments", "footer"], r.randint(0, 4))]
        whole = "".join(before) + text + "".join(after)
        for _ in range(r.choice([0, 0, 1, 2])):
            whole = self.named("div", NEUTRAL) + whole + "</div>"
        return "<html><head><title>x</title></head><body>" + whole + r.choice(["</body></html>", ""])


def labelled_layouts(vocabulary: list[str], n: int = LAYOUTS, seed: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """(vectors, labels) of ``n`` made-up pages."""
    made, vectors, pages = Layouts(vocabulary, seed), Vectors(), []
    for _ in range(n):
        found = blocks(made.page(), vectors.paths)
        labels = np.array([not b.text.startswith(MARK) for b in found], np.float32)
        for b in found:
            b.text = b.text.replace(MARK, "") or "x"
        pages.append((found, labels))
    flat, at, out = vectors([p for p, _ in pages]), 0, []
    for page, labels in pages:
        if page:
            out.append((flat[at : at + len(page)], labels))
        at += len(page)
    return out


def train(pages: DataFrame, *, key: str = "page_id", html: str = "html") -> BlockLabeller:
    """A labeller for ``pages``, trained on made-up layouts with words of at most ``SAMPLE_PAGES`` pages of at most ``SAMPLE_BYTES`` bytes.

    Tasks keep pages whose hash lies among the first few hundred's share, so what they send doesn't grow with their number.
    An empty table lends no words, and the layouts are then made of one; the labeller still reads elements and names.
    """
    span, key_hash = 1 << 40, F.xxhash64("k")
    below = span * 4 * SAMPLE_PAGES // max(4 * SAMPLE_PAGES, pages.count())
    near = pages.select(F.col(key).alias("k"), F.col(html).alias("html")).where((F.pmod(key_hash, F.lit(span)) < F.lit(below)) & (F.octet_length("html") <= SAMPLE_BYTES))
    some = near.orderBy(F.pmod(key_hash, F.lit(span)), F.xxhash64("html")).limit(SAMPLE_PAGES)
    words = {w for row in some.select("html").collect() for b in blocks(row["html"], Paths()) for w in b.text.split()}
    return BlockLabeller().fit(labelled_layouts(sorted(words)[:: max(1, len(words) // 20_000)]))


def main_texts(pages: list[str], labeller: BlockLabeller, vectors: Vectors) -> list[str]:
    """The main text of each page: its chosen blocks, joined by line ends."""
    found = [blocks(p, vectors.paths) for p in pages]
    lengths = [len(p) for p in found]
    chosen = labeller.chosen(vectors(found), lengths).tolist()
    out, at = [], 0
    for page, n in zip(found, lengths, strict=True):
        out.append("\n".join(b.text for b, c in zip(page, chosen[at : at + n], strict=True) if c))
        at += n
    vectors.trim()
    return out


def extract(pages: DataFrame, labeller: BlockLabeller, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row for each row of ``pages``: key, url, text, n_chars.

    The text is that of all blocks that the labeller takes for main text, whole and in page order, one a line. A null or
    empty page, and one without such blocks, has an empty text. Long pages are read whole, by themselves. Null keys and
    urls, and repeated rows, are given out as they came; an empty table gives an empty result. Other columns are ignored,
    whatever their names.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in (key, url)]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for batch in batches:
            group: list[str] = []
            size = first = 0
            for i, page in enumerate(batch.column(2)):
                group.append(page.as_py() or "")
                size += len(group[-1])
                if size >= SLAB or i == len(batch) - 1:
                    texts = main_texts(group, labeller, vectors)
                    columns = [batch.column(k).slice(first, len(group)) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[key, url, "text", "n_chars"])
                    group, size, first = [], 0, i + 1

    return pages.select(key, url, html).mapInArrow(read, f"`{key}` {kinds[0]}, `{url}` {kinds[1]}, text string, n_chars bigint")
