"""Web pages as sequences of leaf blocks: text runs between block-level tags, with the path of elements around them."""

from __future__ import annotations

import re
from html import unescape

#: Fixed values of the HTML standard: elements whose start or end separates blocks, those without content, those whose content is no markup, and those never shown.
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe input label "
    "legend li main menu nav object ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul video".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript template xmp noembed noframes svg math".split())
HIDDEN = RAW - {"textarea"}
FOREIGN = {"svg", "math"}
#: Elements that end when the named ones begin, looked for up to the nearest of the bounds.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>|[^>]*+\Z)""", re.S)
NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Block:
    """The text of a leaf block, the characters of it that stand in links, and the number of its path."""

    __slots__ = ("links", "path", "text")

    def __init__(self, text: str, links: int, path: int) -> None:
        self.text, self.links, self.path = text, links, path


class Paths:
    """Numbers for paths of elements: each is its parent's number and a label, the element's name with its class, id and role."""

    def __init__(self) -> None:
        self.of: dict[tuple[int, str], int] = {}
        self.parent, self.label = [-1], [""]

    def child(self, parent: int, label: str) -> int:
        key = (parent, label)
        if key not in self.of:
            self.of[key] = len(self.label)
            self.parent.append(parent)
            self.label.append(label)
        return self.of[key]


def blocks(html: str, paths: Paths) -> list[Block]:
    """The leaf blocks of a page in order, without empty ones.

    Inline tags and comments are taken out of a block's text; a line break counts as white space; scripts, styles and other
    content that isn't shown are dropped. Character references are decoded and white space becomes one space. Elements
    that aren't closed end with their parent, as do paragraphs where another block begins.
    """
    out: list[Block] = []
    stack: list[tuple[str, int]] = []
    opened: dict[str, int] = {}
    parts: list[str] = []
    links, in_link, path, at = 0, 0, 0, 0

    def end_block() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, min(links, len(text)), path))
            parts.clear()
        links = 0

    def said(text: str) -> None:
        nonlocal links
        if text:
            text = unescape(text) if "&" in text else text
            parts.append(text)
            if in_link:
                links += len(text)

    def pop_to(name: str) -> None:
        nonlocal path
        while True:
            top, path = stack.pop()
            opened[top] -= 1
            if top == name:
                return

    low = None
    found = TOKEN.search(html)
    while found:
        said(html[at : found.start()])
        at = found.end()
        name = found[2]
        if name:
            name = name.lower()
            if found[1]:
                if name in BLOCK:
                    end_block()
                    if opened.get(name):
                        pop_to(name)
                elif name == "a":
                    in_link = 0
            elif name == "br":
                parts.append(" ")
            elif name in RAW and not (name in FOREIGN and found[3].endswith("/>")):
                low = html.lower() if low is None else low
                close = low.find(f"</{name}", at)
                inside, at = (html[at:], len(html)) if close < 0 else (html[at:close], close)
                if name not in HIDDEN:
                    end_block()
                    parts.append(unescape(inside))
                    old, path = path, paths.child(path, name)
                    end_block()
                    path = old
            elif name in BLOCK:
                end_block()
                if opened.get("p") and name not in ("button", "label", "input", "object", "video", "iframe"):
                    pop_to("p")
                if name in IMPLIED:
                    ends, bounds = IMPLIED[name]
                    for other, _ in reversed(stack):
                        if other in bounds:
                            break
                        if other in ends:
                            pop_to(other)
                            break
                if name not in VOID:
                    words = " ".join(a or b or c for a, b, c in NAMES.findall(found[3])) if "=" in found[3] else ""
                    stack.append((name, path))
                    opened[name] = opened.get(name, 0) + 1
                    path = paths.child(path, f"{name} {words}" if words else name)
                    if name in ("nav", "article", "section", "div", "p", "li"):
                        in_link = 0
            elif name == "a":
                in_link = 1
        found = TOKEN.search(html, at)
    said(html[at:])
    end_block()
    return out
