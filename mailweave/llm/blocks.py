"""HTML pages as sequences of leaf blocks: tag path, text, and vectors of both."""

from __future__ import annotations

import html
import re
import zlib

import numpy as np

PATH_SIZE = 512
WORD_SIZE = 64
NUMBERS = 7

_TOKEN = re.compile(
    r"<!---?>|<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?/](?![a-zA-Z])[^>]*+>?+|<!(?=[a-zA-Z])[^>]*+>?+"
    r"|<(?P<raw>script|style|noscript|textarea|iframe|title)(?=[\s/>]|$)(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|$)|'[^']*+(?:'|$))?+)*+(?:>|$).*?(?:</(?P=raw)(?=[\s/>]|$)[^>]*+(?:>|$)|$)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|$)|'[^']*+(?:'|$))?+)*+)(?:>|$)|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: A start tag ends an open element of these kinds, up to the nearest of the boxes.
_PEERS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
#: Elements without text of the page, left out with all they hold; what may hold HTML in an svg; and start tags that end an open svg.
_DROPPED = frozenset("svg object template".split())
_HTML_IN_SVG = frozenset("foreignobject desc".split())
_ENDS_SVG = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
_WORDS = re.compile(r"[a-z]+")


def _bucket(token: str, size: int) -> int:
    return zlib.crc32(token.encode()) % size


def names_of(attrs: str) -> list[str]:
    """Words of class, id and role, singular."""
    out = []
    for m in _NAMES.finditer(attrs):
        out += [w.rstrip("s") or w for w in _WORDS.findall((m[1] or m[2] or m[3] or "").lower())]
    return out


class Paths:
    """Numbers of tag paths, and a hashed vector for each: the names on the way, and the innermost element's own."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.vectors: list[np.ndarray] = [np.zeros(PATH_SIZE, bool)]

    def step(self, parent: int, tag: str, names: tuple[str, ...]) -> int:
        key = parent, tag, names
        number = self.known.get(key)
        if number is None:
            vector = self.vectors[parent].copy()
            half = PATH_SIZE // 2
            vector[half:] = False
            for token in (tag, *(f".{n}" for n in names)):
                vector[_bucket(token, half)] = True
                vector[half + _bucket("=" + token, half)] = True
            number = self.known[key] = len(self.vectors)
            self.vectors.append(vector)
        return number


class Block:
    __slots__ = ("path", "tags", "text", "linked")

    def __init__(self, path: int, tags: tuple | None, text: str, linked: int):
        self.path, self.tags, self.text, self.linked = path, tags, text, linked


def blocks_of(page: str | None, paths: Paths, with_tags: bool = False) -> list[Block]:
    """Leaf blocks in page order. Inline tags don't end a block, ``br`` is white space in it; scripts, styles and the like hold none."""
    out: list[Block] = []
    stack: list[tuple[str, int, tuple]] = [("", 0, ())]
    opened: dict[str, int] = {}
    parts: list[str] = []
    dropped: list[str] = []
    held: dict[str, int] = {}
    linked = anchor = 0

    def leave() -> str:
        name = dropped.pop()
        held[name] -= 1
        return name

    def flush():
        nonlocal linked, anchor
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(stack[-1][1], tuple(s[::2] for s in stack[1:]) if with_tags else None, text, linked))
            parts.clear()
        linked = anchor = 0

    def close(tag: str):
        while True:
            name = stack.pop()[0]
            opened[name] -= 1
            if name == tag:
                return

    for m in _TOKEN.finditer(page or ""):
        if m["text"] is not None:
            if dropped:
                continue
            parts.append(m["text"])
            if anchor:
                linked += len(m["text"])
        elif m["tag"]:
            tag = m["tag"].lower()
            if dropped:
                if m["end"]:
                    if held.get(tag):
                        while leave() != tag:
                            pass
                        continue
                    if not (opened.get(tag) and held.get("svg", 0) == len(dropped)):
                        continue
                    while dropped:
                        leave()
                elif dropped[-1] == "svg" and tag in _ENDS_SVG:
                    while dropped and dropped[-1] == "svg":
                        leave()
                    if dropped:
                        continue
            if (tag in _DROPPED or dropped and dropped[-1] == "svg" and tag in _HTML_IN_SVG) and not m["end"]:
                if not (m["attrs"].endswith("/") and (tag == "svg" or tag in _HTML_IN_SVG)):
                    dropped.append(tag)
                    held[tag] = held.get(tag, 0) + 1
                continue
            if dropped or tag in _DROPPED:
                continue
            if tag in _INLINE:
                if tag == "a":
                    anchor = 0 if m["end"] else 1
                continue
            if tag == "br":
                parts.append(" ")
                continue
            flush()
            if m["end"]:
                if opened.get(tag):
                    close(tag)
                continue
            if tag in _CLOSES_P and opened.get("p") and stack[-1][0] == "p":
                close("p")
            if tag in _PEERS:
                peers, boxes = _PEERS[tag]
                for i in range(len(stack) - 1, max(0, len(stack) - 6), -1):
                    if stack[i][0] in boxes:
                        break
                    if stack[i][0] in peers:
                        while len(stack) > i:
                            opened[stack.pop()[0]] -= 1
                        break
            if tag not in _VOID:
                names = tuple(names_of(m["attrs"])) if m["attrs"] else ()
                stack.append((tag, paths.step(stack[-1][1], tag, names), names))
                opened[tag] = opened.get(tag, 0) + 1
    flush()
    return out


def numbers_of(blocks: list[Block]) -> np.ndarray:
    """For each block: hashed-word vector (normalised) and a few numbers."""
    out = np.zeros((len(blocks), WORD_SIZE + NUMBERS), np.float32)
    for i, b in enumerate(blocks):
        words = b.text.lower().split()
        hashed = np.fromiter((zlib.crc32(w.encode()) % WORD_SIZE for w in words), np.int64, len(words))
        counts = np.bincount(hashed, minlength=WORD_SIZE)
        n = len(b.text)
        out[i, :WORD_SIZE] = counts / np.sqrt((counts * counts).sum())
        out[i, WORD_SIZE:] = np.log1p(n) / 8, np.log1p(len(words)) / 6, min(1.0, b.linked / n), b.text[-1] in ".!?…", i / len(blocks), 1 / (1 + i), 1 / (len(blocks) - i)
    return out
