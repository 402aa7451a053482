"""Web pages as sequences of leaf blocks: the text between block tags, with the tags it stands in."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

#: Tags that end a block, tags without content, tags whose content isn't text.
BLOCK_TAGS = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = set("iframe math noembed noframes noscript object script style svg template textarea title xmp".split())
#: An open tag (value) that a new one (key) ends, unless a tag between them (after it) is open.
_CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)), "option": (("option",), ("select",))}

#: Buckets of hashed path tokens.
PATH_BUCKETS = 1024

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""\b(class|id|role|itemprop|data-y)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Leaf:
    """A block: its text, hashed tokens of the elements around it, of the innermost, and its share of linked characters."""

    text: str
    path: tuple[int, ...]
    inner: int
    linked: float
    tags: tuple[str, ...] = ()
    label: int | None = None


@lru_cache(1 << 14)
def _bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % PATH_BUCKETS


@lru_cache(1 << 12)
def _read(name: str, rest: str) -> tuple[tuple[int, ...], tuple[str, ...], str | None]:
    """A tag's hashed tokens, the words of its names, and its label, where training pages carry one."""
    words, label = [], None
    for key, value in _NAMED.findall(rest) if "=" in rest else ():
        value = value.strip("\"'")
        if key.lower() == "data-y":
            label = value
        else:
            words += [w.lower() for w in _WORD.findall(value)]
    tokens = {_bucket(name)} | {_bucket("." + w) for w in words} | {_bucket("." + w[:5] + "*") for w in words}
    return tuple(sorted(tokens)), tuple(words), label


@dataclass
class _Open:
    """The open elements, with the places of each tag and how often each path token stands in them."""

    names: list[str] = field(default_factory=list)
    read: list[tuple] = field(default_factory=list)
    places: dict[str, list[int]] = field(default_factory=dict)
    counts: dict[int, int] = field(default_factory=dict)
    words: dict[str, int] = field(default_factory=dict)
    labels: list[str] = field(default_factory=list)
    path: tuple[int, ...] | None = None

    def push(self, name: str, read: tuple) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.read.append(read)
        self._count(read, 1)
        if read[2] is not None:
            self.labels.append(read[2])

    def cut(self, at: int) -> None:
        """Closes all elements from this place on."""
        while len(self.names) > at:
            read = self.read.pop()
            self.places[self.names.pop()].pop()
            self._count(read, -1)
            if read[2] is not None:
                self.labels.pop()

    def _count(self, read: tuple, by: int) -> None:
        self.path = None
        for held, keys in ((self.counts, read[0]), (self.words, read[1])):
            for key in keys:
                n = held.get(key, 0) + by
                if n:
                    held[key] = n
                else:
                    del held[key]

    def last(self, names: tuple[str, ...]) -> int:
        return max((p[-1] for n in names if (p := self.places.get(n))), default=-1)

    def tokens(self) -> tuple[int, ...]:
        if self.path is None:
            self.path = tuple(sorted(self.counts))
        return self.path

    def tags(self) -> tuple[str, ...]:
        return (*(n for n, p in self.places.items() if p), *("." + w for w in self.words))


def leaf_blocks(html: str, tags: bool = False) -> list[Leaf]:
    """The blocks with text, in order; scripts, styles, comments and unfinished tags are passed over.

    White space becomes one space, character references are decoded. With `tags`, blocks also carry the
    names around them and their label.
    """
    out, held, linked, state, in_link, at, end = [], [], 0, _Open(), 0, 0, len(html)

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                inner = state.read[-1][0][0] if state.read else 0
                name = state.names[-1] if state.names else ""
                more = (state.tags(), int(state.labels[-1]) if state.labels else None) if tags else ()
                out.append(Leaf(text, state.tokens(), _bucket("^" + name) if name else inner, min(linked / len(text), 1.0), *more))
            held.clear()
        linked = 0

    while at < end:
        found = _TOKEN.search(html, at)
        piece = html[at : found.start() if found else end]
        if piece:
            piece = unescape(piece) if "&" in piece else piece
            held.append(piece)
            if in_link:
                linked += len(piece)
        if not found:
            break
        at = found.end()
        closing, name, rest = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if name is None:
            continue
        name = name.lower()
        if closing:
            if name in BLOCK_TAGS:
                flush()
                in_link = 0
                if place := state.places.get(name):
                    state.cut(place[-1])
            elif name == "a":
                in_link = 0
            continue
        if name in RAW_TAGS:
            if not rest.endswith("/"):
                stop = re.compile(f"</{re.escape(name)}(?=[\\s/>]|\\Z)", re.I).search(html, at)
                at = stop.start() if stop else end
            continue
        if name in BLOCK_TAGS:
            flush()
            in_link = 0
            if name != "option" and state.names and state.names[-1] == "p":
                state.cut(len(state.names) - 1)
            if name in _CLOSES:
                ended, within = _CLOSES[name]
                place = state.last(ended)
                if place > state.last(within):
                    state.cut(place)
            if name not in VOID_TAGS:
                state.push(name, _read(name, rest))
        elif name == "br":
            held.append(" ")
        elif name == "a":
            in_link = 1
    flush()
    return out
