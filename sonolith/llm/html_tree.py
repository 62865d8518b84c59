"""A page as a tree of block elements with their runs of text, from a forgiving tag reader."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass, field
from html import unescape

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template noscript svg math iframe object head title canvas audio video".split())
RAW = frozenset("script style title textarea iframe noscript".split())
#: A start tag ends these open elements, if none of the second kind stands between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Any other start tag ends an open head, and so does text.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>?", re.S)
_START = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
_NAME_END = re.compile(r"[\s/>]|\Z")
_ATTR = re.compile(r"(?<![^\s=/\"'>])([^\s=/\"'>]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++))")


#: Decimal character references too long for the decoder, which refuses numbers of over 4300 digits.
_LONG_REFERENCE = re.compile(r"&#(?=[0-9]{4000})0*+([0-9]*+);?")


def decode(text: str) -> str:
    """Character references decoded; a number beyond Unicode gives U+FFFD, however long it is."""
    return unescape(_LONG_REFERENCE.sub(lambda m: f"&#{m[1] or 0};" if len(m[1]) < 8 else "\ufffd", text))


@dataclass
class Node:
    """A block element, or (tag ``#text``) one run of inline text in it."""

    tag: str
    parent: int
    depth: int
    attrs: dict[str, str] = field(default_factory=dict)
    text: str = ""
    chars: int = 0
    linked: int = 0
    label: str | None = None


class _Ends:
    """Whether a start or end tag that begins at a position ends in the page: one pass from the right over ``>`` and quotes."""

    def __init__(self, html: str, begin: int) -> None:
        self.html = html
        self.at = [m.start() for m in re.finditer("[>\"']", html[begin:])]
        self.at = [begin + k for k in self.at]
        self.ends = bytearray(len(self.at) + 1)  # from here, outside quotes, a ``>`` outside quotes follows
        later = {'"': len(self.at), "'": len(self.at)}
        for k in range(len(self.at) - 1, -1, -1):
            c = html[self.at[k]]
            if c == ">":
                self.ends[k] = 1
            else:
                self.ends[k] = later[c] < len(self.at) and self.ends[later[c] + 1]
                later[c] = k
        self.name_end = -1

    def ending(self, start: int) -> bool:
        name = start + 2 + (self.html[start + 1] == "/")
        if self.name_end < name:  # starts are asked for in page order
            self.name_end = _NAME_END.search(self.html, name).start()
        return bool(self.ends[bisect_left(self.at, self.name_end)])


def _next_tags(html: str):
    """A function that gives the first tag at or after a position; the positions asked for must grow.

    A tag that never ends costs a scan to the end of the page, so after the first of them the
    others are looked up in :class:`_Ends`: the time is linear in the page, whatever it holds.
    """
    ends: _Ends | None = None

    def search(pos: int) -> re.Match | None:
        nonlocal ends
        while start := _START.search(html, pos):
            pos = start.start()
            if ends is None or html[pos + 1] in "!?" or ends.ending(pos):
                if m := _TAG.match(html, pos):
                    return m
                ends = ends or _Ends(html, pos)
            pos += 1
        return None

    return search


def _tags(html: str) -> tuple[list[re.Match], set[int]]:
    """All tags outside raw text, and the positions of the unseen elements' start tags that have an end tag."""
    search = _next_tags(html)
    tags: list[re.Match] = []
    open_: dict[str, list[int]] = {}
    ended: set[int] = set()
    pos = 0
    while m := search(pos):
        pos = m.end()
        tags.append(m)
        name = (m["name"] or "").lower()
        if name not in UNSEEN and name not in RAW:
            continue
        if m["end"]:
            if open_.get(name):
                ended.add(open_[name].pop())
        elif name not in UNSEEN or not (m["attrs"] or "").endswith("/"):
            open_.setdefault(name, []).append(m.start())
            if name in RAW:
                stop = re.compile(rf"</{name}\s*>", re.I).search(html, pos)
                pos = stop.start() if stop else len(html)
    return tags, ended


def parse(html: str) -> list[Node]:
    """Nodes in page order, the root first; text is decoded, its white space single spaces."""
    nodes = [Node("#root", -1, 0)]
    open_: list[tuple[str, int]] = [("#root", 0)]  # all open elements, and the block node they are in
    walls: list[int] = []  # unseen elements among them whose end tag comes: no start tag in them ends what is around them
    places: defaultdict[str, list[int]] = defaultdict(list)  # where the open elements of a name stand in open_
    unseen = 0
    run: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(run).split())
        if text:
            at = open_[-1][1]
            nodes.append(Node("#text", at, nodes[at].depth + 1, text=text, chars=len(text), linked=min(linked, len(text))))
        run.clear()
        linked = 0

    def close(down_to: int) -> None:
        nonlocal unseen
        if any(t not in INLINE for t, _ in open_[down_to:]):
            flush()
        for t, _ in open_[down_to:]:
            unseen -= t in UNSEEN
            places[t].pop()
        del open_[down_to:]
        while walls and walls[-1] >= down_to:
            walls.pop()

    def close_one_of(names: set[str], stop: set[str]) -> None:
        last = lambda ts: max((places[t][-1] for t in ts if places[t]), default=0)
        k = last(names)
        if k > (walls[-1] if walls else 0) and k > last(stop):
            close(k)

    tags, ended = _tags(html)
    pos = 0
    for i, m in enumerate([*tags, None]):
        chunk = html[pos : m.start() if m else len(html)]
        if unseen and open_[-1][0] == "head" and chunk.strip(" \t\n\f\r"):
            close(len(open_) - 1)
        if chunk and not unseen:
            run.append(decode(chunk))
            if places["a"]:
                linked += len(" ".join(chunk.split()))
        if not m:
            break
        pos = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["end"]:
            if places[name]:
                close(places[name][-1])
            elif name not in INLINE:
                flush()
            if name == "br":
                run.append(" ")
            continue
        if unseen and name not in IN_HEAD:
            close_one_of({"head"}, set())
        if name not in INLINE:
            if name in CLOSES:
                close_one_of(*CLOSES[name])
            if name not in UNSEEN:
                close_one_of({"p"}, {"table", "button", "td", "th", "div", "section", "article", "li", "blockquote"})
                flush()
        if name in VOID:
            if name == "br":
                run.append(" ")
            continue
        at = open_[-1][1]
        if name not in INLINE and name not in UNSEEN:
            attrs = {k.lower(): decode(a or b or c) for k, a, b, c in _ATTR.findall(m["attrs"] or "")}
            nodes.append(Node(name, at, nodes[at].depth + 1, attrs, label=attrs.get("y")))
            at = len(nodes) - 1
        if (m["attrs"] or "").endswith("/") and name in UNSEEN:
            continue
        places[name].append(len(open_))
        open_.append((name, at))
        unseen += name in UNSEEN
        if m.start() in ended and name != "head":
            walls.append(len(open_) - 1)
        if name in RAW:
            pos = tags[i + 1].start() if i + 1 < len(tags) else len(html)
    flush()
    for n in reversed(nodes[1:]):  # a parent stands before its children
        nodes[n.parent].chars += n.chars
        nodes[n.parent].linked += n.linked
    return nodes
