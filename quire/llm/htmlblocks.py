"""Leaf blocks of a page: the text between two block-level tags, with the open elements around it.

Tags are read by the states of the HTML standard, from left to right and each character a bounded number of times. What is
known of the open elements is shared between neighbours, so deep nesting costs no more than its tags.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable
from typing import NamedTuple

#: Elements that do not break a block.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Formulae stand in the line, with all that is in them.
INLINE |= set("math semantics annotation annotation-xml mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mlabeledtr mtd maction".split())
#: Elements without content.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
OPAQUE = set("script style noscript template textarea select option svg iframe object canvas head title video audio".split())
RAW = set("script style textarea title".split())
#: Start tags that can stand in a head; any other one, and text, ends an open head.
IN_HEAD = set("html head base basefont bgsound link meta noframes noscript script style template title".split())
#: A start tag of the key closes open elements of the value, up to the nearest container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = set("ul ol dl table tbody thead tfoot div section article main aside nav header footer form body".split())

#: What a start tag may close, up to the nearest container.
_CLOSABLE = {"p", *(x for closed in CLOSES.values() for x in closed)}
_NONE: frozenset[str] = frozenset()

_NAME = re.compile(r"[^\s/>]+")
_SPACE = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_READ = {"id", "class", "role", "itemprop", "aria-label", "hidden", "style"}
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_MARK = re.compile(r"[A-Za-z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


class Block(NamedTuple):
    """A leaf block: its text, the innermost open element, all open ones, the words of their ids and classes, and the share
    of the text in links."""

    text: str
    own: str
    names: frozenset[str]
    marks: frozenset[str]
    linked: float


class _Open:
    """An open element, with what holds for all that is in it."""

    __slots__ = ("name", "parent", "own", "names", "marks", "closable", "hidden", "anchors")

    def __init__(self, name: str, parent: _Open | None, marks: frozenset[str]):
        self.name, self.parent = name, parent
        up_names, up_marks, up_closable = (parent.names, parent.marks, parent.closable) if parent else (_NONE, _NONE, _NONE)
        self.own = (parent.own if parent else "") if name in INLINE else name
        self.names = up_names if name in INLINE or name in up_names else up_names | {name}
        self.marks = up_marks if marks <= up_marks else up_marks | marks
        self.closable = _NONE if name in HOLDS else up_closable if name not in _CLOSABLE or name in up_closable else up_closable | {name}
        self.hidden = (parent.hidden if parent else 0) + (name in OPAQUE)
        self.anchors = (parent.anchors if parent else 0) + (name == "a")


def _attributes(page: str, at: int, last_quote: dict[str, int]) -> tuple[list[tuple[str, str]], bool, int]:
    """(attributes that are read, whether the tag closes itself, place after its ">"), from the place after its name. A quote
    that is never closed counts as part of a bare value."""
    found, n = [], len(page)
    while True:
        gap = _SPACE.match(page, at).end()
        if gap >= n:
            return found, False, n
        if page[gap] == ">":
            return found, page[gap - 1] == "/", gap + 1
        end = _ATTRIBUTE.match(page, gap).end()
        name, value = page[gap:end].lower(), ""
        equals = _EQUALS.match(page, end)
        at = end
        if equals:
            at = equals.end()
            quote = page[at : at + 1]
            if quote in last_quote and last_quote[quote] > at:
                end = page.index(quote, at + 1)
                value, at = page[at + 1 : end], end + 1
            else:
                end = _BARE.match(page, at).end()
                value, at = page[at:end], end
        if name in _READ:
            found.append((name, value.lower()))


def _marks(attributes: list[tuple[str, str]], known: Callable[[str], bool] | None) -> frozenset[str]:
    """Words of the id, class and role of an element; 'hidden' for elements that are not shown."""
    out: list[str] = []
    for name, value in attributes:
        if name == "hidden" or name == "style" and _HIDES.search(value):
            out.append("hidden")
        elif name != "style":
            out += _MARK.findall(value)
    return frozenset(x for x in out if known is None or known(x))


def leaf_blocks(page: str, known: Callable[[str], bool] | None = None) -> list[Block]:
    """The leaf blocks in page order.

    Character references are decoded, white space becomes one space, empty blocks go. Unclosed and misnested tags are
    taken as browsers do in the main: an end tag closes up to its element if that is open, else it is ignored. A tag that
    the page's end cuts off is no text. known: marks that are of interest; with a bounded set of them the work is linear.
    """
    out: list[Block] = []
    parts: list[str] = []
    top: _Open | None = None
    opened: Counter[str] = Counter()
    linked, at, n = 0, 0, len(page)
    shared: frozenset[str] | None = None  # marks of all that the block's text stands in, inline elements too
    last_quote = {q: page.rfind(q) for q in "\"'"}
    last_end = page.rfind(">")

    def flush() -> None:
        nonlocal linked, shared
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, top.own if top else "", top.names if top else _NONE, shared or _NONE, min(1.0, linked / len(text))))
            parts.clear()
        linked, shared = 0, None

    def text(chunk: str) -> None:
        nonlocal linked, shared
        if top and top.name == "head" and chunk.strip():
            pop()
        if chunk and not (top and top.hidden):
            chunk = html.unescape(chunk)
            parts.append(chunk)
            if chunk.strip():
                own = top.marks if top else _NONE
                shared = own if shared is None else shared & own
            if top and top.anchors:
                linked += len(chunk)

    def pop() -> str:
        nonlocal top
        name, top = top.name, top.parent
        opened[name] -= 1
        return name

    while at < n:
        start = page.find("<", at)
        if start < 0:
            text(page[at:])
            break
        after = page[start + 1 : start + 3]
        closing = after[:1] == "/"
        letter = after[1:2] if closing else after[:1]
        if not (letter.isascii() and letter.isalpha()):
            if page.startswith("<!--", start):
                text(page[at:start])
                if page.startswith((">", "->"), start + 4):
                    end = page.index(">", start) - 2
                else:
                    end = page.find("-->", start + 4)
                at = n if end < 0 else end + 3
            elif after[:1] in ("!", "?") and after or closing and len(after) > 1:
                text(page[at:start])
                end = page.find(">", start) if start < last_end else -1
                at = n if end < 0 else end + 1
            else:
                text(page[at : start + 1])
                at = start + 1
            continue
        text(page[at:start])
        if start > last_end:
            break
        match = _NAME.match(page, start + 1 + closing)
        name = match[0].lower()
        attributes, itself, at = _attributes(page, match.end(), last_quote)
        if closing:
            if name == "p" and not opened["p"] or name == "br":
                flush()
            elif opened[name] > 0:
                if name not in INLINE and name not in OPAQUE:
                    flush()
                while pop() != name:
                    pass
            continue
        if name == "body" and opened["head"] > 0 or name not in IN_HEAD and top and top.name == "head":
            while pop() != "head":
                pass
        if name == "br":
            text(" ")
            continue
        if name in VOID or itself and name in OPAQUE:
            if name not in INLINE:
                flush()
            continue
        if name not in INLINE and name not in OPAQUE:
            flush()
            # a block ends an open paragraph; formatting that was left open inside it ends as well
            ends = CLOSES.get(name, _NONE) | {"p"}
            while top and not top.closable.isdisjoint(ends):
                pop()
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            at = page.find(">", end.end()) + 1 if end and end.end() <= last_end else n
            continue
        top = _Open(name, top, _marks(attributes, known) if attributes else _NONE)
        opened[name] += 1
    flush()
    return out
