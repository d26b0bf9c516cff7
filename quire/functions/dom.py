"""The CSS subset that rules use, over element trees of htmltree.

Type, #id, .class, [a], [a=v], [a="v"], :not(simple), :nth-child(an+b), :nth-of-type(an+b), :first-child, :last-child,
combined by descendant, >, + and ~, in lists with commas.
"""

from __future__ import annotations

import re

from .htmltree import VOID, Element, parse
from .memo import memo

__all__ = ["VOID", "Element", "SelectorError", "body_of", "compiled", "parse", "select", "select_first"]


class SelectorError(ValueError):
    """A selector outside the subset."""


def body_of(root: Element) -> Element:
    return next((e for e in root.walk() if e.name == "body"), root)


_SIMPLE = re.compile(r"""(?P<type>\*|[a-zA-Z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<raw>[^\]\s]+))\s*)?\]|:(?P<pseudo>[a-z-]+)(?:\((?P<arg>[^()]*)\))?""", re.X)


def _nth(arg: str):
    arg = arg.replace(" ", "").lower()
    arg = {"odd": "2n+1", "even": "2n"}.get(arg, arg)
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", arg)
    if not m:
        raise SelectorError(arg)
    if m[3]:
        return 0, int(m[3])
    return int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1]), int(m[2] or 0)


def _is_nth(k: int, a: int, b: int) -> bool:
    return k == b if a == 0 else (k - b) % a == 0 and (k - b) // a >= 0


def _test(part: re.Match):
    d = part.groupdict()
    if d["type"]:
        name = d["type"].lower()
        return lambda e: name == "*" or e.name == name
    if d["id"]:
        return lambda e: e.attrs.get("id") == d["id"]
    if d["cls"]:
        return lambda e: d["cls"] in e.attrs.get("class", "").split()
    if d["attr"]:
        name, op = d["attr"].lower(), d["op"]
        value = next((x for x in (d["dq"], d["sq"], d["raw"]) if x is not None), "")
        tests = {
            None: lambda v: True,
            "=": lambda v: v == value,
            "~=": lambda v: value in v.split(),
            "^=": lambda v: value != "" and v.startswith(value),
            "$=": lambda v: value != "" and v.endswith(value),
            "*=": lambda v: value != "" and value in v,
            "|=": lambda v: v == value or v.startswith(value + "-"),
        }
        return lambda e: name in e.attrs and tests[op](e.attrs[name])
    pseudo, arg = d["pseudo"], d["arg"]
    if pseudo == "not" and arg:
        inner = [_compound(x.strip()) for x in arg.split(",")]
        return lambda e: not any(t(e) for t in inner)
    if pseudo in ("first-child", "last-child", "nth-child", "nth-of-type", "first-of-type", "nth-last-child"):
        a, b = _nth(arg) if arg else (0, 1)
        typed, back = pseudo.endswith("of-type"), "last" in pseudo

        def nth(e: Element) -> bool:
            near = [x for x in (e.parent.elements() if e.parent else [e]) if not typed or x.name == e.name]
            k = next(i for i, x in enumerate(near) if x is e)
            return _is_nth(len(near) - k if back else k + 1, a, b)

        return nth
    raise SelectorError(f":{pseudo}")


def _compound(text: str):
    at, tests = 0, []
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if not m or m.end() == at:
            raise SelectorError(text)
        tests.append(_test(m))
        at = m.end()
    if not tests:
        raise SelectorError(text)
    return lambda e: all(t(e) for t in tests)


def _chain(text: str):
    """[(combinator before it, compound)] from left to right."""
    parts, depth, word, out = [], 0, "", []
    for c in text.strip() + " ":
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        if depth == 0 and (c.isspace() or c in ">+~"):
            if word:
                parts.append(word)
                word = ""
            if c in ">+~":
                parts.append(c)
        else:
            word += c
    how = " "
    for p in parts:
        if p in (">", "+", "~"):
            if how != " " or not out:
                raise SelectorError(text)
            how = p
        else:
            out.append((how, _compound(p)))
            how = " "
    if not out or how != " ":
        raise SelectorError(text)
    return out


@memo(1024)
def compiled(selector: str) -> tuple:
    """Chains of a selector list; raises SelectorError for what is outside the subset."""
    depth, start, lists = 0, 0, []
    for k, c in enumerate(selector):
        depth += (c in "([") - (c in ")]")
        if c == "," and depth == 0:
            lists.append(selector[start:k])
            start = k + 1
    lists.append(selector[start:])
    return tuple(tuple(_chain(x)) for x in lists)


def _matches(e: Element, chain: tuple, k: int) -> bool:
    how, test = chain[k]
    if not test(e):
        return False
    if k == 0:
        return True
    if how == " ":
        up = e.parent
        while up is not None:
            if up.name != "#root" and _matches(up, chain, k - 1):
                return True
            up = up.parent
        return False
    if how == ">":
        return e.parent is not None and e.parent.name != "#root" and _matches(e.parent, chain, k - 1)
    near = e.parent.elements() if e.parent else []
    k_own = next(i for i, x in enumerate(near) if x is e)
    before = near[:k_own][-1:] if how == "+" else near[:k_own]
    return any(_matches(x, chain, k - 1) for x in before)


def select(root: Element, selector: str) -> list[Element]:
    """Matching descendants in document order."""
    chains = compiled(selector)
    return [e for e in root.walk() if any(_matches(e, c, len(c) - 1) for c in chains)]


def select_first(root: Element, selector: str) -> Element | None:
    chains = compiled(selector)
    return next((e for e in root.walk() if any(_matches(e, c, len(c) - 1) for c in chains)), None)
