"""Element trees of pages, built as the HTML standard says: implied html, head, body and table parts, content that a table can't
hold moved before it, formatting elements reopened and misnested ones put right.

Scripts count as enabled, so the content of noscript is text. A page is in quirks mode, where a table stays inside of an open
p, unless it begins with a doctype of html. Not built: framesets, templates as fragments of their own, names of foreign
elements in mixed case. Trees live inside a batch and never become columns.
"""

from __future__ import annotations

from collections import Counter
from html import escape, unescape
from html.parser import HTMLParser

#: Fixed values of the standard: elements without content, raw text, and the groups that its rules name.
VOID = set("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes noscript".split())
_TEXT = RAW | {"title", "textarea"}
_META = set("base basefont bgsound link meta title noframes script style noscript template".split())
_BLOCK = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul pre listing".split()
)
_HEADING = set("h1 h2 h3 h4 h5 h6".split())
_FORMATTING = set("a b big code em font i nobr s small strike strong tt u".split())
_MARKED = set("applet marquee object".split())
_SECTION = {"tbody", "thead", "tfoot"}
_CELL = {"td", "th"}
_TABLE_TAGS = {"caption", "col", "colgroup", "tr"} | _SECTION | _CELL
_FOSTERED = {"table", "tr"} | _SECTION
_IMPLIED_END = set("dd dt li optgroup option p rb rp rt rtc".split())
_SPECIAL = (
    (_BLOCK - {"dialog", "search"})
    | _HEADING
    | _MARKED
    | _TABLE_TAGS
    | (VOID - {"basefont", "bgsound"})
    | (RAW - {"noscript"})
    | set("basefont bgsound body button dd dt form frameset head html li noscript select table template textarea title plaintext".split())
)
_SCOPE = set("applet caption html table td th marquee object template".split())
_LIST_SCOPE, _BUTTON_SCOPE, _TABLE_SCOPE = _SCOPE | {"ol", "ul"}, _SCOPE | {"button"}, {"html", "table", "template"}
_SPACE = " \t\n\f\r"


class Element:
    __slots__ = ("name", "attrs", "children", "parent")

    def __init__(self, name: str, attrs: dict[str, str], parent: Element | None):
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    def elements(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]

    def walk(self):
        """Descendants in document order."""
        todo = list(reversed(self.elements()))
        while todo:
            e = todo.pop()
            yield e
            todo += reversed(e.elements())

    def text(self) -> str:
        out, todo = [], list(reversed(self.children))
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                out.append(c)
            else:
                todo += reversed(c.children)
        return "".join(out)

    def inner_html(self) -> str:
        out: list[str] = []
        todo: list = list(reversed(self.children))
        while todo:
            c = todo.pop()
            if isinstance(c, tuple):
                out.append(c[0])
            elif isinstance(c, str):
                out.append(escape(c, quote=False))
            else:
                out.append(f"<{c.name}{''.join(f' {k}="{escape(v)}"' for k, v in c.attrs.items())}>")
                if c.name not in VOID:
                    todo.append((f"</{c.name}>",))
                    todo += [(x,) if c.name in RAW and isinstance(x, str) else x for x in reversed(c.children)]
        return "".join(out)


def _place_in(siblings: list, e: Element) -> int:
    return next(k for k in range(len(siblings) - 1, -1, -1) if siblings[k] is e)


def _detach(e: Element) -> None:
    if e.parent is not None:
        del e.parent.children[_place_in(e.parent.children, e)]
        e.parent = None


def _attach(e: Element, to: Element, at: int | None = None) -> None:
    e.parent = to
    to.children.insert(len(to.children) if at is None else at, e)


class Builder(HTMLParser):
    """The stack of open elements and the list of formatting elements (None marks a border that no reopening crosses)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("#root", {}, None)
        self.open = [self.root]
        self.formatting: list[Element | None] = []
        self.html = self.head = self.body = self.form = None
        self.in_head, self.quirks, self.fostering, self.skip_newline = False, True, False, False
        self.count: Counter[str] = Counter()  # open elements by name, so that most searches of a deep stack end at once

    # --- the stack ---

    def _place(self, override: Element | None = None) -> tuple[Element, int | None]:
        """Where a node goes: the current element, or before the last table if that can't hold it."""
        target = override or self.open[-1]
        if self.fostering and target.name in _FOSTERED:
            table = next(e for e in reversed(self.open) if e.name == "table")
            return table.parent, _place_in(table.parent.children, table)
        return target, None

    def _insert(self, tag: str, attrs: dict[str, str]) -> Element:
        e = Element(tag, attrs, None)
        _attach(e, *self._place())
        if tag not in VOID:
            self.open.append(e)
            self.count[tag] += 1
            if tag in _TEXT:
                self.set_cdata_mode(tag)
        return e

    def _pop(self) -> None:
        self.count[self.open.pop().name] -= 1

    def _take_out(self, e: Element) -> None:
        del self.open[_place_in(self.open, e)]
        self.count[e.name] -= 1

    def _cut(self, k: int) -> None:
        while len(self.open) > k:
            self._pop()

    def _in_scope(self, names, border=_SCOPE) -> int:
        """Place on the stack of the innermost element of these names, 0 if a border lies before it."""
        if any(self.count[n] for n in names):
            for k in range(len(self.open) - 1, 0, -1):
                name = self.open[k].name
                if name in names:
                    return k
                if name in border:
                    break
        return 0

    def _imply_ends(self, but: str = "") -> None:
        while self.open[-1].name in _IMPLIED_END and self.open[-1].name != but:
            self._pop()

    def _close(self, names, border=_SCOPE) -> bool:
        k = self._in_scope(names, border)
        if k:
            self._cut(k)
        return k > 0

    def _close_p(self) -> None:
        self._close({"p"}, _BUTTON_SCOPE)

    def _context(self) -> str:
        """The innermost open element that rules of its own hold for: a part of a table or select, else body."""
        if self.count["table"] or self.count["select"]:
            for e in reversed(self.open):
                if e.name == "table" or e.name == "select" or e.name in _TABLE_TAGS:
                    return e.name
        return "body"

    # --- formatting elements ---

    def _last_formatting(self, tag: str) -> Element | None:
        for e in reversed(self.formatting):
            if e is None:
                return None
            if e.name == tag:
                return e
        return None

    def _push_formatting(self, e: Element) -> None:
        same = []
        for other in reversed(self.formatting):
            if other is None:
                break
            if other.name == e.name and other.attrs == e.attrs:
                same.append(other)
        if len(same) == 3:  # at most three equal ones are reopened
            self.formatting.remove(same[-1])
        self.formatting.append(e)

    def _reopen(self) -> None:
        k = len(self.formatting)
        while k and self.formatting[k - 1] is not None and self.formatting[k - 1] not in self.open:
            k -= 1
        for i in range(k, len(self.formatting)):
            e = self.formatting[i]
            self.formatting[i] = self._insert(e.name, dict(e.attrs))

    def _to_marker(self) -> None:
        while self.formatting and self.formatting.pop() is not None:
            pass

    def _end_formatting(self, tag: str) -> None:
        """The end of a formatting element: blocks that it began outside of get a copy of it inside."""
        if self.open[-1].name == tag and self.open[-1] not in self.formatting:
            self._pop()
            return
        for _ in range(8):
            own = self._last_formatting(tag)
            if own is None:
                self._end_other(tag)
                return
            if own not in self.open:
                self.formatting.remove(own)
                return
            k = self.open.index(own)
            if any(e.name in _SCOPE for e in self.open[k + 1 :]):
                return
            inner = next((i for i in range(k + 1, len(self.open)) if self.open[i].name in _SPECIAL), 0)
            if not inner:
                self._cut(k)
                self.formatting.remove(own)
                return
            block, above, mark = self.open[inner], self.open[k - 1], self.formatting.index(own)
            last, i, n = block, inner, 0
            while self.open[i - 1] is not own:
                i, n = i - 1, n + 1
                node = self.open[i]
                if node in self.formatting and n > 3:
                    mark -= self.formatting.index(node) < mark
                    self.formatting.remove(node)
                if node not in self.formatting:
                    self._take_out(node)
                    continue
                copy = Element(node.name, dict(node.attrs), None)
                at = self.formatting.index(node)
                self.formatting[at] = self.open[i] = copy
                if last is block:
                    mark = at + 1
                _detach(last)
                _attach(last, copy)
                last = copy
            _detach(last)
            _attach(last, *self._place(above))
            copy = Element(own.name, dict(own.attrs), None)
            copy.children, block.children = block.children, []
            for c in copy.children:
                if isinstance(c, Element):
                    c.parent = copy
            _attach(copy, block)
            at = self.formatting.index(own)
            del self.formatting[at]
            self.formatting.insert(mark - (at < mark), copy)
            self._take_out(own)
            self.open.insert(_place_in(self.open, block) + 1, copy)
            self.count[tag] += 1

    # --- html, head and body ---

    def _begin_html(self, attrs=None) -> None:
        if self.html is None:
            self.html = self._insert("html", attrs or {})

    def _begin_head(self, attrs=None) -> None:
        self._begin_html()
        if self.head is None:
            self.head, self.in_head = self._insert("head", attrs or {}), True

    def _begin_body(self, attrs=None) -> None:
        self._begin_head()
        if self.in_head:
            self._cut(2)
            self.in_head = False
        if self.body is None:
            self.body = self._insert("body", attrs or {})

    def handle_decl(self, decl):
        if self.html is None and decl.lower().split()[:2] == ["doctype", "html"]:
            self.quirks = False

    def handle_startendtag(self, tag, attrs):
        top = self.open[-1]
        self.handle_starttag(tag, attrs)
        if self.open[-1] is not top and self.open[-1].name == tag and (self.count["svg"] or self.count["math"]):
            self._pop()

    def handle_starttag(self, tag, attrs):
        self.skip_newline = False
        found: dict[str, str] = {}
        for k, v in attrs:
            found.setdefault(k, v or "")
        if tag == "html":
            self._begin_html(found)
            self.html.attrs = {**found, **self.html.attrs}
        elif self.body is None and tag == "head":
            self._begin_head(found)
        elif self.body is None and tag in _META:
            self._begin_head()
            if self.in_head:
                self._insert(tag, found)
            else:  # between head and body: into the head
                self.open.append(self.head)
                self._insert(tag, found)
                del self.open[_place_in(self.open, self.head)]
        elif tag == "body":
            self._begin_body(found)
            self.body.attrs = {**found, **self.body.attrs}
        elif tag != "head":
            self._begin_body()
            self._start(tag, found)

    def handle_endtag(self, tag):
        self.skip_newline = False
        if self.body is None:
            if self.open[-1].name == tag and tag in _META:
                self._pop()
            elif tag == "head" and self.in_head:
                self._cut(2)
                self.in_head = False
            elif tag in ("body", "html", "br"):
                self._begin_body()
                if tag == "br":
                    self._start("br", {})
        elif self.open[-1].name == tag and (tag in _TEXT or tag == "template"):
            self._pop()
        elif tag not in ("body", "html"):  # what follows them belongs to the body still
            self._end(tag)

    def handle_data(self, data):
        if self.skip_newline and data.startswith("\n"):
            data = data[1:]
        self.skip_newline = False
        if not data:
            return
        top = self.open[-1]
        if top.name in _TEXT:
            raw = top.name in RAW or getattr(self, "_escapable", False)
            top.children.append(data if raw else unescape(data))
            return
        if self.body is None:
            rest = data.lstrip(_SPACE)
            if self.head is not None and len(rest) < len(data):
                top.children.append(data[: len(data) - len(rest)])
            if not rest:
                return
            data = rest
            self._begin_body()
        if self._context() == "colgroup" and self.open[-1].name == "colgroup":
            if not data.strip(_SPACE):
                self.open[-1].children.append(data)
                return
            self._pop()
        if self.open[-1].name in _FOSTERED and data.strip(_SPACE):
            self.fostering = True
        if data.strip(_SPACE) or self.open[-1].name not in _FOSTERED:
            if self._context() != "select":
                self._reopen()
        to, at = self._place()
        to.children.insert(len(to.children) if at is None else at, data)
        self.fostering = False

    def close(self):
        if self.cdata_elem and self.rawdata:  # raw text without an end
            rest, self.rawdata = self.rawdata, ""
            self.handle_data(rest)
        super().close()
        self._begin_body()

    # --- tables ---

    def _end_cell(self, names) -> bool:
        k = self._in_scope(names, _TABLE_SCOPE)
        if k:
            self._imply_ends()
            self._cut(k)
            self._to_marker()
        return k > 0

    def _back_to(self, names) -> None:
        while self.open[-1].name not in names and len(self.open) > 2:
            self._pop()

    def _start(self, tag: str, attrs: dict[str, str]) -> None:
        while True:
            context = self._context()
            if context == "select":
                if tag in ("input", "keygen", "textarea", "select") or tag in _TABLE_TAGS or tag == "table":
                    self._close({"select"}, _TABLE_SCOPE)
                    if tag == "select":
                        return
                    continue
                if tag in ("option", "optgroup", "hr"):
                    for name in ("option",) if tag == "option" else ("option", "optgroup"):
                        if self.open[-1].name == name:
                            self._pop()
                    self._insert(tag, attrs)
                elif tag in ("script", "template"):
                    self._insert(tag, attrs)
                return
            if context in _CELL or context == "caption":
                if tag not in _TABLE_TAGS:
                    return self._start_in_body(tag, attrs)
                self._end_cell({context})
            elif context == "colgroup":
                if tag == "col":
                    self._insert(tag, attrs)
                    return
                self._back_to({"colgroup"})
                self._pop()
            elif context == "tr" and tag in _CELL:
                self._back_to({"tr"})
                self._insert(tag, attrs)
                self.formatting.append(None)
                return
            elif context == "tr" and tag in _TABLE_TAGS:
                self._back_to({"tr"})
                self._pop()
            elif context in _SECTION and (tag == "tr" or tag in _CELL):
                self._back_to(_SECTION)
                self._insert("tr", attrs if tag == "tr" else {})
                if tag == "tr":
                    return
            elif context in _SECTION and tag in _TABLE_TAGS:
                self._back_to(_SECTION)
                self._pop()
            elif context == "table" and tag in _TABLE_TAGS:
                self._back_to({"table"})
                made = {"col": "colgroup", "tr": "tbody", "td": "tbody", "th": "tbody"}.get(tag, tag)
                self._insert(made, attrs if made == tag else {})
                if tag == "caption":
                    self.formatting.append(None)
                if made == tag:
                    return
            elif context == "body":
                return self._start_in_body(tag, attrs)
            elif tag == "table":
                self._close({"table"}, {"html"})
            elif tag in ("script", "style", "template"):
                self._insert(tag, attrs)
                return
            elif tag == "input" and attrs.get("type", "").lower() == "hidden":
                self._insert(tag, attrs)
                return
            elif tag == "form":
                if self.form is None:
                    self.form = self._insert(tag, attrs)
                    self._pop()
                return
            else:
                self.fostering = True
                self._start_in_body(tag, attrs)
                self.fostering = False
                return

    def _end(self, tag: str) -> None:
        while True:
            context = self._context()
            if context == "select":
                if tag == "select":
                    self._close({"select"}, _TABLE_SCOPE)
                elif tag in ("option", "optgroup"):
                    if tag == "optgroup" and self.open[-1].name == "option" and self.open[-2].name == "optgroup":
                        self._pop()
                    if self.open[-1].name == tag:
                        self._pop()
                elif (tag == "table" or tag in _TABLE_TAGS) and self._in_scope({tag}, _TABLE_SCOPE):
                    self._close({"select"}, _TABLE_SCOPE)
                    continue
                return
            if context == "body":
                return self._end_in_body(tag)
            outer = tag == "table" or tag == "tr" or tag in _SECTION
            if context in _CELL or context == "caption":
                if tag == context:
                    self._end_cell({tag})
                elif not (outer if context in _CELL else tag == "table"):
                    return None if tag in _TABLE_TAGS else self._end_in_body(tag)
                elif self._in_scope({tag}, _TABLE_SCOPE):
                    self._end_cell({context})
                    continue
                return
            if context == "colgroup":
                if tag == "col":
                    return
                self._back_to({"colgroup"})
                self._pop()
                if tag == "colgroup":
                    return
                continue
            if context == "table" and tag == "table":
                self._close({"table"}, {"html"})
                return
            inside = {"tr"} if context == "tr" else _SECTION if context in _SECTION else set()
            if inside and outer and not (tag == "tr" and context != "tr"):
                if not self._in_scope({tag}, _TABLE_SCOPE):
                    return
                self._back_to(inside)
                self._pop()
                if tag == context:
                    return
                continue
            if tag not in _TABLE_TAGS:
                self.fostering = True
                self._end_in_body(tag)
                self.fostering = False
            return

    # --- body ---

    def _start_in_body(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in _TABLE_TAGS or tag in ("frame", "frameset"):
            return
        if tag in _META:
            self._insert(tag, attrs)
        elif tag in _BLOCK or tag in _HEADING:
            self._close_p()
            if tag in _HEADING and self.open[-1].name in _HEADING:
                self._pop()
            self._insert(tag, attrs)
            self.skip_newline = tag in ("pre", "listing")
        elif tag == "form":
            if self.form is None:
                self._close_p()
                self.form = self._insert(tag, attrs)
        elif tag in ("li", "dd", "dt"):
            group = {"li"} if tag == "li" else {"dd", "dt"}
            self._close(group, _SPECIAL - {"address", "div", "p"})
            self._close_p()
            self._insert(tag, attrs)
        elif tag in _FORMATTING:
            if tag == "a" and (old := self._last_formatting("a")) is not None:
                self._end_formatting("a")
                if old in self.formatting:
                    self.formatting.remove(old)
                if old in self.open:
                    self._take_out(old)
            self._reopen()
            if tag == "nobr" and self._in_scope({"nobr"}):
                self._end_formatting("nobr")
                self._reopen()
            self._push_formatting(self._insert(tag, attrs))
        elif tag == "table":
            if not self.quirks:
                self._close_p()
            self._insert(tag, attrs)
        elif tag in ("hr", "xmp"):
            self._close_p()
            self._insert(tag, attrs)
        elif tag in ("param", "source", "track", "textarea", "iframe", "noembed"):
            self._insert(tag, attrs)
            self.skip_newline = tag == "textarea"
        else:
            if tag == "button":
                self._close({"button"})
            if tag in ("option", "optgroup") and self.open[-1].name == "option":
                self._pop()
            if tag in ("rb", "rp", "rt", "rtc") and self._in_scope({"ruby"}):
                self._imply_ends("" if tag in ("rb", "rtc") else "rtc")
            else:
                self._reopen()
            self._insert("img" if tag == "image" else tag, attrs)
            if tag in _MARKED:
                self.formatting.append(None)

    def _end_in_body(self, tag: str) -> None:
        if tag == "p":
            if not self._in_scope({"p"}, _BUTTON_SCOPE):
                self._insert("p", {})
            self._close_p()
        elif tag == "br":
            self._start_in_body("br", {})
        elif tag == "form":
            form, self.form = self.form, None
            if form in self.open:
                self._imply_ends()
                self._take_out(form)
        elif tag in _BLOCK or tag in ("button", "dd", "dt"):
            self._close({tag})
        elif tag == "li":
            self._close({tag}, _LIST_SCOPE)
        elif tag in _HEADING:
            self._close(_HEADING)
        elif tag in _FORMATTING:
            self._end_formatting(tag)
        elif tag in _MARKED:
            if self._close({tag}):
                self._to_marker()
        else:
            self._end_other(tag)

    def _end_other(self, tag: str) -> None:
        self._close({tag}, _SPECIAL)


def parse(html: str) -> Element:
    """The root over the html element of a page; a fragment is read as a page."""
    builder = Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root
