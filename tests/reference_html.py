"""Test-only brute force: a plain tree builder on the stdlib HTML tokenizer with the rules the
extraction fold claims to follow (open-element stack, end tag pops to the most recent open element
of its name, void elements never open, entities decoded per text node, comments / script / style
text not part of element text).  Tests compare single facts of the tree with the Spark fold."""

from __future__ import annotations

import html.entities
from html.parser import HTMLParser

from sitefold.functions.html import VOID_ELEMENTS

_ENT = {}
for _k, _v in html.entities.html5.items():
    _ENT.setdefault(_k.rstrip(";"), _v)
_SKIP = {"script", "style"}


class _El:
    def __init__(self, name, attrs, order):
        self.name, self.attrs, self.order, self.children = name, attrs, order, []


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.root = _El("#root", {}, -1)
        self.stack = [self.root]
        self.count = 0
        self.elements = []

    def _text(self, s):
        kids = self.stack[-1].children
        if kids and isinstance(kids[-1], list):
            kids[-1].append(s)
        else:
            kids.append([s])

    def handle_starttag(self, tag, attrs):
        el = _El(tag, {k: (v if v is not None else "") for k, v in attrs}, self.count)
        self.count += 1
        self.elements.append(el)
        self.stack[-1].children.append(el)
        if tag not in VOID_ELEMENTS:
            self.stack.append(el)

    def handle_startendtag(self, tag, attrs):
        el = _El(tag, {k: (v if v is not None else "") for k, v in attrs}, self.count)
        self.count += 1
        self.elements.append(el)
        self.stack[-1].children.append(el)

    def handle_endtag(self, tag):
        # every end tag ends the current text node, even one that closes nothing
        self.stack[-1].children.append(None)
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].name == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        if self.stack[-1].name in _SKIP:
            return
        self._text(data)

    def handle_entityref(self, name):
        self._text(_ENT.get(name, "&" + name))

    def handle_charref(self, name):
        n = int(name[1:], 16) if name[:1] in "xX" else int(name)
        ch = None
        if 0x80 <= n < 0xA0:
            try:
                ch = bytes([n]).decode("cp1252")
            except UnicodeDecodeError:
                ch = None
        if ch is None:
            ch = chr(n) if n <= 0x10FFFF else "�"
        self._text(ch)

    def handle_comment(self, data):
        self.stack[-1].children.append(None)  # a node that separates text runs


def _strings(el):
    for c in el.children:
        if isinstance(c, list):
            yield "".join(c)
        elif isinstance(c, _El):
            if c.name not in _SKIP:
                yield from _strings(c)


def text_of(el) -> str:
    return "".join(s.strip() for s in _strings(el) if s.strip())


def build(doc: str) -> list[_El]:
    """Every element of ``doc`` in document order."""
    b = _Builder()
    b.feed(doc)
    b.close()
    return b.elements


def first(elements: list[_El], name: str, after: int = -1) -> _El | None:
    return next((e for e in elements if e.name == name and e.order > after), None)
