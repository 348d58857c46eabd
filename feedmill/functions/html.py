"""A small HTML tree for text extraction and listing pages, on the standard library's tokenizer."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F

# Fixed values of the markup language: elements without an end tag, hidden elements, and those whose end is a line's end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg".split())
LINE_END = frozenset("p br div li h1 h2 h3 h4 h5 h6 tr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
# which open elements a start tag ends, and within which bounds
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "thead": ({"thead", "tbody"}, {"table"}),
}


class Node:
    __slots__ = ("name", "attrs", "children", "parent")

    def __init__(self, name: str, attrs: dict, parent: Node | None) -> None:
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    def walk(self):
        """All elements below this one, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self, ends: bool = False) -> str:
        """The text below; with ``ends`` without hidden elements, and a newline at the end of each block."""
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif not (ends and x.name in HIDDEN):
                if ends and x.name in LINE_END:
                    stack.append("\n")
                stack += reversed(x.children)
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def _end(self, names: set, bounds: set) -> None:
        n = self.at
        while n.parent is not None and n.name not in bounds:
            if n.name in names:
                self.at = n.parent
                names = names - {n.name} if n.name == "p" else names
            n = n.parent

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._end({"p"}, {"button", "td", "th", "table"})
        if tag in IMPLIED:
            self._end(*IMPLIED[tag])
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("path", "circle", "rect", "use", "line", "g"):  # only foreign elements close themselves
            self.at = self.at.parent

    def handle_endtag(self, tag):
        if tag == "br":
            self.handle_starttag("br", [])
            return
        n = self.at
        while n.parent is not None and n.name != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent
        elif tag == "p":  # an end without a start is an empty paragraph
            self.at.children.append(Node("p", {}, self.at))

    def handle_data(self, data):
        self.at.children.append(data)


def parse(markup: str) -> Node:
    b = _Builder()
    b.feed(markup)
    b.close()
    return b.root


def _collapse(text: str) -> str:
    text = re.sub(r"[ \t\f\v]+", " ", text.replace("\r", ""))
    return re.sub(r"[\s﻿]*\n[\s﻿]*", "\n", text).strip(" \t\n\r\f\v ﻿     　 ")


def text_of(markup: str | None) -> str | None:
    """Plain text of a page or fragment: hidden elements dropped, blocks end a line, white space collapsed; null stays null."""
    if markup is None:
        return None
    if not re.search(r"[<&]", markup):
        return _collapse(markup)
    return _collapse(parse(markup).text(ends=True))


def _text_series(markup: pd.Series) -> pd.Series:
    return markup.map(text_of, na_action="ignore")


def html_to_text(markup: Column) -> Column:
    return F.pandas_udf(_text_series, "string")(markup)


_SIMPLE = re.compile(r"(?P<tag>\*|[A-Za-z][\w-]*)|\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[*^$~|]?=)\s*(?:\"(?P<q>[^\"]*)\"|'(?P<s>[^']*)'|(?P<v>[^\]\s]+))\s*)?\]")


def _compound(text: str) -> list[tuple]:
    tests, at = [], 0
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if not m:
            raise ValueError(f"selector not understood: {text!r}")
        at = m.end()
        if m["tag"]:
            tests.append(("tag", m["tag"].lower()))
        elif m["cls"]:
            tests.append(("cls", m["cls"]))
        elif m["id"]:
            tests.append(("attr", "id", "=", m["id"]))
        else:
            value = next((m[k] for k in ("q", "s", "v") if m[k] is not None), None)
            tests.append(("attr", m["attr"].lower(), m["op"] or "", value))
    return tests


def selector(text: str) -> list[list[tuple[str, list[tuple]]]]:
    """Alternatives, each a chain of (combinator, tests) from left to right; combinators are ' ' and '>'."""
    out = []
    for part in re.split(r",(?![^\[]*\])", text):
        chain, how = [], " "
        for token in re.findall(r">|(?:\[[^\]]*\]|[^\s>\[])+", part.strip()):
            if token == ">":
                how = ">"
            else:
                chain.append((how, _compound(token)))
                how = " "
        if chain:
            out.append(chain)
    return out


def _passes(n: Node, tests: list[tuple]) -> bool:
    for t in tests:
        if t[0] == "tag":
            if t[1] not in ("*", n.name):
                return False
        elif t[0] == "cls":
            if t[1] not in n.attrs.get("class", "").split():
                return False
        else:
            have, op, want = n.attrs.get(t[1]), t[2], t[3]
            if have is None or op and not {"=": have == want, "*=": bool(want) and want in have, "^=": bool(want) and have.startswith(want), "$=": bool(want) and have.endswith(want), "~=": want in have.split(), "|=": have == want or have.startswith(f"{want}-")}[op]:
                return False
    return True


def _chain(n: Node, chain: list) -> bool:
    how, tests = chain[-1]
    if not _passes(n, tests):
        return False
    if len(chain) == 1:
        return True
    up = n.parent
    while up is not None:
        if _chain(up, chain[:-1]):
            return True
        if how == ">":
            return False
        up = up.parent
    return False


def matches(n: Node, sel: list) -> bool:
    return any(_chain(n, c) for c in sel)


def select(n: Node, text: str) -> list[Node]:
    """Elements below ``n`` that match, in document order, each once."""
    sel = selector(text)
    return [x for x in n.walk() if matches(x, sel)]


def first(n: Node, text: str) -> Node | None:
    sel = selector(text)
    return next((x for x in n.walk() if matches(x, sel)), None)
