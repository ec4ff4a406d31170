"""Extraction over a tree of elements, for HTML of any shape, as an Arrow UDF."""

from __future__ import annotations

import functools
import html
import re
import time
from collections.abc import Callable
from datetime import UTC, datetime
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import quote, urljoin

import pandas as pd
from pyspark.sql import functions as F

from corpusloom.constants import CONTENT_PLACES, UNWANTED_CLASSES, UNWANTED_ROLES, UNWANTED_TAGS, WHITE

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_WHITE = re.compile(WHITE + "+")
_ENDS = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_ASCII_WHITE = re.compile("[\t\n\f\r ]+")


class Element:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []

    def walk(self, skip=None):
        """Elements in document order, without the subtrees of those that `skip` holds for."""
        stack = [self]
        while stack:
            e = stack.pop()
            if skip is None or not skip(e):
                yield e
                stack.extend(c for c in reversed(e.children) if isinstance(c, Element))

    def text(self, skip=None) -> str:
        out, stack = [], [self]
        while stack:
            e = stack.pop()
            if isinstance(e, str):
                out.append(e)
            elif skip is None or not skip(e):
                stack.extend(reversed(e.children))
        return "".join(out)

    def inner_html(self, skip=None) -> str:
        out: list[str] = []
        stack: list = list(reversed(self.children))
        while stack:
            e = stack.pop()
            if isinstance(e, tuple):
                out.append(e[0])
            elif isinstance(e, str):
                out.append(html.escape(e, quote=False))
            elif skip is None or not skip(e):
                out.append(f"<{e.tag}" + "".join(f' {k}="{html.escape(v)}"' for k, v in e.attributes.items()) + ">")
                if e.tag not in VOID:
                    stack.append((f"</{e.tag}>",))
                    stack.extend(reversed(e.children))
        return "".join(out)


#: What a start tag ends, and the elements that it does not look beyond.
_ROWS = frozenset(("tr", "td", "th"))
IMPLIED = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    **dict.fromkeys(("dt", "dd"), (frozenset(("dt", "dd")), frozenset(("dl",)))),
    **dict.fromkeys(("td", "th"), (frozenset(("td", "th")), frozenset(("tr", "table")))),
    "tr": (_ROWS, frozenset(("table", "thead", "tbody", "tfoot"))),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (_ROWS | {"thead", "tbody", "tfoot", "caption", "colgroup"}, frozenset(("table",)))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "optgroup"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
}


#: What an & begins if it is a character reference with a semicolon, and characters that no text may hold.
_REFERENCE = re.compile(r"&([A-Za-z][A-Za-z0-9]*;|#[0-9]+;|#[xX][0-9A-Fa-f]+;)?")
_NO_CHARACTERS = [*map(chr, range(0xFDD0, 0xFDF0))]


class _Builder(HTMLParser):
    """A tree of elements. An & that stands as `bare` is one that begins no reference."""

    def __init__(self, bare: str | None = None):
        super().__init__(convert_charrefs=True)
        self.bare = bare
        self.root = Element("#document", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if (tag in BLOCKS or tag in ("li", "dt", "dd")) and any(e.tag == "p" for e in self.open):
            self._close("p")
        ended, around = IMPLIED.get(tag, ((), ()))
        while ended:
            inside = next((e.tag for e in reversed(self.open) if e.tag in ended or e.tag in around), None)
            if inside not in ended:
                break
            self._close(inside)
        element = Element(tag, {k: self._written(v or "") for k, v in attrs})
        self.open[-1].children.append(element)
        if tag not in VOID:
            self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if any(e.tag == tag for e in self.open[1:]):
            self._close(tag)

    def _close(self, tag):
        while len(self.open) > 1 and self.open.pop().tag != tag:
            pass

    def handle_data(self, data):
        self.open[-1].children.append(self._written(data))

    def _written(self, data: str) -> str:
        return data.replace(self.bare, "&") if self.bare else data


def parse(text: str, bare: bool = True) -> Element:
    """The tree of a page. `bare`: references of old names need no semicolon, as in browsers; else all do, as in XHTML."""
    mark = None if bare else next(c for c in _NO_CHARACTERS if c not in text)
    if mark:
        text = _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else mark + m[0][1:], text)
    builder = _Builder(mark)
    builder.feed(text)
    builder.close()
    return builder.root


def _classes(e: Element) -> list[str]:
    return e.attributes.get("class", "").split()


def unwanted(e: Element) -> bool:
    return e.tag in UNWANTED_TAGS or e.attributes.get("role") in UNWANTED_ROLES or any(c in UNWANTED_CLASSES for c in _classes(e))


def _outside_body(e: Element) -> bool:
    return unwanted(e) or e.tag in ("head", "title")


def _content(root: Element):
    """The content's element and what to skip below it; without a body, all but the head is one."""
    kept = list(root.walk(unwanted))
    for kind, name in CONTENT_PLACES:
        for e in kept:
            if (e.tag == name if kind == "tag" else name in _classes(e) if kind == "class" else e.attributes.get(kind) == name):
                return e, unwanted
    return root, _outside_body


def absolute(href: str, base: str) -> str:
    return quote(urljoin(base, href.strip()), safe="%/:=&?~#+!$,;'@()*[]")


def parts(text: str, bare: bool = True) -> dict:
    """Title of the whole page; headings, content and cleaned html without unwanted elements; the references of the whole
    page as they are written, each once, at its first place. `bare` as in parse()."""
    root = parse(text) if bare else parse(text, bare=False)
    title = next((e.text() for e in root.walk() if e.tag == "title"), "")
    headings = [t for t in (e.text(unwanted).strip(_ENDS) for e in root.walk(unwanted) if e.tag in HEADINGS) if t]
    main, skip = _content(root)
    return {
        "title": _ASCII_WHITE.sub(" ", title).strip("\t\n\f\r "),
        "headings": headings,
        "content": _WHITE.sub(" ", main.text(skip)).strip(_ENDS),
        "references": list(dict.fromkeys(e.attributes["href"] for e in root.walk() if e.tag == "a" and "href" in e.attributes)),
        "cleaned_html": main.inner_html(skip),
        "error": None,
    }


def extract(text: str, url: str) -> dict:
    """The parts of a page, with absolute http links in place of references."""
    out = parts(text)
    links = dict.fromkeys(absolute(x, url) for x in out.pop("references"))
    return out | {"links": [x for x in links if x.startswith("http")]}


EXTRACTED = "title string, headings array<string>, content string, references array<string>, cleaned_html string, error string, at string, ms long"
_EMPTY = {"title": "", "headings": [], "content": "", "references": [], "cleaned_html": ""}


def extract_rows(text: pd.Series, bare: bool = True) -> pd.DataFrame:
    """A page that fails has empty fields and the message of its error. With the time at which each began and how long it took."""
    rows, read = [], parts if bare else functools.partial(parts, bare=False)
    for t in text:
        at, began = datetime.now(UTC), time.perf_counter()
        try:
            own = _EMPTY | {"error": "navigation failed"} if t is None else read(t)
        except Exception as e:  # any page may be malformed in its own way; the row carries the error
            own = _EMPTY | {"error": str(e) or type(e).__name__}
        rows.append(own | {"at": f"{at:%Y-%m-%dT%H:%M:%S}.{at.microsecond // 1000:03}Z", "ms": round(1000 * (time.perf_counter() - began))})
    return pd.DataFrame(rows, columns=[x.split()[0] for x in EXTRACTED.split(", ")])


def extract_udf(text: str, passed: Callable[[int], None] | None = None, bare: bool = True):
    """The column of extracted structs. passed(n) is called in the tasks, after n pages each time. `bare` as in parse()."""

    def rows(pages: pd.Series) -> pd.DataFrame:
        out = extract_rows(pages, bare)
        if passed:
            passed(len(out))
        return out

    return F.pandas_udf(rows, EXTRACTED)(text)
