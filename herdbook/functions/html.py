"""HTML to text and links, with the standard library's parser in Arrow batches, and regular-expression versions in the JVM."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SKIP = {"script", "style", "noscript", "template"}
_EDGE = {"header", "footer", "nav", "aside"}
_VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
#: Where a page's main content is looked for, in this order.
_MAIN = ("#main", "main", "#content", ".site-main", ".page-content", "#primary")


class _Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: _Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def text(self, glue: str = " ") -> str:
        out: list[str] = []
        stack: list = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                if n.strip():
                    out.append(n.strip())
            else:
                stack.extend(reversed(n.children))
        return glue.join(out)

    def all(self) -> Iterator[_Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if not isinstance(c, str))


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        n = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(n)
        if tag not in _VOID:
            self.at = n

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def _tree(html: str) -> _Node:
    t = _Tree()
    t.feed(html)
    t.close()
    return t.root


def _prune(root: _Node, drop) -> None:
    for n in list(root.all()):
        n.children = [c for c in n.children if isinstance(c, str) or not drop(c)]


def _cookie(n: _Node) -> bool:
    words = f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}".lower()
    return any(w in words for w in ("cookie", "consent", "gdpr"))


def _is(n: _Node, selector: str) -> bool:
    if selector[0] == "#":
        return n.attrs.get("id") == selector[1:]
    return selector[1:] in n.attrs.get("class", "").split() if selector[0] == "." else n.tag == selector


def main_content(html: str, short: int = 50) -> str:
    """The text of the first main container: without scripts, short edges (header, footer, nav, aside) and cookie notices."""
    root = _tree(html)
    top = next((n for s in (*_MAIN, "body") for n in root.all() if _is(n, s)), root)
    _prune(top, lambda n: n.tag in _SKIP or _cookie(n) or n.tag in _EDGE and len(n.text()) < short)
    return top.text()


def page_text(html: str, short: int = 80) -> str:
    """The whole page's text, a line for each piece, without scripts, short edges and cookie notices; no blank lines."""
    root = _tree(html)
    _prune(root, lambda n: n.tag in _SKIP or _cookie(n) or n.tag in _EDGE and len(n.text()) < short)
    return "\n".join(p for line in root.text("\n").split("\n") for p in (x.strip() for x in line.split("  ")) if p)


def _each(f):
    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda h: None if h is None else f(h))

    return run


def full_text(html: Column) -> Column:
    """All text of a page, blanks between its pieces."""
    def text(h: str) -> str:
        root = _tree(h)
        _prune(root, lambda n: n.tag in _SKIP)
        return root.text()

    return _each(text)(html)


def main_text(html: Column) -> Column:
    """main_content() of each page."""
    return _each(main_content)(html)


def readable_text(html: Column) -> Column:
    """page_text() of each page."""
    return _each(page_text)(html)


def stripped(html: Column) -> Column:
    """A page's text by regular expressions, in the JVM: scripts and tags out, blanks single."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def hrefs(html: Column) -> Column:
    """The targets of all links of a page, in order."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))


def links(html: Column) -> Column:
    """The links of a page: array of (href, anchor), tags in the anchor left out."""
    whole = F.regexp_extract_all(html, F.lit(r'(?is)(<a\s[^>]*?href="[^"]*"[^>]*>.*?</a>)'), F.lit(1))
    return F.transform(whole, lambda a: F.struct(F.regexp_extract(a, r'(?i)href="([^"]*)"', 1).alias("href"), F.trim(F.regexp_replace(a, r"<[^>]*>", "")).alias("anchor")))
