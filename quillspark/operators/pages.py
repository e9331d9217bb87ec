"""Web pages by tag: text without boilerplate tags, title, selected container, links. For learned extraction see the corpus
operators.

A page is parsed once per row in Arrow batches. Null html counts as empty. Of a batch, only so many pages at a time are Python
objects, as the links of one page can take more room than its html.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags that never hold a page's own text, void tags, and where job descriptions stand, in order.
DROPPED = {"script", "style", "nav", "footer", "header", "iframe", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CONTAINERS = (
    ".job-description", ".description", ".job-details", "#job-description", "#description", "[data-testid='jobDescription']", "article", ".posting-page", ".content-wrapper",
)

PAGES = 32
FIELDS = pa.struct([("title", pa.string()), ("text", pa.string()), ("main", pa.string()), ("links", pa.list_(pa.struct([("url", pa.string()), ("text", pa.string())])))])


class _Page(HTMLParser):
    """Text pieces outside dropped subtrees in page order, and each element with the range of pieces it holds."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[list] = []  # tag, attributes, first piece, end
        self.open: list[int] = []
        self.places: dict[str, list[int]] = {}
        self.dropped = 0
        self.pieces: list[str] = []
        self.links: list[tuple[str, list[str]]] = []
        self.feed(html)
        self.close()
        self._pop(0)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            return
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(len(self.elements))
        self.elements.append([tag, dict(attrs), len(self.pieces), 0])
        self.dropped += tag in DROPPED
        if tag == "a" and dict(attrs).get("href"):
            self.links.append((dict(attrs)["href"], []))

    def _pop(self, to: int) -> None:
        for k in reversed(self.open[to:]):
            element = self.elements[k]
            element[3] = len(self.pieces)
            self.places[element[0]].pop()
            self.dropped -= element[0] in DROPPED
        del self.open[to:]

    def handle_endtag(self, tag: str) -> None:
        if self.places.get(tag):
            self._pop(self.places[tag][-1])

    def handle_data(self, data: str) -> None:
        text = data.strip()
        if text and not self.dropped:
            self.pieces.append(text)
        if text and self.links and self.places.get("a"):
            self.links[-1][1].append(text)

    def first(self, selector: str) -> list[str] | None:
        """Pieces of the first element that the selector fits."""
        return next((self.pieces[a:b] for tag, attrs, a, b in self.elements if _selects(selector, tag, attrs)), None)


def _selects(selector: str, tag: str, attrs: dict) -> bool:
    """tag, .class, #id, [attribute='value'], or a tag before one of these."""
    if m := re.fullmatch(r"([a-z0-9]*)\[([\w-]+)='([^']*)'\]", selector):
        return m[1] in ("", tag) and attrs.get(m[2]) == m[3]
    m = re.fullmatch(r"([a-z0-9]*)([.#]?)([\w-]*)", selector)
    if not m or (m[1] and m[1] != tag):
        return False
    if m[2] == "#":
        return attrs.get("id") == m[3]
    return m[2] != "." or m[3] in (attrs.get("class") or "").split()


def _container(page: _Page, containers: tuple[str, ...]) -> str:
    """Lines of the first element of the first selector that fits any, else of the body."""
    found = next((x for x in map(page.first, containers) if x is not None), None) or page.first("body") or []
    return "\n".join(line.strip() for x in found for line in x.splitlines() if line.strip())


def page_fields(html: Column, base: Column, containers: tuple[str, ...] = CONTAINERS) -> Column:
    """Struct of title (first h1, else title), text (lines outside dropped tags), main (those of the first container found,
    else of the body) and links (target, made absolute, and its text)."""

    def fields(source: str | None, url: str | None) -> dict:
        page = _Page(source or "")
        links = [{"url": urljoin(url or "", href), "text": " ".join(words)} for href, words in page.links]
        title = next(("".join(x) for x in (page.first("h1"), page.first("title")) if x), "")
        return {"title": title, "text": "\n".join(page.pieces), "main": _container(page, containers), "links": links}

    @F.arrow_udf("title string, text string, main string, links array<struct<url:string,text:string>>")
    def run(pages: pa.Array, bases: pa.Array) -> pa.Array:
        parts = [pa.array([], FIELDS)]
        for at in range(0, len(pages), PAGES):
            rows = zip(pages.slice(at, PAGES).to_pylist(), bases.slice(at, PAGES).to_pylist(), strict=True)
            parts.append(pa.array([fields(*row) for row in rows], FIELDS))
        return pa.concat_arrays(parts)

    return run(html, base)


def _pages(s, d):
    return s.read.parquet(f"{d}/pages.parquet")


def _fields(s, d):
    return _pages(s, d).select("page_id", page_fields(F.col("html"), F.col("url")).alias("f"))


QUERIES = {
    "h01_text": lambda s, d: _fields(s, d).select("page_id", "f.text"),
    "h02_lines": lambda s, d: _fields(s, d).select("page_id", F.size(F.split("f.text", "\n")).cast("long").alias("lines")),
    "h04_container": lambda s, d: _fields(s, d).select("page_id", "f.title", "f.main"),
    "h05_links": lambda s, d: _fields(s, d).select("page_id", F.inline("f.links")),
    "h06_first_results": lambda s, d: _fields(s, d).select("page_id", F.inline(F.slice("f.links", 1, 5))),
}
SQL: dict[str, str] = {}
