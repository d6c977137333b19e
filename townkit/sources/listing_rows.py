"""The rows and cards of a page that may be listings: its tables, else what the first of some selectors finds, as one line each."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townkit.sources.documents import VOID

#: The selectors in their order, the least and greatest length of a card, rows of a page, and what words that hint at a date begin with.
SELECTORS = ("article", ".event", ".event-card", ".event-item", ".views-row", ".listing-item", ".card", "li")
SHORTEST, LONGEST, MOST = 20, 1200, 150
DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DATE_HINT = re.compile(rf"\b(?:{'|'.join(DAYS + MONTHS)})[a-z]*\b|\b[0-9]{{1,2}}(?:st|nd|rd|th)?\s+(?:{'|'.join(MONTHS)})|\b[0-9]{{1,2}}[/-][0-9]{{1,2}}(?:[/-][0-9]{{2,4}})?\b|\b20[0-9]{{2}}\b", re.IGNORECASE)
#: Elements whose text is none of a page's.
SILENT = ("script", "style", "template")
LINES = pa.schema([("page_id", pa.int64()), ("place", pa.int64()), ("selector", pa.string()), ("line", pa.string())])
LINES_SQL = "page_id long, place long, selector string, line string"


class Node:
    __slots__ = ("tag", "attributes", "inside")

    def __init__(self, tag: str, attributes: dict[str, str | None]):
        self.tag, self.attributes, self.inside = tag, attributes, []

    def each(self) -> Iterator[Node]:
        """All elements below, in the order of the page; without recursion, however deep it is."""
        rest = [iter(self.inside)]
        while rest:
            node = next(rest[-1], None)
            if node is None:
                rest.pop()
            elif isinstance(node, Node):
                yield node
                rest.append(iter(node.inside))

    def text(self) -> str:
        out, rest = [], [iter(self.inside)]
        while rest:
            node = next(rest[-1], None)
            if node is None:
                rest.pop()
            elif isinstance(node, str):
                out.append(node.strip())
            elif node.tag not in SILENT:
                rest.append(iter(node.inside))
        return " ".join(" ".join(p for p in out if p).split())

    def fits(self, selector: str) -> bool:
        return selector[1:] in (self.attributes.get("class") or "").split() if selector[0] == "." else self.tag == selector


class TreeReader(HTMLParser):
    """The elements of a page; an end tag closes all that its element left open, one without a start is ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = Node("", {})
        self.open = [self.top]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs))
        self.open[-1].inside.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].inside.append(Node(tag, dict(attrs)))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].inside.append(data)


def tree(html: str) -> Node:
    reader = TreeReader()
    reader.feed(html)
    reader.close()
    return reader.top


def links(node: Node, base: str) -> list[str]:
    """label [address] of the links with both, each once."""
    out = {}
    for a in node.each():
        if a.tag == "a" and a.attributes.get("href"):
            address, label = urljoin(base, a.attributes["href"].strip()), a.text()
            if label and urlparse(address).scheme in ("http", "https"):
                out[f"{label} [{address}]"] = None
    return list(out)


def with_links(line: str, found: list[str]) -> str:
    return f"{line} | LINKS: {' ; '.join(found)}" if found else line


def listing_lines(html: str, base: str) -> list[tuple[str, str]]:
    """(selector, line) of a page, MOST at most: table rows of two cells and more; without any, the cards of the first selector that has some
    with a link or a hint of a date."""
    top, rows = tree(html), []
    for row in (n for n in top.each() if n.tag == "tr"):
        cells = [t for c in row.each() if c.tag in ("th", "td") and (t := c.text())]
        if len(cells) >= 2:
            rows.append(("tr", with_links(" | ".join(cells), links(row, base))))
    for selector in SELECTORS:
        if rows:
            break
        for node in (n for n in top.each() if n.fits(selector)):
            line = node.text()
            if not SHORTEST <= len(line) <= LONGEST:
                continue
            found = links(node, base)
            row = (selector, with_links(line, found))
            if (found or DATE_HINT.search(line)) and row not in rows:
                rows.append(row)
                if len(rows) >= MOST:
                    break
    return rows[:MOST]


def read_lines(pages: DataFrame) -> DataFrame:
    """page_id, place, selector, line of all pages (page_id, url, html). Null pages have none; broken markup is read as far as it goes; a null url resolves no relative link."""

    def read(batches):
        for batch in batches:
            out = [(n, k, *row) for n, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, row in enumerate(listing_lines(html, url))]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(LINES), LINES, strict=True)], schema=LINES)

    return pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))).mapInArrow(read, LINES_SQL)
