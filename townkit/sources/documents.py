"""Records out of documents: web pages, linked data, feeds and calendars.

Parsing a page is inherently per page: a small function for one document, applied in Arrow batches where the rows are. Everything after
it, from the records on, is columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose text is not content, elements that end a line, and elements without an end tag.
BOILERPLATE = ("script", "style", "noscript", "svg", "iframe", "form", "nav", "footer")
BLOCKS = ("p", "div", "section", "article", "header", "aside", "main", "template", "li", "tr", "br", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "title")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


class PageReader(HTMLParser):
    """Text without boilerplate, links, table rows and linked-data scripts of one page; broken markup is read as far as it goes."""

    def __init__(self, base: str = ""):
        super().__init__(convert_charrefs=True)
        self.base, self.skip, self.parts, self.links, self.rows, self.scripts = base, [], [], [], [], []
        self.title, self.heading, self._in, self._script, self._href, self._cell, self._label = "", "", "", None, None, None, False

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        if tag == "script" and (values.get("type") or "").lower() == "application/ld+json":
            self._script = []
        if tag == "a" and values.get("href"):
            self.links.append(urljoin(self.base, values["href"]))
        if tag in BOILERPLATE:
            self.skip.append(tag)
        if self.skip:
            return
        if tag in BLOCKS:
            self.parts.append("\n")
        if tag in ("title", "h1"):
            self._in = tag
        if tag == "a" and values.get("href"):
            self._href, self._label = self.links[-1], False
        if tag == "tr":
            self.rows.append([])
        if tag in ("td", "th"):
            self._cell = []

    def handle_endtag(self, tag):
        if tag == "script" and self._script is not None:
            self.scripts.append("".join(self._script))
            self._script = None
        if tag in self.skip:
            while self.skip and self.skip.pop() != tag:
                pass
            return
        if self.skip:
            return
        if tag in BLOCKS:
            self.parts.append("\n")
        if tag == self._in:
            self._in = ""
        if tag == "a" and self._href:
            if self._label:  # a link without words has no address in the text
                self.parts.append(f" [{self._href}] ")
            self._href = None
        if tag in ("td", "th") and self._cell is not None and self.rows:
            self.rows[-1].append(" ".join("".join(self._cell).split()))
            self._cell = None

    def handle_data(self, data):
        if self._script is not None:
            self._script.append(data)
        if self.skip:
            return
        self.parts.append(data)
        self._label = self._label or bool(data.strip())
        if self._cell is not None:
            self._cell.append(data)
        if self._in == "title":
            self.title += data
        if self._in == "h1":
            self.heading += data

    @property
    def text(self) -> str:
        lines = (" ".join(line.split()) for line in "".join(self.parts).split("\n"))
        return "\n".join(line for line in lines if line)


def read_page(html: str | None, base: str | None = None) -> PageReader:
    reader = PageReader(base or "")
    reader.feed(html or "")
    reader.close()
    return reader


def linked_events(node) -> Iterator[dict]:
    """Every object, at any depth, whose type ends in 'event'."""
    if isinstance(node, list):
        for x in node:
            yield from linked_events(x)
    elif isinstance(node, dict):
        kinds = node.get("@type")
        if any(isinstance(k, str) and k.lower().endswith("event") for k in (kinds if isinstance(kinds, list) else [kinds])):
            yield node
        for x in node.values():
            yield from linked_events(x)


def page_events(html: str | None, base: str | None = None) -> list[dict]:
    """Name, start, end, place, url of the events in a page's linked data; scripts that are no JSON are left out."""
    out = []
    for script in read_page(html, base).scripts:
        try:
            data = json.loads(script)
        except ValueError:
            continue
        for event in linked_events(data):
            place = event.get("location")
            place = place[0] if isinstance(place, list) and place else place
            text = lambda x: None if x is None else str(x)
            out.append({"name": text(event.get("name")), "start": text(event.get("startDate")), "end": text(event.get("endDate")), "place": text(place.get("name") if isinstance(place, dict) else place), "url": text(event.get("url"))})
    return out


def feed_items(xml: str | None, most: int = 30) -> list[dict]:
    """Title, link, published, summary of the first items of an RSS or Atom feed; a document that is no XML has none."""
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return []
    local = lambda e: e.tag.rpartition("}")[2]
    out = []
    for item in (e for e in root.iter() if local(e) in ("item", "entry")):
        values = {}
        for child in item:
            values.setdefault(local(child), child.get("href") or (child.text or "").strip())
        out.append({"title": values.get("title"), "link": values.get("link"), "published": values.get("pubDate") or values.get("published") or values.get("updated"), "summary": values.get("description") or values.get("summary")})
    return out[:most]


def calendar_event(ics: str | None) -> dict | None:
    """Summary, start, end, place of a calendar with one timed event; null for recurring, all-day or several events."""
    lines = re.sub(r"\r?\n[ \t]", "", ics or "").splitlines()
    if lines.count("BEGIN:VEVENT") != 1 or any(x.startswith("RRULE") for x in lines):
        return None
    fields = {}
    for line in lines[lines.index("BEGIN:VEVENT") :]:
        name, _, value = line.partition(":")
        fields.setdefault(name.partition(";")[0], value.replace("\\,", ",").replace("\\n", "\n"))
    if not re.fullmatch(r"\d{8}T\d{6}Z?", fields.get("DTSTART", "")):
        return None
    stamp = lambda v: None if not v else f"{v[:4]}-{v[4:6]}-{v[6:8]}T{v[9:11]}:{v[11:13]}"
    return {"summary": fields.get("SUMMARY"), "start": stamp(fields["DTSTART"]), "end": stamp(fields.get("DTEND")), "place": fields.get("LOCATION")}


PAGES = pa.schema([("page_id", pa.int64()), ("title", pa.string()), ("heading", pa.string()), ("text", pa.string()), ("links", pa.list_(pa.string())), ("n_rows", pa.int64()), ("n_events", pa.int64())])


def read_pages(pages: DataFrame) -> DataFrame:
    """page_id, title, heading, text, links, n_rows, n_events of each page (page_id, url, html)."""

    def read(batches):
        for batch in batches:
            out = []
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page = read_page(html, url)
                out.append({"page_id": page_id, "title": page.title.strip(), "heading": page.heading.strip(), "text": page.text, "links": page.links, "n_rows": len(page.rows), "n_events": len(page_events(html, url))})
            yield pa.RecordBatch.from_pylist(out, schema=PAGES)

    return pages.select("page_id", "url", "html").mapInArrow(read, "page_id long, title string, heading string, text string, links array<string>, n_rows long, n_events long")


def detail_links(read: DataFrame, urls: DataFrame, signal: str = r"/(event|activity|class|en|fr)", most: int = 4) -> DataFrame:
    """page_id, place, link: the first `most` distinct links of a page to its own host that look like details. read: read_pages; urls: page_id, url."""
    from pyspark.sql import Window

    from townkit.functions.urls import host

    rows = read.join(urls.select("page_id", host(F.col("url")).alias("own")), "page_id").select("page_id", "own", F.posexplode("links").alias("at", "link"))
    rows = rows.where((host(F.col("link")) == F.col("own")) & F.col("link").rlike(signal)).groupBy("page_id", "link").agg(F.min("at").alias("at"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("at"))).where(F.col("place") <= most).select("page_id", "place", "link")


def plain(value: str | None) -> str:
    """Markup and entities removed, spaces collapsed."""
    return " ".join(unescape(re.sub(r"<[^>]*>", " ", value or "")).split())


EVENTS = pa.schema([("page_id", pa.int64()), ("place_in_page", pa.int64()), *((c, pa.string()) for c in ("name", "start", "end", "place", "url"))])


def read_events(pages: DataFrame) -> DataFrame:
    """page_id, place_in_page, name, start, end, place, url: a row for each event in the linked data of each page (page_id, url, html)."""

    def read(batches):
        for batch in batches:
            out = [
                {"page_id": page_id, "place_in_page": k, **event}
                for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                for k, event in enumerate(page_events(html, url))
            ]
            yield pa.RecordBatch.from_pylist(out, schema=EVENTS)

    return pages.select("page_id", "url", "html").mapInArrow(read, "page_id long, place_in_page long, name string, start string, end string, place string, url string")


def _records(rows: DataFrame, key: str, column: str, parse, fields: tuple[str, ...], numbered: bool) -> DataFrame:
    """key and fields of what parse makes of each document, with its place in the document where there can be several."""
    schema = pa.schema([(key, pa.int64()), *([("place", pa.int32())] if numbered else []), *((f, pa.string()) for f in fields)])

    def read(batches):
        for batch in batches:
            out = [
                {key: k, "place": at, **record}
                for k, document in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                for at, record in enumerate(parse(document))
            ]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    columns = ", ".join([f"{key} long", *(["place int"] if numbered else []), *(f"`{f}` string" for f in fields)])
    return rows.select(F.col(key).cast("long"), column).mapInArrow(read, columns)


def read_feeds(feeds: DataFrame, key: str, xml: str) -> DataFrame:
    """key, place, title, link, published, summary of the first items of each RSS or Atom feed; null and broken feeds have none."""
    return _records(feeds, key, xml, feed_items, ("title", "link", "published", "summary"), True)


def read_calendars(calendars: DataFrame, key: str, ics: str) -> DataFrame:
    """key, summary, start, end, place of each calendar with one timed event; null, recurring and all-day ones have none."""
    return _records(calendars, key, ics, lambda text: [e] if (e := calendar_event(text)) else [], ("summary", "start", "end", "place"), False)
