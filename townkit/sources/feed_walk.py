"""Paged change feeds as a Spark data source: pages followed by their `next` cursor, streamed with offsets that restart.

    spark.dataSource.register(FeedWalk)
    spark.readStream.format("feed_walk").option("feeds", json_of_name_to_url).option("cursors", folder).load()

The driver follows the cursors and logs, for each feed, the pages it has seen; an offset is a number of logged pages a feed. Executors read
the items of the pages between two offsets, a page a task, and keep only the fields asked for, item by item. As the log is durable and an
offset names the same pages after a restart, a batch that runs again reads the same items. The log also tells which feeds were read to their end.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

ITEMS = "feed string, page int, place int, item string, state string, modified string, data string"
REPORT = "feed string, pages int, complete boolean, error string"
FETCH_SECONDS = 30


def store(url: str):
    """(file system, path) of a URL in any store that Arrow can open."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(url if urlparse(url).scheme else f"file://{url}")


def fetch(url: str) -> dict:
    """The page at a URL: over http(s), or a file of any store."""
    if urlparse(url).scheme in ("http", "https"):
        from urllib.request import urlopen

        with urlopen(url, timeout=FETCH_SECONDS) as answer:  # noqa: S310
            return json.load(answer)
    system, path = store(url)
    with system.open_input_file(path) as file:
        return json.loads(file.read())


def following(url: str, page: dict) -> str | None:
    """The next page's URL; relative ones are resolved against the page's own."""
    after = page.get("next")
    if not after:
        return None
    base = urlparse(url)
    if base.scheme and base.scheme not in ("http", "https", "file") and not urlparse(after).scheme:
        return f"{base.scheme}://{base.netloc}{urljoin(base.path, after)}"  # urljoin knows few schemes
    return urljoin(url, after)


class Walk:
    """One feed's log: the pages with items, where to go on, whether the end was reached, and the error that stopped the walk."""

    def __init__(self, feed: str, first: str, log: str | None, most: int):
        self.feed, self.log, self.most = feed, log, most
        self.pages, self.next, self.complete, self.error = [], first, False, None
        if log:
            system, path = store(f"{log}/{feed}.json")
            if system.get_file_info(path).is_file:
                with system.open_input_file(path) as file:
                    known = json.loads(file.read())
                self.pages, self.next, self.complete = known["urls"], known["next"], known["complete"]

    def advance(self, pages: int) -> None:
        """Follows up to so many pages and logs them. An end is looked at again each time: a feed may go on later; errors are tried again."""
        self.error = None
        for _ in range(pages):
            if self.next is None:
                break
            if len(self.pages) >= self.most:
                self.complete, self.error = False, "page limit"
                break
            if self.next in self.pages:
                self.complete, self.error = False, "repeated page"
                break
            try:
                page = fetch(self.next)
            except Exception as problem:  # noqa: BLE001  whatever the store raises, the walk stops and says so
                self.complete, self.error = False, str(problem)[:300] or type(problem).__name__
                break
            if not page.get("items"):
                self.complete = True
                break
            after = following(self.next, page)
            self.pages.append(self.next)
            self.complete = not after or after == self.next
            self.next = None if self.complete else after
        if self.log:
            system, path = store(f"{self.log}/{self.feed}.json")
            system.create_dir(path.rpartition("/")[0], recursive=True)
            row = {"feed": self.feed, "pages": len(self.pages), "complete": self.complete, "error": self.error, "urls": self.pages, "next": self.next}
            with system.open_output_stream(f"{path}.new") as file:
                file.write(json.dumps(row).encode())
            system.move(f"{path}.new", path)


class Page(InputPartition):
    def __init__(self, feed: str, number: int, url: str):
        self.feed, self.number, self.url = feed, number, url


class Reading:
    """What the batch and the stream reader share."""

    def __init__(self, options):
        self.fields = [f.strip().split(".") for f in options.get("fields", "").split(",") if f.strip()]
        log, most = options.get("cursors"), int(options.get("maxPages", "2000"))
        self.walks = {name: Walk(name, url, log, most) for name, url in sorted(json.loads(options["feeds"]).items())}

    def reduced(self, data: dict | None) -> str | None:
        """Only the fields asked for, by their paths."""
        if data is None or not self.fields:
            return None if data is None else json.dumps(data)
        out = {}
        for path in self.fields:
            value = data
            for step in path:
                value = value.get(step) if isinstance(value, dict) else None
            out[".".join(path)] = value
        return json.dumps(out)

    def read(self, page: Page) -> Iterator[tuple]:
        text = lambda v: None if v is None else str(v)
        for place, item in enumerate(fetch(page.url).get("items", [])):
            live = item.get("state") == "updated" and item.get("data")
            yield page.feed, page.number, place, text(item.get("id")), "updated" if live else "deleted", text(item.get("modified")), self.reduced(item["data"]) if live else None


class StreamReading(Reading, DataSourceStreamReader):
    def __init__(self, options):
        super().__init__(options)
        if not options.get("cursors"):
            raise ValueError("a stream of feeds needs a folder for its cursors")
        self.step = int(options.get("pagesPerBatch", "100"))

    def initialOffset(self) -> dict:
        return {feed: 0 for feed in self.walks}

    def latestOffset(self) -> dict:
        for walk in self.walks.values():
            walk.advance(self.step)
        return {feed: len(walk.pages) for feed, walk in self.walks.items()}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(feed, n, walk.pages[n]) for feed, walk in self.walks.items() for n in range(start.get(feed, 0), end.get(feed, 0))]


class BatchReading(Reading, DataSourceReader):
    def partitions(self) -> list[Page]:
        for walk in self.walks.values():
            walk.advance(walk.most + 1)
        return [Page(feed, n, url) for feed, walk in self.walks.items() for n, url in enumerate(walk.pages)]


class FeedWalk(DataSource):
    """Options: feeds (JSON of names and first URLs), cursors (folder of the log; needed by streams), fields (paths kept of each item's data), pagesPerBatch, maxPages."""

    @classmethod
    def name(cls) -> str:
        return "feed_walk"

    def schema(self) -> str:
        return ITEMS

    def reader(self, schema) -> BatchReading:
        return BatchReading(self.options)

    def streamReader(self, schema) -> StreamReading:
        return StreamReading(self.options)


def feed_report(spark: SparkSession, cursors: str) -> DataFrame:
    """feed, pages, complete, error of each feed in the log."""
    return spark.read.schema(REPORT).json(cursors)


def live_items(changes: DataFrame) -> DataFrame:
    """The last state of each item of each feed, without deleted ones: an aggregate with a partial step."""
    last = changes.groupBy("feed", "item").agg(F.max_by(F.struct("state", "modified", "data"), F.struct("page", "place")).alias("r"))
    return last.where("r.state = 'updated'").select("feed", "item", "r.modified", "r.data")


def of_complete_feeds(items: DataFrame, report: DataFrame) -> DataFrame:
    """Items of feeds that were read to their end: a partial walk cannot tell what has ended from what is unread."""
    return items.join(report.where("complete").select("feed"), "feed", "left_semi")


def follow(spark: SparkSession, feeds: dict[str, str], folder: str, fields: str = "", pages: int = 100, batches: int | None = None, most: int | None = None) -> None:
    """Streams the feeds' items into the Parquet table {folder}/items until all are read (or so many batches); goes on where it was stopped. most: pages of a feed, where they are known."""
    spark.dataSource.register(FeedWalk)
    stream = spark.readStream.format("feed_walk").option("feeds", json.dumps(feeds)).option("cursors", f"{folder}/cursors").option("pagesPerBatch", pages).option("fields", fields)
    stream = (stream.option("maxPages", most) if most else stream).load()
    done = 0
    while batches is None or done < batches:
        query = stream.writeStream.format("parquet").option("path", f"{folder}/items").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        done += 1
        if not any(p["numInputRows"] for p in query.recentProgress):
            break


def write_pages(changes: DataFrame, folder: str, size: int = 100) -> DataFrame:
    """feed, pages: the feeds of changes (feed, n: their order from 0, item, state, modified, data as JSON), as files {folder}/{feed}/{page}.json that name their next one.

    Each page is written by one task under its own name, so that a task that runs again writes the same file. The last page is empty. A task
    holds one page at a time, however many it writes.
    """

    def save(feed: str, page: int, rows: list) -> pd.DataFrame:
        system, path = store(f"{folder}/{feed}/{page}.json")
        system.create_dir(path.rpartition("/")[0], recursive=True)
        items = [{"id": i.item, "state": i.state, "modified": i.modified, **({"data": json.loads(i.data)} if i.data is not None else {})} for i in rows if i.item is not None]
        with system.open_output_stream(path) as file:
            file.write(json.dumps({"next": f"{page + 1}.json" if items else f"{page}.json", "items": items}).encode())
        return pd.DataFrame({"feed": [feed], "page": [page]})

    def write(batches):
        # a page's rows stand together; one page is held at a time
        rows = (row for pdf in batches for row in pdf.itertuples(index=False))
        for (feed, page), of_page in groupby(rows, key=lambda r: (r.feed, int(r.page))):
            yield save(feed, page, [*of_page])

    columns = ["feed", "page", "n", "item", "state", "modified", "data"]
    pages = changes.withColumn("page", F.floor(F.col("n") / size))
    ends = pages.groupBy("feed").agg((F.max("page") + 1).alias("page"))
    ends = ends.select("feed", "page", *(F.lit(None).cast(pages.schema[c].dataType).alias(c) for c in columns[2:]))
    dealt = pages.select(*columns).unionByName(ends).repartition("feed", "page").sortWithinPartitions(*columns)
    out = dealt.withColumns({c: F.col(c).cast("string") for c in ("item", "modified")}).mapInPandas(write, "feed string, page long")
    return out.groupBy("feed").agg(F.count(F.lit(1)).alias("pages"))
