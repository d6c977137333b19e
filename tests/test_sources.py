"""Readers on recorded snippets, and the streams against their batch forms."""

import json

import pytest
from pyspark.sql import functions as F

from townkit.operators.feeds import current_items
from townkit.sources import adapters, documents
from townkit.streaming import live

PAGE = """<html><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script>
<script type="application/ld+json">{"@graph": [{"@type": ["Thing", "MusicEvent"], "name": "Song", "startDate": "2024-05-01", "location": {"name": "Hall"}, "subEvent": {"@type": "Event", "name": "Inner"}}]}</script>
<script type="application/ld+json">not json</script></head><body><nav><a href="/en/one">One</a></nav><h1>Head</h1><p>Some <b>bold</b> text<br>next</p>
<table><tr><th>When</th><td>1 May</td></tr></table><a href="https://other.org/en/x">x</a></body>"""


def test_page():
    page = documents.read_page(PAGE, "https://a.org/index")
    assert page.title == "A & B" and page.heading == "Head" and page.rows == [["When", "1 May"]]
    assert page.links == ["https://a.org/en/one", "https://other.org/en/x"]
    assert "Some bold text\nnext" in page.text and "One" not in page.text and "var t" not in page.text
    assert documents.read_page(None).text == "" and documents.read_page("<p>open<td>cell").text == "open\ncell"


def test_linked_events():
    assert [(e["name"], e["place"]) for e in documents.page_events(PAGE)] == [("Song", "Hall"), ("Inner", None)]


def test_feeds():
    rss = "<rss><channel><item><title>T</title><link>https://a.org</link><pubDate>Mon</pubDate></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>E</title><link href="https://b.org"/><updated>2024</updated></entry></feed>'
    assert documents.feed_items(rss)[0]["link"] == "https://a.org" and documents.feed_items(atom)[0]["link"] == "https://b.org"
    assert documents.feed_items("<broken") == [] and documents.feed_items(None) == []


@pytest.mark.parametrize(("change", "found"), [("", True), ("RRULE:FREQ=DAILY\n", False), ("BEGIN:VEVENT\n", False)])
def test_calendar(change, found):
    ics = f"BEGIN:VCALENDAR\nBEGIN:VEVENT\n{change}SUMMARY:Tea\\, cake\nDTSTART:20240501T100000Z\nDTEND:20240501T1\n 10000Z\nEND:VEVENT\nEND:VCALENDAR"
    event = documents.calendar_event(ics)
    assert (event is not None) is found
    if found:
        assert event["summary"] == "Tea, cake" and event["start"] == "2024-05-01T10:00" and event["end"] == "2024-05-01T11:00"
    assert documents.calendar_event("BEGIN:VEVENT\nDTSTART;VALUE=DATE:20240501\nEND:VEVENT") is None


def test_pages_with_nulls_and_extra_columns(spark):
    pages = spark.createDataFrame([(1, "https://a.org/", PAGE, "x"), (2, None, None, "y")], "page_id long, url string, html string, title string")
    found = {r["page_id"]: r for r in documents.read_pages(pages).collect()}
    assert found[1]["n_events"] == 2 and found[2]["text"] == ""
    links = documents.detail_links(documents.read_pages(pages), pages).collect()
    assert [(r["page_id"], r["place"], r["link"]) for r in links] == [(1, 1, "https://a.org/en/one")]


def test_adapters(spark):
    rows = spark.createDataFrame([(json.dumps({"name": " A ", "url": "https://a.org", "salePrice": 5}),), (json.dumps({"title": "", "label": "B"}),)], "json string")
    found = adapters.adapt(rows, "s").orderBy("title").collect()
    assert [(r["title"], r["price"]) for r in found] == [("A", "5"), ("B", None)]
    shapes = spark.createDataFrame([('{"features": [{"properties": {"n": 1}, "geometry": {"coordinates": [-2.5, 53.5]}}]}',), ('[{"n": 2}]',), ('{"items": []}',)], "json string")
    assert sorted((r["json"], r["lng"], r["lat"]) for r in adapters.unwrap(shapes).collect()) == [('{"n":1}', -2.5, 53.5), ('{"n":2}', None, None)]
    pages = spark.createDataFrame([("a", 1, "x", 2), ("a", 2, "y", 2), ("b", 1, "x", 2), ("c", 1, "x", 2), ("c", 2, "x", 2)], "source string, page int, signature string, pages int")
    assert {r["source"]: r["reason"] for r in adapters.complete_pages(pages).collect()} == {"a": None, "b": "missing_page", "c": "repeated_page"}
    with pytest.raises(ValueError):
        adapters.bounded(spark.range(5), 4)
    assert adapters.union_sources(spark.range(1).select("id"), spark.range(1).withColumn("x", F.lit(1))).count() == 2


def test_csv_and_evidence(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,n\nx,1\n")
    assert adapters.read_csv(spark, str(tmp_path / "a.csv"), "name string, n int", ("n",)).collect()[0]["n"] == 1
    with pytest.raises(ValueError):
        adapters.read_csv(spark, str(tmp_path / "a.csv"), "name string", ("postcode",))
    adapters.write_evidence(spark.range(2), str(tmp_path / "log"))
    adapters.write_evidence(spark.range(1), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 3


@pytest.fixture(scope="module")
def event_files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("events")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("event_id")
    for i in range(3):
        events.where(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


def run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_vitals_stream_is_the_batch(spark, event_files):
    found = run(live.vitals(live.read_stream(spark, event_files)), "vitals", "complete")
    batch = live.vitals(spark.read.parquet(event_files))
    assert sorted(map(repr, found.select("hour", "kind", "n").collect())) == sorted(map(repr, batch.select("hour", "kind", "n").collect()))


def test_repeats_are_left_out(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(50)
    for _ in range(2):
        events.coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    assert run(live.without_repeats(live.read_stream(spark, str(tmp_path / "e"), files=2)), "once", "append").count() == 50


def test_failures_stream(spark, event_files):
    found = run(live.failure_counts(live.read_stream(spark, event_files, files=3)), "failures", "update")
    last = {r["series"]: r["streak"] for r in found.collect()}
    rows = spark.read.parquet(event_files).orderBy("event_id").collect()
    streak = {}
    for r in rows:
        streak[r["user_id"]] = streak.get(r["user_id"], 0) + 1 if r["event_type"] == "error" else 0
    assert last == streak


def test_change_feed_versions_are_idempotent(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_type <> 'error'")
    half = events.where("event_id < 500"), events.where("event_id >= 500")
    for version in (0, 1, 1):
        live.apply_changes(half[version], str(tmp_path), spark, version)
    whole = current_items(events.select(F.get_json_object("props", "$.k").cast("int").alias("item"), "event_id"), "item", "event_id", F.lit(False))
    found = spark.read.parquet(f"{tmp_path}/v1")
    assert sorted(map(tuple, found.select("item", "event_id").collect())) == sorted(map(tuple, whole.select("item", "event_id").collect()))


def test_what_of_a_page_is_text():
    """Headers, asides and templates are content; menus, footers, forms, frames and drawings are not; a link's address follows its words."""
    html = """<header>Top</header><nav>Menu</nav><aside>Side</aside><svg><text>drawn</text></svg><iframe>frame</iframe><template>kept</template>
      <form>ask</form><p>See <a href="/a">this  page</a> and <a href="/b"><img src="x"></a>now</p><footer>End</footer><script>x()</script><noscript>none</noscript><style>p{}</style>"""
    assert " ".join(documents.read_page(html, "https://h.example/x").text.split()) == "Top Side kept See this page [https://h.example/a] and now"
