import json

import pytest
from pyspark.sql import functions as F

from townkit.sources import feed_walk

SF = "/root/testdata/sf0.001"


@pytest.fixture
def pages(spark, tmp_path):
    """Three feeds over all events: one whole, one that breaks off after two pages, one that goes round in a circle."""
    rows = spark.read.parquet(f"{SF}/events.parquet")
    gone = F.col("event_type") == "error"
    data = F.when(~gone, F.to_json(F.struct(F.struct("value", "ts").alias("offer"), "event_type")))
    rows = rows.select((F.col("event_id") % 3).alias("f"), F.floor(F.col("event_id") / 3).alias("n"), (F.col("user_id") * 7 % 60).cast("string").alias("item"), F.when(gone, "deleted").otherwise("updated").alias("state"), F.col("event_id").cast("string").alias("modified"), data.alias("data"))
    changes = rows.select(F.element_at(F.array(*map(F.lit, ("whole", "broken", "circle"))), (F.col("f") + 1).cast("int")).alias("feed"), "n", "item", "state", "modified", "data")
    counts = {r["feed"]: r["pages"] for r in feed_walk.write_pages(changes, str(tmp_path / "pages"), 40).collect()}
    (tmp_path / "pages/broken/2.json").unlink()
    last = tmp_path / f"pages/circle/{counts['circle'] - 2}.json"
    last.write_text(json.dumps({**json.loads(last.read_text()), "next": "0.json"}))
    return changes, {f: str(tmp_path / f"pages/{f}/0.json") for f in counts}, counts


def expected(changes, feed, most=None):
    live = {}
    for r in changes.where((F.col("feed") == feed) & (F.lit(most is None) | (F.col("n") < (most or 0)))).orderBy("n").collect():
        live.pop(r["item"], None)
        if r["state"] == "updated":
            live[r["item"]] = json.loads(r["data"])["offer"]["value"]
    return live


def test_stopped_and_started_again(spark, pages, tmp_path):
    """After each stop the stream goes on behind what is committed: every item is there once, and the live ones are those of the batch."""
    changes, feeds, counts = pages
    folder = str(tmp_path / "walk")
    for _ in range(2):
        feed_walk.follow(spark, feeds, folder, "offer.value", pages=1, batches=1)
    half = spark.read.schema(feed_walk.ITEMS).parquet(f"{folder}/items")
    assert 0 < half.count() < changes.count() and half.select("feed", "page", "place").distinct().count() == half.count()
    feed_walk.follow(spark, feeds, folder, "offer.value", pages=3)
    found = spark.read.schema(feed_walk.ITEMS).parquet(f"{folder}/items")
    per_feed = {r["feed"]: r["count"] for r in found.groupBy("feed").count().collect()}
    assert per_feed == {"whole": changes.where("feed = 'whole'").count(), "broken": 80, "circle": changes.where("feed = 'circle'").count()}
    assert found.select("feed", "page", "place").distinct().count() == found.count()
    live = {f: {r["item"]: json.loads(r["data"])["offer.value"] for r in feed_walk.live_items(found).where(F.col("feed") == f).collect()} for f in counts}
    assert live == {"whole": expected(changes, "whole"), "broken": expected(changes, "broken", 80), "circle": expected(changes, "circle")}
    report = {r["feed"]: r for r in feed_walk.feed_report(spark, f"{folder}/cursors").collect()}
    assert {f: r["complete"] for f, r in report.items()} == {"whole": True, "broken": False, "circle": False}
    assert report["circle"]["error"] == "repeated page" and report["broken"]["error"] and report["broken"]["pages"] == 2
    kept = feed_walk.of_complete_feeds(feed_walk.live_items(found), feed_walk.feed_report(spark, f"{folder}/cursors"))
    assert {r["feed"] for r in kept.select("feed").distinct().collect()} == {"whole"}


def test_a_feed_that_goes_on_and_a_repaired_one(spark, pages, tmp_path):
    changes, feeds, counts = pages
    folder = str(tmp_path / "walk")
    feed_walk.follow(spark, {"whole": feeds["whole"], "broken": feeds["broken"]}, folder, pages=100)
    end = counts["whole"] - 1
    (tmp_path / f"pages/whole/{end}.json").write_text(json.dumps({"items": [{"id": "new", "state": "updated", "data": {"v": 1}}, {"id": "odd", "state": "updated"}]}))
    (tmp_path / "pages/broken/2.json").write_text(json.dumps({"items": []}))
    feed_walk.follow(spark, {"whole": feeds["whole"], "broken": feeds["broken"]}, folder, pages=100)
    items = spark.read.schema(feed_walk.ITEMS).parquet(f"{folder}/items")
    assert [(r["item"], r["state"], r["data"]) for r in items.where(f"feed = 'whole' AND page = {end}").orderBy("place").collect()] == [("new", "updated", '{"v": 1}'), ("odd", "deleted", None)]
    assert {r["feed"]: r["complete"] for r in feed_walk.feed_report(spark, f"{folder}/cursors").collect()} == {"whole": True, "broken": True}


def test_batch_and_limits(spark, pages):
    changes, feeds, counts = pages
    spark.dataSource.register(feed_walk.FeedWalk)
    read = spark.read.format("feed_walk").option("feeds", json.dumps(feeds))
    assert read.load().count() == changes.where("feed <> 'broken'").count() + 80
    assert read.option("maxPages", 1).load().groupBy("feed").count().collect()[0]["count"] == 40
    with pytest.raises(Exception, match="cursors"):
        spark.readStream.format("feed_walk").option("feeds", json.dumps(feeds)).load().writeStream.format("noop").start().processAllAvailable()


def test_pages_are_written_over_batches_and_walked_beyond_the_usual_limit(spark, tmp_path):
    changes = spark.range(50).selectExpr("concat('f', id % 2) AS feed", "id DIV 2 AS n", "cast(id AS string) AS item", "'updated' AS state", "'m' AS modified", "concat('{\"v\": ', id, '}') AS data").repartition(5)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert {r["feed"]: r["pages"] for r in feed_walk.write_pages(changes, str(tmp_path / "pages"), 7).collect()} == {"f0": 5, "f1": 5}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    pages = [feed_walk.fetch(str(tmp_path / "pages" / "f1" / f"{k}.json")) for k in range(5)]
    assert [[i["id"] for i in p["items"]] for p in pages] == [[str(2 * n + 1) for n in range(k * 7, min(25, k * 7 + 7))] for k in range(5)]
    feeds = {f: str(tmp_path / "pages" / f / "0.json") for f in ("f0", "f1")}
    for most, complete in ((3, {False}), (5, {True})):
        feed_walk.follow(spark, feeds, str(tmp_path / f"walk{most}"), most=most)
        assert {r["complete"] for r in feed_walk.feed_report(spark, str(tmp_path / f"walk{most}" / "cursors")).collect()} == complete
