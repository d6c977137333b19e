"""Queries over checks: offers' problems, places of news, categories, editor's filters, links, staged caches, patches, feeds and calendars as rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townkit.operators import checks
from townkit.operators.stages import shared_dir
from townkit.plans.registry import query
from townkit.sources import documents
from townkit.sources.adapters import complete_pages
from townkit.sources.tables import LISTINGS, VENUES, listings, read, venues


@query("""SELECT p_partkey AS id, CASE p_partkey % 13 WHEN 0 THEN 'outside_audience' WHEN 1 THEN 'missing_title' WHEN 2 THEN 'bad_link' WHEN 3 THEN 'merchant_conflict' WHEN 4 THEN 'source_unavailable' WHEN 5 THEN 'expired'
  WHEN 6 THEN 'not_started' WHEN 7 THEN 'invalid_offer_date' WHEN 8 THEN 'source_unavailable' WHEN 9 THEN 'implausible_price' WHEN 10 THEN 'too_old' END AS problem FROM part""")
def offer_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first problem of each offer: ten kinds, and offers without one."""
    turn, now = F.col("p_partkey") % 13, F.lit("2024-06-15 12:00:00").cast("timestamp")
    on = lambda k, value, other: F.when(turn == k, value).otherwise(other)
    text = F.when(turn == 3, "Only £1,200.50 at Marks & Spencer today").when(turn == 11, "Only £1,200.50 from Argos today").otherwise("A description")
    rows = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), (turn == 0).alias("audience_invalid"), F.when(turn == 1, "  ").when(turn == 8, "Toy - SOLD OUT").otherwise(F.col("p_name")).alias("title"), on(2, "https://user@shop.example.com/x", "https://shop.example.com/x").alias("link"),
        text.alias("description"), F.when(turn.isin(3, 11), "Argos").alias("retailer"), F.when(turn.isin(3, 11), 1200.5).when(turn == 9, 10000.01).when(turn == 12, None).otherwise(F.col("p_size").cast("double")).alias("price"),
        on(4, "paused", "active").alias("status"), F.when(turn == 5, "2024-06-15T12:00:00Z").when(turn == 7, "soon").otherwise("2024-07-01").alias("expires"), on(6, "2024-06-16", "2024-06-01").alias("starts"),
        F.when(turn == 10, F.lit("2024-03-01").cast("timestamp")).when(turn != 12, now).alias("posted"),
    )
    return rows.select("id", checks.offer_problem(now).alias("problem"))


@query("""SELECT c_custkey AS id, CASE WHEN t = 0 THEN lower(n_name) WHEN t = 3 THEN lower(n_name) END AS district, CASE WHEN t IN (0, 1, 3) THEN replace(lower(r_name), ' ', '_') END AS county,
  CASE WHEN t IN (2, 5) THEN 'not recognised' WHEN t = 4 THEN 'not named in the text' END AS problem FROM (SELECT c_custkey, c_custkey % 6 AS t, c_nationkey FROM customer) JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def places_of_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """District and county of news by a gazetteer and its aliases, only where the text names them."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    pairs = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    slug = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("_"))
    districts = pairs.select(slug("n_name").alias("district"), slug("r_name").alias("county"), F.lit("england").alias("nation"))
    aliases = nation.select(F.concat(F.lit("greater_"), slug("n_name")).alias("alias"), slug("n_name").alias("name"))
    rows = read(spark, sf_dir, "customer").join(pairs, F.col("c_nationkey") == F.col("n_nationkey"))
    turn = F.col("c_custkey") % 6
    locality = F.when(turn.isin(0, 4, 5), F.concat("n_name", F.lit(" City Council"))).when(turn == 2, "Nowhere on Sea").when(turn == 3, F.concat(F.lit("Greater "), "n_name"))
    area = F.when(turn == 1, F.concat("r_name", F.lit(" County Council"))).when(turn == 2, F.col("r_name"))
    title = F.when(turn == 1, F.concat(F.lit("Parks of "), "r_name", F.lit(" reopen"))).when(turn == 3, F.concat(F.lit("New pool in Greater "), "n_name")).when(turn == 4, "A pool opens").otherwise(F.concat("n_name", F.lit(": a pool opens")))
    answers = rows.select(F.col("c_custkey").alias("id"), F.when(turn == 5, "wales").otherwise("england").alias("nation"), locality.alias("locality"), area.alias("admin_area"), title.alias("title"))
    return checks.local_places(answers, districts, aliases)


CATEGORY_RULES = [("fasteners", r"\bbolts?\b"), ("gears", r"\bgears?\b"), ("rings", r"\brings?\b"), ("red", r"\bred\b")]


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'stored gears' WHEN p_name LIKE '%bolt%' THEN 'fasteners' WHEN p_name LIKE '%gear%' THEN 'gears' WHEN p_name LIKE '%ring%' THEN 'rings' WHEN regexp_matches(p_name, '(^| )red( |$)') THEN 'red'
  WHEN p_size % 5 = 1 THEN 'rings' WHEN p_size % 5 = 2 THEN 'fasteners' ELSE 'family' END AS category FROM part""")
def first_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category of a stored name, else of the first rule for the title, else for the description."""
    turn = F.col("p_size") % 5
    text = F.when(turn == 1, "Rings and red ones").when(turn == 2, "A BOLT with a ring")
    stored = F.when(turn == 0, "old gears").when(turn == 3, "unmapped")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), checks.category(F.col("p_name"), text, stored, CATEGORY_RULES, {"old gears": "stored gears"}, "family").alias("category"))


@query("""SELECT filter, count(*)::BIGINT AS n, count(*) FILTER (WHERE NOT id % 23 = 0 AND id % 6 >= 3 AND id % 4 <> 0)::BIGINT AS n_shown FROM (
  SELECT doc_id AS id, unnest(list_filter(['all', CASE WHEN doc_id % 23 = 0 THEN 'hidden' END, CASE WHEN doc_id % 4 = 0 THEN 'duplicates' END, CASE WHEN doc_id % 6 < 3 THEN 'low-relevance' END, CASE WHEN doc_id % 9 < 2 THEN 'missing-link' END], lambda x: x IS NOT NULL)) AS filter
  FROM documents) GROUP BY 1""")
def editor_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the editor's filters find, and how much of it is public."""
    key = F.col("id")
    items = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).withColumns({
        "hidden": key % 23 == 0, "is_primary": key % 4 != 0, "relevance": (key % 6).cast("int"), "url": F.when(key % 9 == 0, "").when(key % 9 != 1, "https://example.org/"),
    })
    return checks.editor_evidence(items, items.where("NOT hidden AND relevance >= 3 AND is_primary"))


@query("""SELECT page_id AS id, (page_id % 4)::INT AS "at", CASE WHEN page_id % 3 = 0 THEN 'https://example.org/' || page_id ELSE url END AS url, page_id % 3 = 0 AS resolved FROM (SELECT page_id, 'https://news.example.net/' || page_id AS url FROM pages)""")
def unwrapped_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of wrapped links; without one, or with one that carries credentials, the wrapped one stays."""
    rows = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), (F.col("page_id") % 4).cast("int").alias("at"), F.concat(F.lit("https://news.example.net/"), "page_id").alias("url"))
    target = F.when(F.col("id") % 3 == 1, F.concat(F.lit("https://user:pw@example.org/"), "id")).otherwise(F.concat(F.lit("https://example.org/"), "id"))
    return checks.resolved_links(rows, rows.where("id % 3 < 2").select("url", target.alias("target")))


@query("SELECT id % 2 = 0 OR id % 3 = 0 AS kept, count(*)::BIGINT AS n FROM listings GROUP BY 1", LISTINGS)
def committed_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many staged rows count, as their key was stored, and how many are to be read again."""
    rows = listings(spark, sf_dir).select("id")
    kept, discarded = checks.committed(rows, rows.where("id % 2 = 0").unionByName(rows.where("id % 3 = 0")), "id")
    return kept.withColumn("kept", F.lit(True)).unionByName(discarded.withColumn("kept", F.lit(False))).groupBy("kept").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, CASE WHEN id % 4 = 0 THEN 'moved' ELSE category END AS category, CASE WHEN id % 4 = 0 THEN 'patched' WHEN id % 4 = 1 THEN 'conflict' ELSE 'kept' END AS outcome FROM venues", VENUES)
def patched_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot with a staged patch; rows that changed since the patch was made are conflicts."""
    rows = venues(spark, sf_dir).select("id", "category")
    before = F.when(F.col("id") % 4 == 0, F.col("category")).otherwise("other")
    return checks.patched(rows, rows.where("id % 4 < 2").select("id", before.alias("before"), F.lit("moved").alias("after")), "id", "category")


@query("SELECT council AS source, council % 5 NOT IN (1, 2) AS complete, CASE council % 5 WHEN 1 THEN 'missing_page' WHEN 2 THEN 'repeated_page' END AS reason FROM (SELECT DISTINCT council FROM venues)", VENUES)
def scan_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which paged scans are whole: none of four pages missing, none like another."""
    sources = venues(spark, sf_dir).select(F.col("council").alias("source")).distinct().select("source", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("page"))
    rows = sources.where("NOT (source % 5 = 1 AND page = 4)").withColumns({"pages": F.lit(4), "signature": F.sha1(F.concat_ws(":", "source", F.when((F.col("source") % 5 == 2) & (F.col("page") == 4), 3).otherwise(F.col("page"))))})
    return complete_pages(rows)


@query("""SELECT merchant, place, 'Offer ' || id || ' & more' AS title, 'https://shop.example.com/' || id AS link, 'Mon, 01 Jan 2024' AS published, 'Was £' || size AS summary FROM (
  SELECT p_partkey AS id, p_partkey // 40 AS merchant, p_size AS size, (row_number() OVER (PARTITION BY p_partkey // 40 ORDER BY p_partkey))::INT - 1 AS place FROM part) WHERE place < 30""")
def syndicated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thirty items of each feed; every second feed is Atom, one in seven is followed by text that is no feed."""
    key = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select(key.alias("id"), F.floor(key / 40).alias("merchant"), F.col("p_size").alias("size"))
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else F.col(p[0]).cast("string") for p in parts))
    title = say("<title>Offer ", ("id",), " &amp; more</title>")
    rss = F.concat(F.lit("<item>"), title, say("<link>https://shop.example.com/", ("id",), "</link><pubDate>Mon, 01 Jan 2024</pubDate><description>Was £", ("size",), "</description></item>"))
    atom = F.concat(F.lit("<entry>"), title, say('<link href="https://shop.example.com/', ("id",), '"/><updated>Mon, 01 Jan 2024</updated><summary>Was £', ("size",), "</summary></entry>"))
    even = F.col("merchant") % 2 == 0
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", F.when(even, rss).otherwise(atom).alias("x")))), lambda s: s["x"]), "")
    feeds = rows.groupBy("merchant").agg(items.alias("items"))
    xml = F.when(F.col("merchant") % 2 == 0, F.concat(F.lit("<rss><channel>"), "items", F.lit("</channel></rss>"))).otherwise(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), "items", F.lit("</feed>")))
    broken = feeds.where("merchant % 7 = 0").select((-1 - F.col("merchant")).alias("merchant"), F.lit("<rss><channel>").alias("xml"))
    return documents.read_feeds(feeds.select("merchant", xml.alias("xml")).unionByName(broken), "merchant", "xml")


@query("""SELECT id, 'Listing ' || id || ', indoors' AS summary, strftime(start, '%Y-%m-%d') || 'T10:30' AS start, CASE WHEN "end" IS NOT NULL THEN strftime("end", '%Y-%m-%d') || 'T12:00' END AS "end", 'Hall ' || venue_id AS place FROM listings WHERE id % 5 > 1""", LISTINGS)
def calendar_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendars with one timed event; recurring and all-day ones are left out."""
    rows = listings(spark, sf_dir)
    day = lambda c: F.date_format(c, "yyyyMMdd")
    lines = [
        F.lit("BEGIN:VCALENDAR"), F.lit("BEGIN:VEVENT"), F.concat(F.lit("SUMMARY:Listing "), "id", F.lit("\\, in\n doors")), F.when(F.col("id") % 5 == 0, "RRULE:FREQ=WEEKLY"),
        F.when(F.col("id") % 5 == 1, F.concat(F.lit("DTSTART;VALUE=DATE:"), day("start"))).otherwise(F.concat(F.lit("DTSTART:"), day("start"), F.lit("T103000Z"))), F.concat(F.lit("DTEND:"), day("end"), F.lit("T120000Z")),
        F.concat(F.lit("LOCATION:Hall "), "venue_id"), F.lit("END:VEVENT"), F.lit("END:VCALENDAR"),
    ]
    return documents.read_calendars(rows.select("id", F.concat_ws("\n", *lines).alias("ics")), "id", "ics")


@query("SELECT status AS source, count(*)::BIGINT AS found, 2::BIGINT AS runs FROM listings GROUP BY 1", LISTINGS)
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs append a row a source to a log; the log's last count of each source and how many runs it has."""
    path = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    rows = listings(spark, sf_dir)
    for run, part in enumerate((rows.where("id % 2 = 0"), rows)):
        part.groupBy(F.col("status").alias("source")).agg(F.count(F.lit(1)).alias("found")).withColumn("run", F.lit(run)).write.mode("append").json(path)
    log = spark.read.schema("source string, found bigint, run int").json(path)
    return log.groupBy("source").agg(F.max_by("found", "run").alias("found"), F.count(F.lit(1)).alias("runs"))
