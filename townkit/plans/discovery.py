"""Queries over discovered places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townkit.operators import cron, dependents, discovery, growth, likeness, nearest
from townkit.plans.registry import query
from townkit.sources import frames, listing_rows
from townkit.sources.tables import LISTINGS, VENUES, listings, read, venues

KM = "12742.0::DOUBLE * asin(sqrt(greatest(0.0, least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))))"


@query(f"""SELECT a.id AS point, min_by(b.id, (round({KM}, 6), b.id)) AS target, min(round({KM}, 6)) AS km FROM venues a JOIN venues b ON NOT a.visible AND b.visible GROUP BY a.id""", VENUES)
def nearest_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest visible venue of each hidden one."""
    rows = venues(spark, sf_dir)
    return nearest.nearest_join(rows.where("NOT visible").select(F.col("id").alias("point"), "lat", "lng"), rows.where("visible").select(F.col("id").alias("target"), "lat", "lng"))


SPOTS = """spots AS (SELECT id AS spot, lat, lng, CASE WHEN council = 7 THEN 'N07' ELSE 'E' || council END AS council, CASE WHEN free THEN NULL WHEN id % 7 = 0 THEN lower(replace(postcode, ' ', '')) WHEN id % 11 = 0 THEN 'ZZ1 1ZZ' ELSE postcode END AS tagged FROM venues)"""
KNOWN = """known AS (SELECT postcode, min_by(lat, id) AS lat, min_by(lng, id) AS lng, 'E' || min(council) AS district FROM venues WHERE visible AND fee > 2000 GROUP BY postcode)"""


@query(f""", near AS (SELECT a.spot, min_by(b.postcode, (round({KM}, 6), b.postcode)) AS code, min(round({KM}, 6)) AS km FROM spots a JOIN known b ON a.tagged IS NULL AND NOT starts_with(a.council, 'N') GROUP BY a.spot HAVING min(round({KM}, 6)) <= 40),
  tags AS (SELECT spot, council, regexp_replace(upper(regexp_replace(tagged, '\\s+', '', 'g')), '(.{{3}})$', ' \\1') AS tag FROM spots),
  met AS (SELECT spot, council, tag, code, km, district FROM tags LEFT JOIN near USING (spot) LEFT JOIN known k ON NOT starts_with(council, 'N') AND k.postcode = coalesce(tag, code))
  SELECT spot, coalesce(tag, code) AS postcode, CASE WHEN tag IS NOT NULL THEN 'osm_tag' WHEN code IS NOT NULL THEN 'reverse_nearest' END AS postcode_source,
  CASE WHEN starts_with(council, 'N') THEN 'not_applicable_ni' WHEN district IS NULL THEN 'unavailable' WHEN district <> council THEN 'postcode_other_council' ELSE 'postcode_in_council' END AS council_check,
  CASE WHEN NOT starts_with(council, 'N') AND district = council THEN 'Town ' || district END AS town, tag AS stored_postcode, CASE WHEN tag IS NULL THEN km END AS km FROM met""", VENUES, SPOTS, KNOWN)
def postcode_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postcode of every venue, stated (some written otherwise, some unknown) or nearest within 40 km, against its council."""
    rows = venues(spark, sf_dir)
    stated = F.when(F.col("free"), None).when(F.col("id") % 7 == 0, F.lower(F.regexp_replace("postcode", " ", ""))).when(F.col("id") % 11 == 0, "ZZ1 1ZZ").otherwise(F.col("postcode"))
    spots = rows.select(F.col("id").alias("spot"), "lat", "lng", F.when(F.col("council") == 7, "N07").otherwise(F.concat(F.lit("E"), "council")).alias("council"), stated.alias("tagged"))
    known = rows.where("visible AND fee > 2000").groupBy("postcode").agg(F.min_by(F.struct("lat", "lng"), "id").alias("at"), F.concat(F.lit("E"), F.min("council")).alias("district"))
    known = known.select("postcode", "at.lat", "at.lng", "district", F.concat(F.lit("Town "), "district").alias("town"))
    return discovery.resolve_postcodes(spots, known, 40.0)


def council_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every venue as a spot of its council: on a coarse grid, so that places of several councils lie together; some with an outline or an element."""
    rows = venues(spark, sf_dir)
    lat, lng = F.round(F.floor(F.col("lat") * 4) / 4 + (F.col("id") % 3) * 0.0006, 6), F.round(F.floor(F.col("lng") * 4) / 4, 6)
    spots = rows.select(F.col("id").alias("spot"), F.col("council").cast("int").alias("turn"), F.concat("name", F.when(F.col("id") % 4 == 0, " Ltd").otherwise("")).alias("name"), lat.alias("lat"), lng.alias("lng"), "postcode", "id")
    wide = F.col("id") % 5 == 0
    for name, side in (("south", F.col("lat") - 0.004), ("north", F.col("lat") + 0.004), ("west", F.col("lng") - 0.004), ("east", F.col("lng") + 0.004)):
        spots = spots.withColumn(name, F.when(wide, side))
    spots = spots.withColumn("osm", F.concat(F.lit("node/"), F.col("id") % 211)).withColumn("tagged", F.when(F.col("id") % 3 != 0, F.col("postcode")))
    return spots.select("spot", "turn", "name", "lat", "lng", "south", "north", "west", "east", F.when(F.col("id") % 10 == 7, F.col("osm")).alias("osm"), "tagged", "postcode", (wide & (F.col("id") % 15 == 0)).alias("elsewhere"))


def council_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return venues(spark, sf_dir).where("id % 6 = 1").select(F.col("id").alias("place"), F.regexp_replace("name", "#0000", "#").alias("name"), "lat", "lng", "postcode", F.when(F.col("id") % 4 == 3, F.concat(F.lit("node/"), F.col("id") % 211)).alias("osm"))


@query()
def council_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every venue as a discovered spot: what is stored, what an earlier council added, what is new."""
    return growth.discover(council_spots(spark, sf_dir), council_stored(spark, sf_dir))


@query("""WITH_ALL, keys AS (SELECT DISTINCT name FROM stored_or_new WHERE id IS NULL), fresh AS (SELECT name, (SELECT max(id) + 1 FROM venues WHERE id % 3 = 0) + row_number() OVER (ORDER BY name) - 1 AS id FROM keys)
  SELECT l AS listing, coalesce(s.id, f.id) AS venue_id, s.id IS NULL AS is_new FROM stored_or_new s LEFT JOIN fresh f USING (name)""".replace("WITH_ALL", """,
  stored_or_new AS (SELECT l.id AS l, v.name, CASE WHEN v.id % 3 = 0 THEN v.id END AS id FROM listings l JOIN venues v ON v.id = l.venue_id)"""), VENUES, LISTINGS)
def listings_with_new_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing with the id of its venue: a third of the venues is stored, the others get ids when their listings are loaded."""
    places = venues(spark, sf_dir).select(F.col("id").alias("venue_id"), "name", "category")
    stored = places.where("venue_id % 3 = 0").withColumnRenamed("venue_id", "id")
    arriving = listings(spark, sf_dir).select(F.col("id").alias("listing"), "venue_id", F.col("start")).join(places, "venue_id")
    _, ids = dependents.upsert_returning(stored, arriving.select("name", "category", F.col("listing").alias("at")), "name", "id", "at")
    known = stored.select(F.col("id").alias("venue_id"), F.lit(False).alias("is_new"))
    linked = dependents.with_ids(arriving.select("name", "listing"), ids, "name").select("listing", F.col("id").alias("venue_id"))
    return linked.join(known, "venue_id", "left").select("listing", "venue_id", F.coalesce("is_new", F.lit(True)).alias("is_new"))


@query("""WITH records AS (SELECT l_orderkey AS batch, l_linenumber AS line, CASE WHEN l_quantity < 2 THEN 'small' WHEN l_discount > 0.09 THEN 'discount' END AS problem FROM lineitem),
  report AS (SELECT o_orderkey AS batch, count(line)::BIGINT AS records, count(problem)::BIGINT AS bad, min(problem) AS first_problem, CASE WHEN o_orderkey % 10 = 0 THEN 3 WHEN o_orderstatus = 'F' THEN NULL ELSE count(line) END::BIGINT AS expected FROM orders LEFT JOIN records ON batch = o_orderkey GROUP BY o_orderkey, o_orderstatus)
  SELECT *, bad = 0 AND coalesce(expected, records) = records AS published FROM report""")
def published_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as batches of lines: one bad line, or another number of lines than stated, withholds the order."""
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    problem = F.when(F.col("l_quantity") < 2, "small").when(F.col("l_discount") > 0.09, "discount")
    records = lines.select(F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("line"), problem.alias("problem"))
    n = records.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").join(n, F.col("o_orderkey") == F.col("batch"), "left")
    expected = F.when(F.col("o_orderkey") % 10 == 0, 3).when(F.col("o_orderstatus") == "F", None).otherwise(F.coalesce("n", F.lit(0))).cast("long")
    return dependents.whole_batches(records, "batch", "problem", orders.select(F.col("o_orderkey").alias("batch"), expected.alias("expected")))[1]


#: Weekdays 1-5 from the first, every second day from the second kind of schedule, Sundays and firsts of months from the third.
CRON_SQL = """SELECT s_suppkey AS workflow, s_suppkey % 60 AS m, s_suppkey % 24 AS h, s_suppkey % 3 AS kind FROM supplier"""


@query(f"""SELECT workflow, month(slot)::INT AS month, count(*)::BIGINT AS n, min(slot) AS first, max(slot) AS last FROM (SELECT workflow, CASE WHEN local >= TIMESTAMP '2024-03-31 02:00' AND local < TIMESTAMP '2024-10-27 02:00' THEN local - INTERVAL 1 HOUR ELSE local END AS slot FROM
  (SELECT workflow, d + to_hours(hh) + to_minutes(m) AS local FROM (SELECT *, unnest([h, (h + 11) % 24]) AS hh FROM ({CRON_SQL})), generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-12-31', INTERVAL 1 DAY) AS t(d)
   WHERE CASE kind WHEN 0 THEN isodow(d) <= 5 WHEN 1 THEN day(d) % 2 = 1 ELSE day(d) = 1 OR isodow(d) = 7 END)) GROUP BY ALL""")
def cron_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slots of every supplier's schedule over a year of London time, by month (UTC)."""
    key = F.col("s_suppkey")
    day, weekday = (F.element_at(F.array(*map(F.lit, v)), (key % 3 + 1).cast("int")) for v in (("*", "*/2", "1"), ("1-5", "*", "7")))
    schedules = read(spark, sf_dir, "supplier", "s_suppkey").select(key.alias("workflow"), F.concat_ws(" ", key % 60, F.concat_ws(",", key % 24, (key % 24 + 11) % 24), day, F.lit("*"), weekday).alias("cron"), F.lit("Europe/London").alias("zone"))
    found = cron.slots(schedules, "2024-01-01", "2024-12-31")
    return found.groupBy("workflow", F.month("slot").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.min("slot").alias("first"), F.max("slot").alias("last"))


@query("""WITH slots AS (SELECT 'w' || w AS workflow, d + to_hours(h) AS slot FROM (SELECT DISTINCT user_id % 20 AS w FROM events), generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) AS t(d), (VALUES (0), (6), (12), (18)) AS u(h) WHERE w % 2 = 0 OR h <> 6),
  runs AS (SELECT 'w' || user_id % 20 AS workflow, event_id, ts AS created, CASE WHEN value >= 5 THEN ts + to_minutes(floor(value * 3)::BIGINT) END AS finished, event_type <> 'error' AS ok FROM events WHERE event_id % 7 = 0),
  met AS (SELECT s.workflow, slot, r.* EXCLUDE (workflow) FROM (SELECT *, lead(slot) OVER (PARTITION BY workflow ORDER BY slot) AS until FROM slots) s LEFT JOIN runs r ON r.workflow = s.workflow AND created >= slot AND (until IS NULL OR created < until) QUALIFY row_number() OVER (PARTITION BY s.workflow, slot ORDER BY created, event_id::VARCHAR) = 1)
  SELECT workflow, slot, event_id::VARCHAR AS run, round(date_sub('second', slot, created) / 60, 2) AS dispatch_minutes, CASE WHEN slot > TIMESTAMP '2024-01-25' THEN 'future' WHEN event_id IS NULL THEN CASE WHEN date_diff('second', slot, TIMESTAMP '2024-01-25') / 60 > 60 THEN 'missing' ELSE 'pending' END
    WHEN finished IS NULL THEN 'incomplete' WHEN NOT ok THEN 'failed' WHEN date_sub('second', slot, created) / 60 > 60 OR date_sub('second', slot, finished) / 60 > 240 THEN 'late' ELSE 'success' END AS state FROM met""")
def slot_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ran for each slot of twenty workflows in a month: every seventh event is a run."""
    rows = read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    name = F.concat(F.lit("w"), F.col("user_id") % 20)
    hours = F.when(F.col("user_id") % 2 == 0, "0 */6 * * *").otherwise("0 0,12-18/6 * * *")
    schedules = rows.select(name.alias("workflow"), hours.alias("cron"), F.lit("UTC").alias("zone")).distinct()
    done = F.when(F.col("value") >= 5, F.col("ts") + F.make_dt_interval(mins=F.floor(F.col("value") * 3).cast("int")))
    runs = rows.where("event_id % 7 = 0").select(name.alias("workflow"), F.col("event_id").alias("run"), F.col("ts").alias("created"), done.alias("finished"), (F.col("event_type") != "error").alias("ok"))
    return cron.ledger(cron.slots(schedules, "2024-01-01", "2024-01-31"), runs, F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"))


FIRST_SENTENCE = r"[^.\n]*"


@query(r"""WITH titles AS (SELECT DISTINCT trim(regexp_replace(lower(regexp_extract(coalesce(text, ''), '^[^.\n]*')), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents), items AS (SELECT DISTINCT trim(regexp_replace(lower(regexp_extract(coalesce(text, ''), '^[^.\n]*')), '[^a-z0-9]+', ' ', 'g')) AS t FROM benchmark)
  SELECT a.t AS "inner", b.t AS "outer" FROM titles a JOIN items b ON length(a.t) >= 6 AND a.t <> b.t AND contains(b.t, a.t) UNION ALL SELECT b.t, a.t FROM titles a JOIN items b ON length(b.t) >= 6 AND a.t <> b.t AND contains(a.t, b.t)""")
def titles_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sentences of documents that stand within those of benchmark items, and the other way round."""
    title = lambda name: read(spark, sf_dir, name, "text").select(F.trim(F.regexp_replace(F.lower(F.regexp_extract(F.coalesce("text", F.lit("")), "^" + FIRST_SENTENCE, 0)), "[^a-z0-9]+", " ")).alias("name")).distinct()
    a, b = title("documents"), title("benchmark")
    return likeness.within(a, b).unionByName(likeness.within(b, a))


@query(r"""SELECT page_id AS page, k::BIGINT AS place, t AS description, CASE WHEN k = 1 THEN '$9' END AS requirements FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages WHERE page_id % 5 <> 0), (VALUES (0), (1)) AS v(k)""")
def framed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that every page pushes as framed data, their texts resolved; of five pages one breaks off and gives none."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    records = F.lit('1:{"x":[{"isEvents":true,"source":[{"description":"$a"},{"description":"$b","requirements":"$9"}]}]}\n')
    data = F.concat(F.lit("a:T"), F.lower(F.hex(F.octet_length(title))), F.lit(","), title, F.lit("b:T2,$a"), records)
    data = F.when(F.col("page_id") % 5 == 0, F.regexp_replace(data, r".{20}\n$", "")).otherwise(data)
    pushed = F.concat("html", F.lit("<script>self.__next_f.push("), F.to_json(F.array(F.lit("1"), data)), F.lit(")</script>"))
    found, _ = frames.published_records(read(spark, sf_dir, "pages", "page_id", "html").select("page_id", pushed.alias("html")))
    return found.select("page", "place", "description", "requirements")


@query()
def listing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table rows or cards of every page that may be listings."""
    return listing_rows.read_lines(read(spark, sf_dir, "pages", "page_id", "url", "html"))
