"""Queries over what collectors read: map responses, session feeds, catalogues, ages, countries, beacons, previews, publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townkit.operators import collect
from townkit.operators.stages import shared_dir
from townkit.plans.registry import query
from townkit.sources.adapters import read_csv
from townkit.sources.tables import LISTINGS, VENUES, listings, read, venues

@query("""SELECT CASE id % 4 WHEN 1 THEN 'node' WHEN 2 THEN 'way' ELSE 'relation' END AS osm_type, id AS osm_id, name, ['Museum', 'Farm', 'Castle', 'Attraction', 'Nature reserve'][(id % 5 + 1)::INT] AS category,
  [5, 5, 3, 3, 3][(id % 5 + 1)::INT]::INT AS weight, round(lat, 2) AS lat, round(lng, 2) AS lng FROM venues WHERE id % 4 <> 0 AND NOT (id % 3 = 2 AND id % 5 = 0) AND id % 13 <> 0 AND id % 17 <> 0 AND (id % 5 NOT IN (2, 3) OR id % 7 < 3)
  AND NOT (id % 5 = 3 AND id % 11 = 0)""", VENUES)
def spots_of_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places out of map responses of fifty elements each: areas, generic names, private ones and castles and attractions without a site are left out."""
    kinds = F.expr("element_at(array('tourism', 'tourism', 'historic', 'tourism', 'leisure'), cast(id % 5 AS int) + 1)")
    values = F.expr("element_at(array('museum', 'zoo', 'castle', 'attraction', 'nature_reserve'), cast(id % 5 AS int) + 1)")
    pair = lambda wanted, k, v: F.when(wanted, F.map_from_arrays(F.array(F.lit(k)), F.array(F.lit(v)))).otherwise(F.expr("cast(map() AS map<string,string>)"))
    rows = venues(spark, sf_dir).withColumn("tags", F.map_concat(
        F.create_map(kinds, values), F.create_map(F.lit("name"), F.when(F.col("id") % 13 == 0, "The Play Area").otherwise(F.concat(F.lit(" "), F.col("name")))),
        pair(F.col("id") % 17 == 0, "access", "private"), pair(F.col("id") % 5 == 1, "zoo", "petting_zoo"), pair(F.col("id") % 7 < 3, "website", "https://example.org/"), pair((F.col("id") % 5 == 3) & (F.col("id") % 11 == 0), "attraction", "carousel"),
    ))
    kind = F.expr("element_at(array('area', 'node', 'way', 'relation'), cast(id % 4 AS int) + 1)")
    point = lambda on: F.when(on, F.struct("lat", F.col("lng").alias("lon")))
    bounds = F.struct((F.col("lat") - 0.5).alias("minlat"), (F.col("lng") - 0.25).alias("minlon"), (F.col("lat") + 0.5).alias("maxlat"), (F.col("lng") + 0.25).alias("maxlon"))
    turn = F.col("id") % 3
    element = F.struct(
        kind.alias("type"), "id", F.when(turn == 0, F.col("lat")).alias("lat"), F.when(turn == 0, F.col("lng")).alias("lon"), point(turn == 1).alias("center"), F.when((turn == 2) & (F.col("id") % 5 != 0), bounds).alias("bounds"), "tags"
    )
    responses = rows.groupBy(F.floor(F.col("id") / 50)).agg(F.to_json(F.struct(F.collect_list(element).alias("elements"))).alias("json"))
    found = collect.spots(responses)
    return found.withColumns({"lat": F.round("lat", 2), "lng": F.round("lng", 2)})


#: Ages in words, and what they say: state, least, most.
AGES = [
    ("3-5 years", "eligible", 3.0, 5.0), ("18 months to 4 years", "eligible", 1.5, 4.0), ("26 weeks - 52 weeks", "eligible", 0.5, 1.0), ("2½+", "eligible", 2.5, None), ("aged 8+ years", "outside", 8.0, None), ("under 5s", "eligible", None, None),
    ("up to 6 months", "eligible", None, None), ("Babies and toddlers", "eligible", None, None), ("Year 3", "unknown", None, None), ("5-3", "unknown", None, None), ("room 12", "unknown", None, None), ("", "unknown", None, None), (None, "unknown", None, None), ("7–11", "outside", 7.0, 11.0),
]
AGES_SQL = ", ".join(f"({k}, {'NULL' if a is None else repr(a)}, '{s}', {'NULL' if x is None else x}::DOUBLE, {'NULL' if y is None else y}::DOUBLE)" for k, (a, s, x, y) in enumerate(AGES))


def with_ages(rows: DataFrame, column: str = "age") -> DataFrame:
    words = F.array(*(F.lit(a) for a, *_ in AGES))
    return rows.withColumn(column, F.get(words, (F.col("id") % len(AGES)).cast("int")))


@query(f"SELECT l.id, state, least, most FROM listings l JOIN (VALUES {AGES_SQL}) a(k, words, state, least, most) ON l.id % {len(AGES)} = k", LISTINGS)
def age_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each listing's words say of ages."""
    rows = with_ages(listings(spark, sf_dir).select("id"))
    return rows.select("id", collect.age_evidence(F.col("age")).alias("e")).select("id", "e.*")


@query("""SELECT id, CASE WHEN id % 7 = 0 THEN 'missing_postcode' WHEN id % 7 = 1 THEN 'postcode_not_found' WHEN id % 7 = 2 THEN 'postcode_response_mismatch' WHEN id % 7 = 3 OR (id % 7 = 4 AND id % 2 = 1) THEN 'unsupported_or_conflicting_country'
  WHEN id % 7 = 5 THEN 'source_authority_country_conflict' ELSE 'exact_postcode_and_geography' END AS reason, CASE WHEN id % 7 = 6 OR (id % 7 = 4 AND id % 2 = 0) THEN CASE WHEN council % 2 = 0 THEN 'England' ELSE 'Scotland' END END AS country FROM venues""", VENUES)
def countries_with_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The country of each venue's postcode by a lookup's answer; what is unknown keeps its reason."""
    rows = venues(spark, sf_dir).select("id", "postcode", "council")
    turn, even = F.col("id") % 7, F.col("council") % 2 == 0
    asked = F.when(turn != 0, F.lower(F.replace("postcode", F.lit(" "), F.lit(""))))
    answers = venues(spark, sf_dir).where("id % 7 <> 1").select("id", F.when(F.col("id") % 7 == 2, "ZZ1 1ZZ").otherwise(F.col("postcode")).alias("found"))
    code = F.when(turn == 3, "X0600001").otherwise(F.when(even, "E06000001").otherwise("S12000033"))
    country = F.when((turn == 4) & (F.col("id") % 2 == 1), "Wales").otherwise(F.when(even, "England").otherwise("Scotland"))
    authority = F.when(turn == 5, "W06000015").when(turn == 6, "unknown")
    return rows.join(answers, "id", "left").select("id", collect.country_evidence(asked, F.col("found"), code, country, authority).alias("e")).select("id", "e.*")


@query("""SELECT id, CASE WHEN away IS NULL THEN 'unknown' WHEN away <= 150 THEN 'local' ELSE 'outside' END AS state, method, away AS distance_km FROM (
  SELECT id, method, CASE WHEN y IS NOT NULL THEN round(12742 * asin(sqrt(least(1.0, pow(sin(radians(y - 53.0) / 2), 2) + cos(radians(53.0)) * cos(radians(y)) * pow(sin(radians(x + 2.0) / 2), 2)))), 2) END AS away FROM (
  SELECT v.id, CASE WHEN v.id % 3 = 0 THEN 'feed_coordinates' WHEN c.y IS NOT NULL THEN 'postcode_centroid' END AS method, CASE WHEN v.id % 3 = 0 THEN v.lat ELSE c.y END AS y, CASE WHEN v.id % 3 = 0 THEN v.lng ELSE c.x END AS x
  FROM venues v LEFT JOIN (SELECT postcode, min(lat) AS y, min(lng) AS x FROM venues WHERE council % 2 = 0 GROUP BY 1) c ON c.postcode = v.postcode))""", VENUES)
def location_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local, outside or unknown: a venue's own point, else its postcode's; zero and missing points are none."""
    rows = venues(spark, sf_dir)
    centres = rows.where("council % 2 = 0").groupBy("postcode").agg(F.min("lat").alias("centre_lat"), F.min("lng").alias("centre_lng"))
    at = lambda c: F.when(F.col("id") % 3 == 0, F.col(c)).when(F.col("id") % 3 == 1, 0.0)
    found = collect.located(rows.select("id", "postcode", at("lat").alias("lat"), at("lng").alias("lng")), centres, 53.0, -2.0, 150)
    return found.select("id", "state", "method", "distance_km")


def session_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, json: a feed item for each listing; sessions (even ids) leave name, age, place and price to the series of their venue."""
    rows = with_ages(listings(spark, sf_dir))
    session, bare = F.col("id") % 2 == 0, F.col("id") % 10 == 5
    name = F.when(F.col("venue_id") % 9 == 0, "Soft play party").when(F.col("venue_id") % 9 == 1, "Gym 11-15").otherwise(F.concat(F.lit("Class "), F.col("venue_id")))
    place = F.struct(F.when(F.col("venue_id") % 8 != 0, F.concat(F.lit("Hall "), F.col("venue_id") % 40)).alias("name"), F.lit("M1 1AA").alias("postcode"))
    label = F.array(F.struct(F.when(F.col("venue_id") % 5 != 0, F.concat(F.lit("label "), F.col("venue_id") % 20)).alias("prefLabel")))
    price = F.array(F.struct(F.lit("Staff rate").alias("name"), F.lit("1").alias("price")), F.struct(F.lit("Child").alias("name"), (F.col("venue_id") % 12).cast("string").alias("price")))
    shared = [name.alias("name"), F.get(F.array(*(F.lit(a) for a, *_ in AGES)), (F.col("venue_id") % len(AGES)).cast("int")).alias("ageRange"), place.alias("location"), label.alias("activity"), price.alias("offers")]
    parent = F.struct(F.concat(F.lit("s"), F.col("venue_id")).alias("@id"), *shared, F.lit("https://example.org/series").alias("url"))
    status = F.when(F.col("id") % 11 == 0, "https://schema.org/EventCancelled")
    link = F.when(F.col("id") % 6 != 3, F.col("url"))
    of_series = F.to_json(F.struct(F.lit("ScheduledSession").alias("@type"), F.col("id").cast("string").alias("@id"), status.alias("eventStatus"), parent.alias("superEvent")))
    alone = F.to_json(F.struct(F.lit("Event").alias("@type"), F.when(~bare, F.concat(F.lit("e"), F.col("id"))).alias("@id"), status.alias("eventStatus"), *shared, link.alias("url")))
    return rows.select(F.col("id").alias("item"), F.when(session, of_series).otherwise(alone).alias("json"))


NAME = "CASE WHEN venue_id % 9 = 0 THEN 'Soft play party' WHEN venue_id % 9 = 1 THEN 'Gym 11-15' ELSE 'Class ' || venue_id END"
PLACE = "CASE WHEN venue_id % 8 <> 0 THEN 'Hall ' || (venue_id % 40) END"
SERIES = f"CASE WHEN id % 2 = 0 THEN 's' || venue_id WHEN id % 10 = 5 THEN concat_ws('|', 'untitled', {NAME}, {PLACE}) ELSE 'e' || id END"
SKIP = f"""CASE WHEN id % 11 = 0 THEN 'cancelled' WHEN state <> 'eligible' THEN 'age_' || state WHEN id % 2 = 1 AND id % 6 = 3 THEN 'missing_url' WHEN venue_id % 8 = 0 THEN 'missing_name_or_place'
  WHEN venue_id % 9 = 0 THEN 'private_hire' WHEN venue_id % 9 = 1 THEN 'age_name_outside' END"""
AGED = f"listings l JOIN (VALUES {AGES_SQL}) a(k, words, state, least, most) ON l.venue_id % {len(AGES)} = k"


@query(f"SELECT id AS item, {SERIES} AS series_id, CASE WHEN id % 2 = 0 THEN 'ScheduledSession' ELSE 'Event' END AS type, {NAME} AS name, {PLACE} AS place, CASE WHEN id % 11 = 0 THEN 'EventCancelled' END AS status, CASE WHEN venue_id % 5 <> 0 THEN 1 ELSE 0 END::INT AS n_labels, (venue_id % 12)::DOUBLE AS price FROM {AGED}", LISTINGS)
def flattened_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed items with what they inherit from their series."""
    rows = collect.opportunities(session_items(spark, sf_dir))
    return rows.select("item", "series_id", "type", "name", "place", "status", F.size("labels").alias("n_labels"), F.array_min("prices").alias("price"))


@query(f"SELECT coalesce({SKIP}, 'kept') AS reason, count(*)::BIGINT AS n, count(DISTINCT {SERIES})::BIGINT AS series FROM {AGED} GROUP BY 1", LISTINGS)
def series_or_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many feed items and series are kept, and why the others are not."""
    rows = collect.opportunities(session_items(spark, sf_dir))
    return rows.groupBy(F.coalesce(collect.skip_reason(), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("series_id").alias("series"))


@query(f"""SELECT label, count(*)::BIGINT AS n FROM (SELECT series, min_by(CASE WHEN venue_id % 5 <> 0 THEN 'label ' || (venue_id % 20) ELSE '(no activity label)' END, id) AS label, min_by(state, id) AS state
  FROM (SELECT *, {SERIES} AS series FROM {AGED}) GROUP BY 1) WHERE state = 'eligible' GROUP BY 1 ORDER BY n DESC, label LIMIT 15""", LISTINGS)
def survey_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen commonest labels of the series that are for young children, each series counted once by its first item."""
    rows = collect.opportunities(session_items(spark, sf_dir))
    first = rows.groupBy("series_id").agg(F.min_by(F.struct("age", "labels"), "item").alias("r")).select("r.*").where(collect.age_evidence(F.col("age"))["state"] == "eligible")
    labels = F.when(F.coalesce(F.size("labels"), F.lit(0)) > 0, F.col("labels")).otherwise(F.array(F.lit("(no activity label)")))
    return first.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(15)


@query("""SELECT s_suppkey AS dataset, type, 'https://feeds.example.org/' || s_suppkey || '/' || coalesce(type, 'all') AS url FROM supplier, (VALUES ('SessionSeries'), ('ScheduledSession'), ('CourseInstance'), (NULL)) t(type)
  WHERE (type = 'SessionSeries' AND s_suppkey % 3 <> 0) OR (type = 'ScheduledSession' AND s_suppkey % 3 = 0) OR (type = 'CourseInstance' AND s_suppkey % 2 = 0) OR (type IS NULL AND s_suppkey % 5 = 0)""")
def feeds_to_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feeds of each dataset, its sessions only where no series feed names them."""
    key = F.col("s_suppkey")
    feed = lambda kind, on: F.when(on, F.struct(F.lit(f"https://openactive.example.org/{kind}" if kind else None).cast("string").alias("additionalType"), F.concat(F.lit("https://feeds.example.org/"), key, F.lit(f"/{kind or 'all'}")).alias("contentUrl")))
    feeds = F.array(feed("SessionSeries", key % 3 != 0), feed("ScheduledSession", F.lit(True)), feed("CourseInstance", key % 2 == 0), feed(None, key % 5 == 0))
    json = F.to_json(F.struct(F.filter(feeds, lambda f: f.isNotNull()).alias("distribution")))
    return collect.walked_feeds(read(spark, sf_dir, "supplier").select(key.alias("dataset"), json.alias("json")))


@query("SELECT 'c' || s_nationkey AS catalogue, 'd' || s_suppkey AS url, NULL::VARCHAR AS error FROM supplier WHERE s_nationkey % 6 <> 0 UNION ALL SELECT DISTINCT 'c' || s_nationkey, NULL, 'not read' FROM supplier WHERE s_nationkey % 6 = 0")
def datasets_of_catalogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The datasets of all catalogues of a collection; a catalogue that could not be read stays as an error."""
    rows = read(spark, sf_dir, "supplier").select(F.concat(F.lit("c"), "s_nationkey").alias("catalogue"), F.concat(F.lit("d"), "s_suppkey").alias("d"), "s_nationkey")
    collections = rows.select("catalogue").distinct().groupBy().agg(F.to_json(F.struct(F.collect_set("catalogue").alias("hasPart"))).alias("json"))
    catalogues = rows.where("s_nationkey % 6 <> 0").groupBy("catalogue").agg(F.to_json(F.struct(F.collect_list("d").alias("dataset"))).alias("json"))
    return collect.catalogue_datasets(collections, catalogues)


@query("""SELECT ['LCP', 'INP', 'CLS', 'FCP', 'TTFB'][(event_id % 6 + 1)::INT] AS metric, abs(value) AS value, CASE WHEN event_id % 4 <> 3 THEN ['good', 'needs-improvement', 'poor'][(event_id % 4 + 1)::INT] END AS rating, 'm' || event_id AS metric_id,
  CASE WHEN event_id % 7 = 0 THEN '/' ELSE '/venue/' || user_id END AS route, CASE WHEN event_id % 2 = 0 THEN 'mobile' ELSE 'desktop' END AS device
  FROM events WHERE event_id % 6 <> 5 AND event_id % 13 <> 0 AND event_id % 17 <> 0 AND (event_id % 6 <> 2 OR abs(value) <= 100)""")
def vitals_to_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beacons of visitors with a known metric, a possible value and a plain path."""
    key = F.col("event_id")
    pick = lambda n, *values: F.get(F.array(*map(F.lit, values)), (key % n).cast("int"))
    agent = F.when(key % 13 == 0, "ExampleBot/2.0").when(key % 2 == 0, "Mozilla/5.0 (iPhone)").otherwise("Mozilla/5.0 (X11)")
    route = F.when(key % 7 == 0, "/").otherwise(F.concat(F.lit("/venue/"), "user_id", F.lit("//")))
    route = F.when(key % 17 == 0, F.concat(route, F.lit("?q=1"))).otherwise(route)
    rows = read(spark, sf_dir, "events").select(
        pick(6, "LCP", "INP", "CLS", "FCP", "TTFB", "FID").alias("name"), F.abs("value").alias("value"), F.concat(F.lit("m"), key).alias("id"), pick(4, "good", "needs-improvement", "poor", "great").alias("rating"), route.alias("route"), agent.alias("agent")
    )
    return collect.vital_rows(rows)


PREVIEW = """p AS (SELECT id, trim(regexp_replace(regexp_replace(lower(title), '\\b(the|a|an)\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS title, venue_id, start, CASE WHEN id % 10 = 0 THEN 'camp stays an Event' WHEN id % 10 = 1 THEN 'seasonal/special listing stays an Event' WHEN id % 10 = 2 THEN 'stored recurrence=unknown' WHEN id % 10 = 3 THEN 'stored recurrence=one-off' ELSE 'stored recurrence=recurring' END AS reason FROM listings)"""


@query("""SELECT p.id, CASE WHEN reason = 'stored recurrence=recurring' THEN 'activity' ELSE 'event' END AS kind, reason, id % 10 = 0 AS is_camp, coalesce(n, 0)::BIGINT AS group_size,
  CASE WHEN reason <> 'stored recurrence=recurring' THEN 'keep as event' WHEN keep = p.id THEN 'keep as activity' ELSE 'merge into activity' END AS action, keep AS keep_id
  FROM p LEFT JOIN (SELECT title, venue_id, count(*) AS n, arg_max(id, (start, id)) AS keep FROM p WHERE reason = 'stored recurrence=recurring' GROUP BY 1, 2) g ON reason = 'stored recurrence=recurring' AND g.title = p.title AND g.venue_id = p.venue_id""", LISTINGS, PREVIEW)
def event_split_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which listings would become activities, and into which row of their group they would merge."""
    turn = F.col("id") % 10
    told = F.when(turn == 0, "With Camps.").when(turn == 1, "An Open Day")
    title = F.when(F.col("id") % 3 == 0, F.regexp_replace("title", "^The ", "")).otherwise(F.col("title"))
    recurrence = F.when(turn == 3, "one-off").when(turn != 2, "Recurring")
    rows = listings(spark, sf_dir).select("id", title.alias("title"), told.alias("description"), F.concat(F.lit("The Venue "), "venue_id").alias("venue"), recurrence.alias("recurrence"), F.col("start").alias("verified"))
    return collect.split_preview(rows)


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'new' WHEN page_id % 5 = 1 THEN 'changed' WHEN page_id % 10 > 7 THEN 'stale' ELSE 'unchanged' END AS decision FROM pages")
def pages_that_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages against their last reading: new, changed, read too long ago, or unchanged whatever their spacing."""
    rows = read(spark, sf_dir, "pages", "page_id", "html")
    day = F.lit("2024-01-31").cast("date")
    before = rows.where("page_id % 5 <> 0").select("page_id", F.when(F.col("page_id") % 5 == 1, F.concat("html", F.lit("!"))).otherwise(F.regexp_replace("html", "\n", " \n")).alias("html"), F.date_sub(day, (F.col("page_id") % 10).cast("int")).alias("read_on"))
    return collect.content_changes(before, rows.withColumn("read_on", day), "page_id", "html", "read_on")


@query("""SELECT id, CASE WHEN refused THEN CASE WHEN stored THEN was END ELSE wanted END AS visible, CASE WHEN refused THEN CASE WHEN stored THEN was_adult END ELSE adult END AS adult_only, CASE WHEN NOT guarded THEN 'not_applicable' WHEN adult THEN 'refused_adult_only' WHEN adult IS NULL THEN 'refused_undecided' ELSE 'allowed' END AS guard
  FROM (SELECT *, guarded AND coalesce(adult, true) AS refused FROM (SELECT *, category = 'FURNITURE' AND wanted AND NOT (stored AND was) AS guarded FROM (SELECT id, category, council % 3 <> 0 AS wanted, CASE WHEN free THEN true WHEN fee > 5000 THEN false END AS adult, id % 5 <> 0 AS stored, visible AND id % 2 = 0 AS was, free AS was_adult FROM venues)))""", VENUES)
def publication_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues of one category become visible only if they are known not to be for adults only; a fifth of the rows are not stored yet."""
    rows = venues(spark, sf_dir)
    adult = F.when(F.col("free"), True).when(F.col("fee") > 5000, False)
    current = rows.where("id % 5 <> 0").select("id", (F.col("visible") & (F.col("id") % 2 == 0)).alias("visible"), F.col("free").alias("adult_only"))
    return collect.guarded_publication(current, rows.select("id", "category", (F.col("council") % 3 != 0).alias("visible"), adult.alias("adult_only")), "FURNITURE")


@query("SELECT council AS release, id FROM venues WHERE id % 30 >= council % 10 AND (council % 4 = 0 OR id % 30 <= council % 10 + 12)", VENUES)
def sealed_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written while their release was open."""
    first = F.lit("2024-01-01").cast("date")
    rows = venues(spark, sf_dir).select(F.col("council").alias("release"), "id", F.date_add(first, (F.col("id") % 30).cast("int")).alias("written"))
    opened = F.date_add(first, (F.col("release") % 10).cast("int"))
    releases = rows.select("release").distinct().select("release", opened.alias("opened"), F.when(F.col("release") % 4 != 0, F.date_add(opened, 12)).alias("sealed"))
    return collect.release_rows(rows, releases)


@query("SELECT row_number() OVER (ORDER BY (n_nationkey - 7 + 25) % 25)::INT AS place, n_name AS topic FROM nation WHERE n_nationkey % 4 <> 1 ORDER BY (n_nationkey - 7 + 25) % 25 LIMIT 9")
def topics_in_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next nine topics from the seventh on, without the recent ones."""
    rows = read(spark, sf_dir, "nation")
    return collect.spread_topics(rows.select(F.col("n_nationkey").alias("at"), F.col("n_name").alias("topic")), rows.where("n_nationkey % 4 = 1").select(F.col("n_name").alias("topic")), 7, 9)


@query("SELECT id, name, category, postcode FROM venues", VENUES)
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues written as CSV files with a fixed order of columns, and read back with a check of the header."""
    import uuid

    path = f"{shared_dir(spark)}/venues-{uuid.uuid4().hex}"
    venues(spark, sf_dir).select("id", "name", "category", "postcode").write.option("header", True).csv(path)
    return read_csv(spark, path, "id bigint, name string, category string, postcode string", ("id", "postcode"))
