"""Queries over listings: views, identity, deduplication, counts, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from townkit.functions import dates, geo, text, urls
from townkit.operators import identity, ranking, schedule, views
from townkit.plans.registry import query
from townkit.sources.tables import LISTINGS, VENUES, listings, read, venues

TODAY = "2001-06-15"
NORM = "trim(regexp_replace(replace(lower({}), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


def day(name: str) -> Column:
    """A date column as text, YYYY-MM-DD."""
    return F.col(name).cast("string").alias(name)


@query(f"""SELECT id, title, start::VARCHAR AS start, "end"::VARCHAR AS "end" FROM listings WHERE kind = 'event' AND start IS NOT NULL AND coalesce("end", start) >= DATE '{TODAY}'""", LISTINGS)
def upcoming_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.upcoming_events(listings(spark, sf_dir), TODAY).select("id", "title", day("start"), day("end"))


@query(f"SELECT id, title, last_seen::VARCHAR AS last_seen FROM listings WHERE kind = 'activity' AND last_seen >= DATE '{TODAY}' - 60", LISTINGS)
def current_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.current_activities(listings(spark, sf_dir), TODAY).select("id", "title", day("last_seen"))


@query(f"""SELECT id, CASE WHEN start <= DATE '{TODAY}' + 2 AND coalesce("end", start) >= DATE '{TODAY}' + 1 THEN 'weekend' ELSE 'week' END AS section FROM listings
  WHERE start <= DATE '{TODAY}' + 6 AND coalesce("end", start) >= DATE '{TODAY}'""", LISTINGS)
def weekend_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of the next seven days, with those of the coming weekend told apart."""
    today = F.lit(TODAY).cast("date")
    saturday, sunday = dates.weekend(today)
    rows = listings(spark, sf_dir)
    rows = rows.where(dates.overlaps(F.col("start"), F.col("end"), today, F.date_add(today, 6)))
    return rows.select("id", F.when(dates.overlaps(F.col("start"), F.col("end"), saturday, sunday), "weekend").otherwise("week").alias("section"))


KEY_SQL = f"""md5(CASE WHEN kind = 'activity' THEN 'activity|' || {NORM.format('title')} || '|id:' || venue_id
  ELSE 'event|' || lower(regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '')) || '|' || start || '|id:' || venue_id END)"""


def identity_column() -> Column:
    return identity.identity_key(F.col("kind"), F.col("title"), F.col("url"), F.col("start"), F.col("venue_id"), F.lit(None).cast("string"), F.lit(None).cast("string"))


@query(f"SELECT id, {KEY_SQL} AS identity FROM listings", LISTINGS)
def identity_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select("id", identity_column().alias("identity"))


@query("""SELECT id, sha1(lower(title) || '|' || start || '|venue ' || venue_id) AS dedupe_key, md5(concat_ws('|', title, coalesce(start::VARCHAR, ''), coalesce("end"::VARCHAR, ''), status)) AS content_hash FROM listings""", LISTINGS)
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collector's key and the hash of the columns that may change."""
    key = identity.collector_key(F.col("title"), F.col("start"), F.concat(F.lit("Venue  "), F.col("venue_id")))
    return listings(spark, sf_dir).select("id", key.alias("dedupe_key"), identity.content_hash(F.col("title"), F.col("start"), F.col("end"), F.col("status")).alias("content_hash"))


@query("SELECT venue_id, id, title, start::VARCHAR AS start FROM (SELECT *, row_number() OVER (PARTITION BY venue_id ORDER BY start DESC, id DESC) AS n FROM listings) WHERE n = 1", LISTINGS)
def keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.keep_last(listings(spark, sf_dir), ["venue_id"], [F.col("start"), F.col("id")]).select("venue_id", "id", "title", day("start"))


@query("""SELECT venue_id, title, arg_min(id, id) AS id, arg_min("end", id) FILTER (WHERE "end" IS NOT NULL)::VARCHAR AS "end", max(last_seen)::VARCHAR AS last_seen FROM listings GROUP BY venue_id, title""", LISTINGS)
def keep_first_null_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first listing of each venue and title, its end filled from later ones, and the latest sighting."""
    rows = listings(spark, sf_dir).select("venue_id", "title", "id", "end", "last_seen")
    filled = identity.keep_first_fill(rows, ["venue_id", "title"], "id", ("last_seen",))
    return filled.select("venue_id", "title", "id", day("end"), day("last_seen"))


@query("SELECT kind, count(*) FILTER (WHERE n = 1)::BIGINT AS kept, count(*) FILTER (WHERE n > 1)::BIGINT AS duplicates FROM (SELECT kind, row_number() OVER (PARTITION BY title, start ORDER BY id) AS n FROM listings) GROUP BY kind", LISTINGS)
def keep_first_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = identity.mark_duplicates(listings(spark, sf_dir).select("id", "kind", "title", "start"), ["title", "start"], [F.col("id")])
    return marked.groupBy("kind").agg(F.count(F.when(F.col("reason").isNull(), 1)).alias("kept"), F.count("reason").alias("duplicates"))


@query("SELECT url, first_id AS id, id AS other FROM (SELECT url, id, min(id) OVER (PARTITION BY url) AS first_id FROM listings WHERE url IS NOT NULL) WHERE id <> first_id", LISTINGS)
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every further id of a url beside its first."""
    return identity.duplicate_members(listings(spark, sf_dir).select("id", "url"), "url")


@query("SELECT count(*)::BIGINT AS groups, sum(n)::BIGINT AS rows FROM (SELECT count(*) AS n FROM listings GROUP BY venue_id, title HAVING count(*) > 1)", LISTINGS)
def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = listings(spark, sf_dir).groupBy("venue_id", "title").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return sizes.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows"))


@query(f"""SELECT kind, count(*)::BIGINT AS n, count(*) FILTER (WHERE coalesce("end", start) >= DATE '{TODAY}')::BIGINT AS live, count("end")::BIGINT AS ended, min(start)::VARCHAR AS first, max(last_seen)::VARCHAR AS last FROM listings GROUP BY kind""", LISTINGS)
def yield_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = F.count(F.when(F.coalesce("end", "start") >= F.lit(TODAY).cast("date"), 1))
    return listings(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), live.alias("live"), F.count("end").alias("ended"), F.min("start").cast("string").alias("first"), F.max("last_seen").cast("string").alias("last"))


@query("SELECT kind, status, category, free, count(*)::BIGINT AS n FROM listings l JOIN venues v ON v.id = l.venue_id GROUP BY ALL", LISTINGS, VENUES)
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = listings(spark, sf_dir).join(venues(spark, sf_dir).select(F.col("id").alias("venue_id"), "category", "free"), "venue_id")
    return joined.groupBy("kind", "status", "category", "free").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT v.category, count(DISTINCT v.id)::BIGINT AS venues, count(DISTINCT v.id) FILTER (WHERE l.kind = 'event')::BIGINT AS with_events, count(l.id)::BIGINT AS listings,
  count(l.id) FILTER (WHERE l.last_seen >= DATE '{TODAY}')::BIGINT AS fresh FROM venues v LEFT JOIN listings l ON l.venue_id = v.id GROUP BY v.category""", LISTINGS, VENUES)
def left_conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues with and without listings: listings are summed up by venue before they meet the venues."""
    by_venue = listings(spark, sf_dir).groupBy("venue_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("kind") == "event", 1)).alias("events"), F.count(F.when(F.col("last_seen") >= F.lit(TODAY).cast("date"), 1)).alias("fresh"))
    joined = venues(spark, sf_dir).join(by_venue, F.col("id") == F.col("venue_id"), "left")
    return joined.groupBy("category").agg(
        F.count(F.lit(1)).alias("venues"), F.count(F.when(F.col("events") > 0, 1)).alias("with_events"), F.coalesce(F.sum("n"), F.lit(0)).alias("listings"), F.coalesce(F.sum("fresh"), F.lit(0)).alias("fresh")
    )


@query("""SELECT a.id AS keep_id, b.id AS other_id FROM listings a JOIN listings b ON a.start = b.start AND a.url = b.url AND a.id < b.id AND a.venue_id = b.venue_id WHERE a.status <> 'P' AND b.status <> 'P'""", LISTINGS)
def dup_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one day, url and venue that are not protected; the earlier is kept."""
    rows = listings(spark, sf_dir).where("status <> 'P'").select("id", "start", "url", "venue_id")
    other = rows.withColumnRenamed("id", "other_id")
    return rows.withColumnRenamed("id", "keep_id").join(other, ["start", "url", "venue_id"]).where("keep_id < other_id").select("keep_id", "other_id")


@query(f"""SELECT n AS round, id FROM (SELECT id, row_number() OVER (PARTITION BY venue_id % 12 ORDER BY start, id) AS n FROM listings WHERE kind = 'event' AND start >= DATE '{TODAY}') WHERE n <= 5""", LISTINGS)
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a dozen places, taken in turn, five rounds."""
    rows = listings(spark, sf_dir).where((F.col("kind") == "event") & (F.col("start") >= F.lit(TODAY).cast("date"))).withColumn("bucket", F.col("venue_id") % 12)
    first = ranking.first_in(rows, ["bucket"], [F.col("start"), F.col("id")], 5)
    return ranking.round_robin(first, "bucket", [F.col("start"), F.col("id")]).select("round", "id")


@query(f"""SELECT id, price * 0 + (CASE WHEN status = 'O' THEN 5 ELSE 0 END) + (CASE WHEN venue_id % 50 = 7 THEN 4 ELSE 0 END) + id % 5 AS score FROM listings WHERE kind = 'event' AND start >= DATE '{TODAY}' ORDER BY score DESC, id LIMIT 6""", LISTINGS)
def similar_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six upcoming events most like one: relevance, and points for the same category and place."""
    rows = views.upcoming_events(listings(spark, sf_dir), "1990-01-01").where(F.col("start") >= F.lit(TODAY).cast("date"))
    score = F.when(F.col("status") == "O", 5.0).otherwise(0.0) + F.when(F.col("venue_id") % 50 == 7, 4.0).otherwise(0.0) + F.col("id") % 5
    return rows.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(6)


@query(f"SELECT venue_id, min(start) FILTER (WHERE start >= DATE '{TODAY}')::VARCHAR AS next, CASE WHEN count(*) FILTER (WHERE start >= DATE '{TODAY}') > 0 THEN 'dated' WHEN max(last_seen) >= DATE '{TODAY}' - 30 THEN 'check' ELSE 'ended' END AS state FROM listings GROUP BY venue_id", LISTINGS)
def next_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next date of each venue's listings and the state of its schedule."""
    today = F.lit(TODAY).cast("date")
    by_venue = listings(spark, sf_dir).groupBy("venue_id").agg(F.min(F.when(F.col("start") >= today, F.col("start"))).alias("next"), F.max("last_seen").alias("seen"))
    state = F.when(F.col("next").isNotNull(), "dated").when(F.col("seen") >= F.date_sub(today, 30), "check").otherwise("ended")
    return by_venue.select("venue_id", F.col("next").cast("string").alias("next"), state.alias("state"))


@query(""", days AS (SELECT venue_id, isodow(start) - 1 AS d, array_to_string(list_sort(list(DISTINCT CASE WHEN id % 2 = 0 THEN '10:00' ELSE '14:30' END)), ', ') AS times FROM listings WHERE kind = 'activity' GROUP BY 1, 2),
  runs AS (SELECT venue_id, times, min(d) AS a, max(d) AS b FROM (SELECT *, d - row_number() OVER (PARTITION BY venue_id, times ORDER BY d) AS run FROM days) GROUP BY venue_id, times, run),
  named AS (SELECT *, ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'] AS w FROM runs),
  labels AS (SELECT venue_id, times, a, CASE WHEN b - a >= 2 THEN w[a + 1] || '–' || w[b + 1] WHEN b > a THEN w[a + 1] || ', ' || w[b + 1] ELSE w[a + 1] END AS label FROM named),
  parts AS (SELECT venue_id, times, min(a) AS first, array_to_string(list(label ORDER BY a), ', ') || ' ' || times AS part FROM labels GROUP BY 1, 2)
  SELECT venue_id, array_to_string(list(part ORDER BY first, times), '; ') AS schedule FROM parts GROUP BY venue_id""", LISTINGS)
def schedule_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly schedule of each venue's activities, as text."""
    rows = listings(spark, sf_dir).where("kind = 'activity'")
    slots = rows.select("venue_id", dates.weekday(F.col("start")).alias("day"), F.when(F.col("id") % 2 == 0, "10:00").otherwise("14:30").alias("time"))
    return schedule.schedule_text(slots, "venue_id")


@query("SELECT id, regexp_extract(regexp_replace(lower(url), '#.*$', ''), '^(.*?)/*$', 1) AS identity_url, 'venue' || (venue_id % 40) || '.example.co.uk/Listing/' || (venue_id % 300) AS website, 'example.co.uk' AS host FROM listings", LISTINGS)
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = F.col("url")
    return listings(spark, sf_dir).select("id", urls.identity_url(link).alias("identity_url"), urls.website_identity(link).alias("website"), urls.host_group(link).alias("host"))


@query(f"SELECT id, {NORM.format('title')} AS norm, trim(regexp_replace({NORM.format('title')}, '(^| )the ', '\\1', 'g')) AS bare, regexp_replace({NORM.format('title')}, ' ', '-', 'g') AS slug FROM listings", LISTINGS)
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.col("title")
    return listings(spark, sf_dir).select("id", text.norm_text(title).alias("norm"), text.norm_title(title).alias("bare"), text.slugify(title).alias("slug"))


@query("""SELECT l.id, round(CASE WHEN v.visible THEN v.lat ELSE n.n_nationkey + 50.0 END, 4) AS lat, CASE WHEN v.visible THEN 'venue' ELSE 'place' END AS origin FROM listings l JOIN venues v ON v.id = l.venue_id JOIN nation n ON n.n_nationkey = v.council""", LISTINGS, VENUES)
def listing_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point of a listing: its venue's if that is public, else its place's."""
    v = venues(spark, sf_dir).select(F.col("id").alias("venue_id"), F.when(F.col("visible"), F.col("lat")).alias("venue_lat"), "council")
    places = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("council"), (F.col("n_nationkey") + 50.0).alias("place_lat"))
    joined = listings(spark, sf_dir).join(v, "venue_id").join(places, "council", "left")
    return joined.select("id", F.round(F.coalesce("venue_lat", "place_lat"), 4).alias("lat"), F.when(F.col("venue_lat").isNotNull(), "venue").otherwise("place").alias("origin"))


@query(f"""SELECT scope, count(*)::BIGINT AS n, count(DISTINCT venue_id)::BIGINT AS venues FROM (SELECT venue_id, CASE WHEN id % 11 = 0 THEN 'online' WHEN NOT visible THEN 'unknown'
  WHEN 12742.0::DOUBLE * asin(sqrt(pow(sin(radians(lat - 53.5) / 2), 2) + cos(radians(53.5)) * cos(radians(lat)) * pow(sin(radians(lng + 2.5) / 2), 2))) <= 100 THEN 'local' ELSE 'far' END AS scope
  FROM listings JOIN (SELECT id AS venue_id, visible, lat, lng FROM venues) USING (venue_id)) GROUP BY scope""", LISTINGS, VENUES)
def listing_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings by scope: online ones first, whatever their place; then those without a public place."""
    v = venues(spark, sf_dir).select(F.col("id").alias("venue_id"), "visible", geo.haversine(53.5, -2.5, F.col("lat"), F.col("lng")).alias("km"))
    scope = F.when(F.col("id") % 11 == 0, "online").when(~F.col("visible"), "unknown").when(F.col("km") <= 100, "local").otherwise("far")
    return listings(spark, sf_dir).join(v, "venue_id").groupBy(scope.alias("scope")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("venue_id").alias("venues"))


@query("""SELECT identity, arg_min(id, id) AS id, min(price) AS low, max(price) AS high, CASE WHEN count(*) = count("end") THEN max("end")::VARCHAR END AS "end", count(DISTINCT status)::INT AS statuses FROM
  (SELECT *, venue_id || '|' || title AS identity FROM listings) GROUP BY identity HAVING count(DISTINCT kind) = 1""", LISTINGS)
def programme_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences merged to programmes: the least id, a price range, an end only if all have one; groups of mixed kinds are rejected."""
    rows = listings(spark, sf_dir).withColumn("identity", F.concat_ws("|", "venue_id", "title"))
    merged = rows.groupBy("identity").agg(
        F.min("id").alias("id"), F.min("price").alias("low"), F.max("price").alias("high"), F.when(~F.bool_or(F.col("end").isNull()), F.max("end")).cast("string").alias("end"),
        F.size(F.collect_set("status")).alias("statuses"), F.size(F.collect_set("kind")).alias("kinds"),
    )
    return merged.where("kinds = 1").drop("kinds")


@query("""SELECT id, kind, n FROM (SELECT id, kind, row_number() OVER (PARTITION BY kind ORDER BY start DESC, id) AS n FROM listings) WHERE n <= 100 UNION ALL
  SELECT id, 'venue', n FROM (SELECT id, row_number() OVER (ORDER BY name, id) AS n FROM venues WHERE visible) WHERE n <= 100""", LISTINGS, VENUES)
def sitemap_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest hundred of each kind of listing, and a hundred venues."""
    newest = ranking.dense_order(listings(spark, sf_dir), ["kind"], [F.desc("start"), F.col("id")], "n").where("n <= 100").select("id", "kind", "n")
    top = venues(spark, sf_dir).where("visible").orderBy("name", "id").limit(100)
    named = top.withColumn("n", F.row_number().over(Window.orderBy("name", "id"))).select("id", F.lit("venue").alias("kind"), "n")  # a hundred rows
    return newest.unionByName(named)


@query()
def fuzzy_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of equal dates and states that mean the same, folded in order: activities are sessions, which recur and are the same only by
    their link too; events are shows, which every second listing writes otherwise."""
    title = F.when(F.col("kind") == "event", F.replace("title", F.lit("Session"), F.when(F.col("id") % 2 == 0, "Show").otherwise("Show at"))).otherwise(F.col("title"))
    rows = listings(spark, sf_dir).select("id", title.alias("title"), F.concat(F.lit("Venue "), F.col("venue_id") % 20).alias("venue_name"), "start", "end", "status", F.col("url").alias("event_url"))
    return identity.fuzzy_fold(rows, ["start", "end", "status"], ["start", "id"]).select("id", "title", "venue_name", "merged")


@query("""SELECT i.id, CASE WHEN s.id IS NOT NULL THEN 'stored-' || s.id ELSE 'new-' || i.id END AS dedupe_key, s.id IS NOT NULL AS rewritten FROM (SELECT id, venue_id || title AS identity FROM listings WHERE id % 2 = 1) i
  LEFT JOIN (SELECT venue_id || title AS identity, min(id) AS id FROM listings WHERE id % 2 = 0 AND status <> 'F' GROUP BY 1) s USING (identity)""", LISTINGS)
def key_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming rows take the key of a stored row of the same identity, unless that was withdrawn."""
    rows = listings(spark, sf_dir).withColumn("identity", F.concat("venue_id", "title"))
    stored = rows.where("id % 2 = 0").select("id", "identity", F.concat(F.lit("stored-"), F.col("id")).alias("dedupe_key"), (F.col("status") == "F").alias("withdrawn"))
    incoming = rows.where("id % 2 = 1").select("id", "identity", F.concat(F.lit("new-"), F.col("id")).alias("dedupe_key"))
    return identity.reuse_keys(incoming, stored).select("id", "dedupe_key", "rewritten")
