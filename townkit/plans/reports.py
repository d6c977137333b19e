"""Queries over the remaining rules, checks and reports: search, cohorts, guards, sections, ages, clocks, observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from townkit.functions import dates, geo, places, text
from townkit.operators import eligibility
from townkit.plans.directory import LAT, LNG, km_sql
from townkit.plans.registry import query
from townkit.sources import documents
from townkit.sources.tables import LISTINGS, SIGNALS, VENUES, listings, read, signals, venues

TODAY = "2001-06-15"


@query("SELECT substr(md5(id::VARCHAR), 1, 1) AS shard, count(*)::BIGINT AS n, min(id) AS first, max(id) AS last FROM venues GROUP BY 1", VENUES)
def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixteen shards of all venues with the ends of their keys."""
    shard = F.substring(F.md5(F.col("id").cast("string")), 1, 1)
    return venues(spark, sf_dir).groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


@query("SELECT id FROM venues WHERE visible AND (name ILIKE '%17%' OR category ILIKE '%furn%' OR postcode ILIKE '%b1 %')", VENUES)
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any of three columns holds its pattern, in any case."""
    return venues(spark, sf_dir).where("visible").where(F.col("name").ilike("%17%") | F.col("category").ilike("%furn%") | F.col("postcode").ilike("%b1 %")).select("id")


@query("SELECT id FROM (SELECT id, nullif(category, 'BUILDING') AS c FROM venues) WHERE c IS NULL OR NOT (c ILIKE '%a%')", VENUES)
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A negated pattern that keeps rows without a value."""
    category = F.nullif(F.col("category"), F.lit("BUILDING"))
    return venues(spark, sf_dir).where(category.isNull() | ~category.ilike("%a%")).select("id")


@query("SELECT id, regexp_replace(title, '^The ', '') || ' (library)' AS name FROM listings WHERE NOT regexp_matches(lower(title), '(^|[^a-z])urgent($|[^a-z])')", LISTINGS)
def rename_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New names of the rows whose title lacks a word."""
    rows = listings(spark, sf_dir).where(~F.lower("title").rlike("(^|[^a-z])urgent($|[^a-z])"))
    return rows.select("id", F.concat(F.regexp_replace("title", "^The ", ""), F.lit(" (library)")).alias("name"))


@query(f"""SELECT id, CASE WHEN start IS NULL THEN 'no_date' WHEN coalesce("end", start) < DATE '1999-06-15' THEN 'past' WHEN start > DATE '1999-06-15' + 365 THEN 'too_far' END AS reason FROM listings""", LISTINGS)
def date_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a listing's dates are out of the window, if they are."""
    today = F.lit("1999-06-15").cast("date")
    rules = (("no_date", F.col("start").isNull()), ("past", F.coalesce("end", "start") < today), ("too_far", F.col("start") > F.date_add(today, 365)))
    return listings(spark, sf_dir).select("id", eligibility.first_reason(*rules).alias("reason"))


@query("""SELECT id, CASE WHEN s % 4 = 0 THEN s % 9 WHEN s % 4 = 1 THEN 0 WHEN s % 4 = 2 THEN s % 20 END::INT AS least, CASE WHEN s % 4 = 0 THEN s % 9 + 3 WHEN s % 4 = 1 THEN s % 9 END::INT AS most,
  CASE WHEN s % 4 = 3 THEN 'unknown' WHEN s % 4 = 2 AND s % 20 > 12 THEN 'outside' ELSE 'eligible' END AS state FROM (SELECT p_partkey AS id, p_size AS s FROM part)""")
def age_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ages out of text like '4-7 years', 'under 5s' and '8+', and whether they suit children."""
    said = F.expr("CASE p_size % 4 WHEN 0 THEN concat('for ', p_size % 9, '-', p_size % 9 + 3, ' years') WHEN 1 THEN concat('Under ', p_size % 9 + 1, 's') WHEN 2 THEN concat(p_size % 20, '+') ELSE 'all welcome' END")
    least, most = places.age_band(F.col("said"))
    rows = read(spark, sf_dir, "part", "p_partkey", "p_size").select(F.col("p_partkey").alias("id"), said.alias("said"))
    return rows.select("id", least.alias("least"), most.alias("most")).withColumn("state", places.age_state(F.col("least"), F.col("most")))


@query("SELECT id, id IN (SELECT venue_id FROM listings WHERE status = 'O') AS shown FROM venues", VENUES, LISTINGS)
def displayed_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a venue has an open listing."""
    shown = listings(spark, sf_dir).where("status = 'O'").select(F.col("venue_id").alias("id")).distinct().withColumn("shown", F.lit(True))
    return venues(spark, sf_dir).select("id").join(shown, "id", "left").select("id", F.coalesce("shown", F.lit(False)).alias("shown"))


@query(f"SELECT id, name FROM venues v WHERE EXISTS (SELECT 1 FROM listings l WHERE l.venue_id = v.id AND l.status = 'F' AND l.start >= DATE '{TODAY}' - 2000)", VENUES, LISTINGS)
def accepted_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues that an accepted listing vouches for."""
    accepted = listings(spark, sf_dir).where((F.col("status") == "F") & (F.col("start") >= F.date_sub(F.lit(TODAY).cast("date"), 2000))).select(F.col("venue_id").alias("id"))
    return venues(spark, sf_dir).select("id", "name").join(accepted, "id", "left_semi")


@query("""SELECT v.id, CASE WHEN d.changed IS NOT NULL AND v.flag IS NOT DISTINCT FROM d.guard THEN d.changed ELSE v.category END AS category FROM (SELECT id, category, CASE WHEN id % 3 = 0 THEN NULL ELSE free END AS flag FROM venues) v
  LEFT JOIN (VALUES ('AUTOMOBILE', true, 'CARS'), ('FURNITURE', false, 'HOME'), ('MACHINERY', NULL, 'TOOLS')) d(cat, guard, changed) ON d.cat = v.category""", VENUES)
def values_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions from a list apply where the row is still as it was decided on; null is a state like others."""
    decisions = spark.createDataFrame([("AUTOMOBILE", True, "CARS"), ("FURNITURE", False, "HOME"), ("MACHINERY", None, "TOOLS")], "category string, guard boolean, changed string")
    rows = venues(spark, sf_dir).select("id", "category", F.when(F.col("id") % 3 != 0, F.col("free")).alias("flag"))
    joined = rows.join(F.broadcast(decisions), "category", "left")  # three rows
    return joined.select("id", F.when(F.col("changed").isNotNull() & F.col("flag").eqNullSafe(F.col("guard")), F.col("changed")).otherwise(F.col("category")).alias("category"))


@query("SELECT kind, count(*)::BIGINT AS n, count(*) FILTER (WHERE a AND b)::BIGINT AS in_both, count(*) FILTER (WHERE NOT a AND NOT b)::BIGINT AS in_neither FROM (SELECT kind, status = 'F' AS a, status IN ('O', 'P') AS b FROM listings) GROUP BY kind", LISTINGS)
def set_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two cohorts are disjoint and cover all rows."""
    a, b = F.col("status") == "F", F.col("status").isin("O", "P")
    return listings(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(a & b, 1)).alias("in_both"), F.count(F.when(~a & ~b, 1)).alias("in_neither"))


@query("SELECT venue_id, start::VARCHAR AS start, min(id) AS id FROM listings GROUP BY 1, 2 HAVING count(*) = 1", LISTINGS)
def unique_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose venue and day tell them apart."""
    found = listings(spark, sf_dir).groupBy("venue_id", "start").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1")
    return found.select("venue_id", F.col("start").cast("string").alias("start"), "id")


@query("""SELECT n_regionkey AS region, count(*)::BIGINT AS areas, count(c)::BIGINT AS sampled, (count(*) - count(c))::BIGINT AS untested FROM nation LEFT JOIN (SELECT DISTINCT council AS c FROM venues WHERE free AND visible AND category = 'BUILDING' AND fee < -900) ON c = n_nationkey GROUP BY 1""", VENUES)
def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas with and without a sample, by region."""
    sampled = venues(spark, sf_dir).where("free AND visible AND category = 'BUILDING' AND fee < -900").select(F.col("council").alias("n_nationkey")).distinct().withColumn("hit", F.lit(1))
    joined = read(spark, sf_dir, "nation", "n_nationkey", "n_regionkey").join(sampled, "n_nationkey", "left")
    return joined.groupBy(F.col("n_regionkey").alias("region")).agg(F.count(F.lit(1)).alias("areas"), F.count("hit").alias("sampled"), F.count(F.when(F.col("hit").isNull(), 1)).alias("untested"))


@query(f"SELECT date_trunc('week', start)::DATE::VARCHAR AS week, count(DISTINCT venue_id)::BIGINT AS venues FROM listings JOIN (SELECT id, lat, lng FROM venues WHERE visible) v ON v.id = venue_id WHERE {km_sql()} <= 100 GROUP BY 1", LISTINGS, VENUES)
def nearby_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues within 100 km that have a listing, by week."""
    near = venues(spark, sf_dir).where("visible").where(geo.haversine(LAT, LNG, F.col("lat"), F.col("lng")) <= 100).select(F.col("id").alias("venue_id"))
    week = F.trunc("start", "week").cast("string")
    return listings(spark, sf_dir).select("venue_id", "start").join(near, "venue_id").groupBy(week.alias("week")).agg(F.count_distinct("venue_id").alias("venues"))


@query("SELECT id, last::VARCHAR AS last FROM venues LEFT JOIN (SELECT venue_id, max(last_seen) AS last FROM listings GROUP BY 1) ON venue_id = id ORDER BY last NULLS FIRST, id LIMIT 20", VENUES, LISTINGS)
def oldest_checked_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty venues that wait longest, those never seen first."""
    seen = listings(spark, sf_dir).groupBy(F.col("venue_id").alias("id")).agg(F.max("last_seen").alias("last"))
    joined = venues(spark, sf_dir).select("id").join(seen, "id", "left")
    return joined.orderBy(F.col("last").asc_nulls_first(), "id").limit(20).select("id", F.col("last").cast("string").alias("last"))


@query(f"""SELECT id, CASE WHEN start <= DATE '{TODAY}' THEN 'today' WHEN start <= DATE '{TODAY}' + 2 AND coalesce("end", start) >= DATE '{TODAY}' + 1 THEN 'weekend' WHEN start <= DATE '{TODAY}' + 6 THEN 'week' WHEN start <= DATE '{TODAY}' + 30 THEN 'month' ELSE 'later' END AS section
  FROM listings WHERE coalesce("end", start) >= DATE '{TODAY}'""", LISTINGS)
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section of a page that a listing belongs to."""
    today = F.lit(TODAY).cast("date")
    saturday, sunday = dates.weekend(today)
    start, end = F.col("start"), F.col("end")
    section = F.when(start <= today, "today").when(dates.overlaps(start, end, saturday, sunday), "weekend").when(start <= F.date_add(today, 6), "week").when(start <= F.date_add(today, 30), "month").otherwise("later")
    return listings(spark, sf_dir).where(F.coalesce(end, start) >= today).select("id", section.alias("section"))


@query("SELECT p_partkey AS id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) & 4294967295) % 12 AS bucket FROM part")
def colour_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bucket out of a rolling hash of the name."""
    return read(spark, sf_dir, "part", "p_partkey", "p_name").select(F.col("p_partkey").alias("id"), text.rolling_hash(F.col("p_name"), 12).alias("bucket"))


@query("""SELECT p_partkey AS id, '<loc>' || replace(replace(replace(p_name || ' & "' || p_brand || '" <new>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;').replace('"', '&quot;') || '</loc>' AS xml FROM part""")
def xml_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escaped lines of a site map."""
    value = F.concat("p_name", F.lit(' & "'), "p_brand", F.lit('" <new>'))
    return read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand").select(F.col("p_partkey").alias("id"), F.concat(F.lit("<loc>"), text.xml_escape(value), F.lit("</loc>")).alias("xml"))


@query("""SELECT strftime(CASE WHEN ts < d + INTERVAL '7 hours 17 minutes' THEN d + INTERVAL '7 hours 17 minutes' WHEN ts < d + INTERVAL '19 hours 17 minutes' THEN d + INTERVAL '19 hours 17 minutes' ELSE d + INTERVAL '31 hours 17 minutes' END, '%Y-%m-%d %H:%M') AS next_run, count(*)::BIGINT AS n
  FROM (SELECT ts, date_trunc('day', ts)::TIMESTAMP AS d FROM signals) GROUP BY 1""", SIGNALS)
def london_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many signals wait for each of the two London runs of a day (in winter, London's clock is UTC)."""
    rows = signals(spark, sf_dir).select(dates.next_daily_run(F.col("ts")).alias("next"))
    return rows.groupBy(F.date_format("next", "yyyy-MM-dd HH:mm").alias("next_run")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m // 60) || 'h ago' ELSE (m // 1440) || 'd ago' END AS age, count(*)::BIGINT AS n
  FROM (SELECT floor(trunc(epoch(TIMESTAMP '2024-02-01' - ts)) / 60)::BIGINT AS m FROM signals) GROUP BY 1""", SIGNALS)
def relative_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ages of signals as they are shown."""
    age = dates.relative_age(F.col("ts"), dates.instant("2024-02-01 00:00:00"))
    return signals(spark, sf_dir).groupBy(age.alias("age")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, least(5, greatest(0, floor(price / 50000)))::INT AS relevance, least(1.0, greatest(0.0, round(price / 400000, 4)))::DOUBLE AS confidence FROM listings", LISTINGS)
def clamped_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores forced into their ranges."""
    relevance, confidence = F.floor(F.col("price") / 50000), F.round(F.col("price") / 400000, 4)
    return listings(spark, sf_dir).select("id", F.least(F.lit(5), F.greatest(F.lit(0), relevance)).cast("int").alias("relevance"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence)).alias("confidence"))


@query("SELECT conv_id, n FROM (SELECT conv_id, count(*)::BIGINT AS n FROM conversations WHERE role = 'user' GROUP BY conv_id) ORDER BY n DESC, conv_id LIMIT 5")
def trending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five threads with the most questions."""
    counts = read(spark, sf_dir, "conversations", "conv_id", "role").where("role = 'user'").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "conv_id").limit(5)


@query("SELECT seq, CASE WHEN n = 1 THEN 'applied' WHEN kind = first THEN 'replayed' ELSE 'conflict' END AS outcome FROM (SELECT seq, kind, row_number() OVER w AS n, first_value(kind) OVER w AS first FROM signals WINDOW w AS (PARTITION BY series, k ORDER BY seq))", SIGNALS)
def idempotent_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first request of an id applies; the same again is replayed, another one of that id is refused."""
    rows = signals(spark, sf_dir)
    first = rows.groupBy("series", "k").agg(F.min(F.struct("seq", "kind")).alias("first"))
    joined = rows.alias("r").join(first.alias("f"), F.col("r.series").eqNullSafe(F.col("f.series")) & F.col("r.k").eqNullSafe(F.col("f.k")))
    outcome = F.when(F.col("r.seq") == F.col("first.seq"), "applied").when(F.col("r.kind") == F.col("first.kind"), "replayed").otherwise("conflict")
    return joined.select("r.seq", outcome.alias("outcome"))


@query("""SELECT source, CASE WHEN count(text) = 0 THEN 'unavailable' WHEN max(length(text)) = 0 THEN 'empty' WHEN count(text) < count(*) THEN 'partial' ELSE 'ok' END AS state, (count(*) - count(DISTINCT doc_id))::BIGINT AS repeated FROM documents GROUP BY source""")
def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unavailable, empty and partial sources are three things."""
    by = read(spark, sf_dir, "documents", "source", "doc_id", "text").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("there"), F.max(F.length("text")).alias("longest"), F.count_distinct("doc_id").alias("ids"))
    state = F.when(F.col("there") == 0, "unavailable").when(F.col("longest") == 0, "empty").when(F.col("there") < F.col("n"), "partial").otherwise("ok")
    return by.select("source", state.alias("state"), (F.col("n") - F.col("ids")).alias("repeated"))


@query("SELECT regexp_extract(lower(url), '://([^/?#:]*)', 1) AS host, count(*)::BIGINT AS n, (count(*) - count(DISTINCT url))::BIGINT AS repeated FROM pages GROUP BY 1")
def unique_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of each host, and how many are listed more than once."""
    rows = read(spark, sf_dir, "pages", "url").groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy(F.regexp_extract(F.lower("url"), "://([^/?#:]*)", 1).alias("host")).agg(F.sum("n").alias("n"), (F.sum("n") - F.count("url")).alias("repeated"))


@query("SELECT l_partkey AS id, round(l_discount, 2) AS discount, count(DISTINCT l_suppkey)::BIGINT AS sources FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) >= 2")
def corroborated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts of an item that two merchants state alike."""
    rows = read(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey", "l_discount").select(F.col("l_partkey").alias("id"), F.round("l_discount", 2).alias("discount"), "l_suppkey").distinct()
    return rows.groupBy("id", "discount").agg(F.count(F.lit(1)).alias("sources")).where("sources >= 2")


PHRASES = ("(^|[^a-z])the($|[^a-z])", "(^|[^a-z])and($|[^a-z])", "[0-9]")


@query(f"SELECT doc_id AS id FROM documents WHERE {' AND '.join(f'''regexp_matches(lower(text), '{p}')''' for p in PHRASES)}")
def phrase_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which all required phrases are found."""
    low = F.lower("text")
    keep = low.rlike(PHRASES[0]) & low.rlike(PHRASES[1]) & low.rlike(PHRASES[2])
    return read(spark, sf_dir, "documents", "doc_id", "text").where(keep).select(F.col("doc_id").alias("id"))


@query("SELECT n_nationkey AS id, regexp_replace(regexp_replace(lower(n_name || ' Council'), '[^a-z0-9]+', '_', 'g'), '_(council|borough|district)$', '') AS token FROM nation")
def place_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation", "n_nationkey", "n_name").select(F.col("n_nationkey").alias("id"), places.place_token(F.concat("n_name", F.lit(" Council"))).alias("token"))


@query("""SELECT id, CASE WHEN t < DATE '2000-06-15' - 45 THEN (t + INTERVAL 1 YEAR)::DATE ELSE t END::VARCHAR AS day FROM (SELECT id, make_date(2000, month(start), day(start)) AS t FROM listings)""", LISTINGS)
def inferred_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates without a year take this year's, or the next."""
    day = dates.infer_year(F.month("start"), F.dayofmonth("start"), F.lit("2000-06-15").cast("date"))
    return listings(spark, sf_dir).select("id", day.cast("string").alias("day"))


@query("SELECT round(lat / 0.25) * 0.25 AS lat, round(lng / 0.25) * 0.25 AS lng, count(*)::BIGINT AS n FROM venues WHERE visible GROUP BY 1, 2", VENUES)
def grid_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues by cells of a quarter degree."""
    rows = venues(spark, sf_dir).where("visible")
    return rows.groupBy(geo.grid_point(F.col("lat")).alias("lat"), geo.grid_point(F.col("lng")).alias("lng")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT seq, CASE WHEN value IS NULL THEN 'none' WHEN run <= 500 THEN 'now' WHEN run <= 1000 THEN 'next' ELSE 'later' END AS batch FROM (SELECT seq, value, sum(coalesce(value, 0)) OVER (PARTITION BY series ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM signals)""", SIGNALS)
def budget_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which run of a budgeted worker takes each item, by the running cost of its series."""
    w = Window.partitionBy("series").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum(F.coalesce("value", F.lit(0.0))).over(w)
    rows = signals(spark, sf_dir).select("seq", "value", run.alias("run"))
    return rows.select("seq", F.when(F.col("value").isNull(), "none").when(F.col("run") <= 500, "now").when(F.col("run") <= 1000, "next").otherwise("later").alias("batch"))


@query("""SELECT page_id, k::BIGINT AS place_in_page, 'Event ' || page_id || '-' || k AS name, '2024-05-' || lpad((1 + page_id % 28)::VARCHAR, 2, '0') AS start, NULL::VARCHAR AS "end", CASE WHEN k = 0 THEN 'Hall ' || page_id % 7 ELSE 'Outdoors' END AS place, url
  FROM pages, (VALUES (0), (1)) AS t(k) WHERE page_id % 4 <> 0""")
def linked_data_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each event in the linked data of every page; of four pages one has a script that is broken."""
    pages = read(spark, sf_dir, "pages")
    name = lambda k: F.concat(F.lit("Event "), "page_id", F.lit(f"-{k}"))
    start = F.concat(F.lit("2024-05-"), F.lpad((1 + F.col("page_id") % 28).cast("string"), 2, "0"))
    first = F.struct(F.lit("MusicEvent").alias("@type"), name(0).alias("name"), start.alias("startDate"), F.struct(F.concat(F.lit("Hall "), F.col("page_id") % 7).alias("name")).alias("location"), F.col("url").alias("url"))
    second = F.struct(F.array(F.lit("Thing"), F.lit("Event")).alias("@type"), name(1).alias("name"), start.alias("startDate"), F.lit("Outdoors").alias("location"), F.col("url").alias("url"))
    graph = F.to_json(F.struct(F.array(F.struct(first.alias("item"), F.lit("WebPage").alias("@type"), second.alias("about"))).alias("@graph")))
    script = F.concat(F.lit('<script type="application/ld+json">'), F.when(F.col("page_id") % 4 == 0, F.substring(graph, 1, 40)).otherwise(graph), F.lit("</script>"))
    return documents.read_events(pages.withColumn("html", F.concat(F.coalesce("html", F.lit("")), script)))
