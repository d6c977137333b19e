"""Queries of rules and values: what a text, price, date, tag or run says, each over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townkit.functions import dates, geo, money, text, urls
from townkit.operators import rules
from townkit.plans.registry import query
from townkit.sources import adapters
from townkit.sources.tables import LISTINGS, OFFERS, VENUES, listings, offers, read, venues
from townkit.streaming import outbox


@query(r"SELECT p_partkey AS id, regexp_replace(p_name || CASE WHEN p_partkey % 3 = 0 THEN ' — Default Title' WHEN p_partkey % 3 = 1 THEN ' - Default' ELSE '' END, '\s+[—-]\s+Default(?: Title)?$', '') AS shown FROM part")
def display_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without a final default variant."""
    ending = F.expr("CASE WHEN p_partkey % 3 = 0 THEN ' — Default Title' WHEN p_partkey % 3 = 1 THEN ' - Default' ELSE '' END")
    return read(spark, sf_dir, "part", "p_partkey", "p_name").select(F.col("p_partkey").alias("id"), text.display_title(F.concat("p_name", ending)).alias("shown"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 'Story time' ELSE 'Story time at ' || category END AS shown FROM venues", VENUES)
def titles_without_venue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that end in their own venue lose it, in any case and punctuation; others stay."""
    rows = venues(spark, sf_dir).select("id", "category", F.when(F.col("id") % 2 == 0, F.concat(F.lit("The "), "name", F.lit("!"))).otherwise(F.col("name")).alias("venue"))
    title = F.concat(F.lit("Story time at "), F.when(F.col("id") % 2 == 0, F.concat(F.lit("the "), F.lower(F.replace("venue", F.lit("#"), F.lit("_"))))).otherwise(F.col("category")))
    plain = F.regexp_replace(title, "the the ", "the ")
    return rows.select("id", text.without_suffix(plain, F.col("venue")).alias("shown"))


@query(r"SELECT id, list_sort(list_filter(list_distinct(string_split(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ' ')), lambda w: w NOT IN ('', 'a', 'an', 'and', 'at', 'for', 'in', 'of', 'on', 'the', 'to', 'with'))) AS tokens FROM (SELECT id, title || ' of THE town' AS title FROM listings)", LISTINGS)
def title_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select("id", F.sort_array(text.title_tokens(F.concat("title", F.lit(" of THE town")))).alias("tokens"))


@query("SELECT p_partkey AS id, p_name || ' & more £' || p_size || ' <' AS cleaned FROM part")
def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup, entities and spaces of a snippet, resolved once and in order."""
    snippet = F.concat(F.lit("<p class='x'>  "), "p_name", F.lit("</p>\n&amp;  more <br/>&pound;"), F.col("p_size"), F.lit(" &lt;"))
    return read(spark, sf_dir, "part", "p_partkey", "p_name", "p_size").select(F.col("p_partkey").alias("id"), text.clean_text(snippet).alias("cleaned"))


@query(r"SELECT id, trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(trim(regexp_replace(replace(lower(n), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), '\b(a|an|the)\b', ' ', 'g'), ' +', ' ', 'g')), '\b(ltd|limited|plc)\b', ' ', 'g'), ' +', ' ', 'g')) AS name, regexp_replace(lower(n), '[''’]', '', 'g') AS low FROM (SELECT id, 'The ' || name || '''s & Sons Ltd' AS n FROM venues)", VENUES)
def company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without articles and company words."""
    name = F.concat(F.lit("The "), "name", F.lit("'s & Sons Ltd"))
    return venues(spark, sf_dir).select("id", text.norm_name(name).alias("name"), F.regexp_replace(F.lower(name), "['’]", "").alias("low"))


@query("SELECT id, CASE WHEN strftime(try_strptime(d, '%Y-%m-%d'), '%Y-%m-%d') = d THEN try_strptime(d, '%Y-%m-%d')::DATE END AS day FROM (SELECT o_orderkey AS id, '2024-' || lpad((o_orderkey % 14)::VARCHAR, 2, '0') || '-' || lpad((o_custkey % 33)::VARCHAR, 2, '0') AS d FROM orders)")
def strict_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates that exist; others are null."""
    value = F.expr("concat('2024-', lpad(cast(o_orderkey % 14 AS string), 2, '0'), '-', lpad(cast(o_custkey % 33 AS string), 2, '0'))")
    return read(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("id"), dates.strict_date(value).alias("day"))


@query("SELECT id, try_strptime(d, '%d %B %Y')::DATE AS first_day, CASE WHEN try_strptime(d, '%d %B %Y') IS NULL THEN 1 ELSE 2 END::INT AS n FROM (SELECT o_orderkey AS id, (1 + o_orderkey % 31) || ' ' || CASE WHEN o_custkey % 2 = 0 THEN 'February' ELSE 'May' END || ' 2024' AS d FROM orders) WHERE try_strptime(d, '%d %B %Y') IS NOT NULL")
def published_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the English dates in a text, and how many there are; texts whose first date does not exist are left out."""
    first = F.expr("concat(1 + o_orderkey % 31, ' ', if(o_custkey % 2 = 0, 'February', 'May'), ' 2024')")
    found = dates.english_dates(F.concat(F.lit("Published "), first, F.lit(", updated 3 June 2024 (not 31 June 2024).")))
    rows = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("id"), found.alias("found"))
    return rows.where(F.size("found") > 1).select("id", F.col("found")[0].alias("first_day"), F.size("found").alias("n"))


@query("SELECT o_orderkey AS id, try_strptime(y || '01', '%Y%m%d')::DATE AS day FROM (SELECT o_orderkey, year(o_orderdate) || lpad((o_orderkey % 15)::VARCHAR, 2, '0') AS y FROM orders)")
def months_written_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.year("o_orderdate").cast("string"), F.lpad((F.col("o_orderkey") % 15).cast("string"), 2, "0"))
    return read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select(F.col("o_orderkey").alias("id"), dates.year_month(value).alias("day"))


@query("""SELECT ((date_trunc('month', (ts + INTERVAL 100 DAY) AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London')) AT TIME ZONE 'Europe/London') AT TIME ZONE 'UTC' AS month_start, event_type AS kind, count(*)::BIGINT AS n FROM events GROUP BY 1, 2""")
def london_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by London month; its start as a UTC instant, an hour earlier in summer."""
    rows = read(spark, sf_dir, "events", "ts", "event_type").select((F.col("ts") + F.expr("INTERVAL 100 DAYS")).alias("at"), F.col("event_type").alias("kind"))
    return rows.groupBy(dates.month_bounds(F.col("at"))[0].alias("month_start"), "kind").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT id, regexp_full_match(v, '[0-9]+\.[0-9]{2}') AS exact, CASE WHEN contains(t, 'bed') OR contains(t, 'desk') OR contains(t, 'cot') OR contains(t, 'pram') THEN 'big' WHEN contains(t, 'set') OR contains(t, 'gate') OR contains(t, 'toys') OR contains(t, 'bath') OR contains(t, 'boots') OR contains(t, 'coat') THEN 'mid' ELSE 'low' END AS band
  FROM (SELECT p_partkey AS id, (p_size / CASE WHEN p_size % 2 = 0 THEN 1 ELSE 4 END)::VARCHAR AS v, lower(p_name || ' ' || p_type) || ' ' || ['bed', 'gate', 'cotton', 'toy', 'sets'][(p_size % 5 + 1)::INT] AS t FROM part)""")
def price_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an amount is written to the penny, and how dear a title's thing is."""
    rows = read(spark, sf_dir, "part", "p_partkey", "p_size", "p_name", "p_type")
    amount = F.expr("cast(p_size / if(p_size % 2 = 0, 1, 4) AS string)")
    title = F.concat_ws(" ", "p_name", "p_type", F.element_at(F.array(*map(F.lit, ("bed", "gate", "cotton", "toy", "sets"))), (F.col("p_size") % 5 + 1).cast("int")))
    return rows.select(F.col("p_partkey").alias("id"), money.is_exact_pence(amount).alias("exact"), money.value_band(title).alias("band"))


@query("SELECT id, round(greatest(0, 0.02 * (id % 7 - 1) * 111.0 * (0.03 * 111.0 * cos(radians(lat + 0.01 * (id % 7 - 1))))), 6) AS km2 FROM venues", VENUES)
def box_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of boxes, some of them upside down."""
    north = F.col("lat") + 0.02 * (F.col("id") % 7 - 1)
    return venues(spark, sf_dir).select("id", F.round(geo.box_area_km2(F.col("lat"), north, F.col("lng"), F.col("lng") + 0.03), 6).alias("km2"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_name END AS title, p_retailprice::VARCHAR AS price, 's' || p_partkey % 3 AS merchant FROM part")
def adapted_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of providers that name the same things otherwise, as one shape."""
    rows = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_retailprice")
    blank = F.when(F.col("p_partkey") % 4 == 0, F.lit("  ")).otherwise(F.col("p_name"))
    one = F.to_json(F.struct(F.col("p_partkey").alias("id"), blank.alias("title"), F.col("p_retailprice").alias("price"), F.concat(F.lit("s"), F.col("p_partkey") % 3).alias("merchant")))
    other = F.to_json(F.struct(F.col("p_partkey").alias("offerId"), blank.alias("name"), F.col("p_retailprice").alias("salePrice"), F.concat(F.lit("s"), F.col("p_partkey") % 3).alias("advertiser")))
    both = adapters.union_sources(adapters.adapt(rows.where("p_partkey % 2 = 0").select(one.alias("json")), "one"), adapters.adapt(rows.where("p_partkey % 2 = 1").select(other.alias("json")), "other"))
    return both.select(F.col("record_id").cast("long").alias("id"), "title", "price", "merchant")


@query("SELECT id, lat, lng FROM venues", VENUES)
def unwrapped_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of arrays, of arrays under a key, and of geographic features, as rows with their point."""
    point = F.struct(F.array("lng", "lat").alias("coordinates"))
    feature = F.struct(F.struct("id").alias("properties"), point.alias("geometry"))
    listed = venues(spark, sf_dir).groupBy("council").agg(F.collect_list(feature).alias("features"))
    payload = F.when(F.col("council") % 2 == 0, F.to_json("features")).otherwise(F.to_json(F.struct("features")))
    found = adapters.unwrap(listed.select(payload.alias("json")))
    return found.select(F.get_json_object("json", "$.id").cast("long").alias("id"), "lat", "lng")


@query("SELECT id, name, NULL::DATE AS start, 'venue' AS kind FROM venues UNION ALL SELECT id, title, start, kind FROM listings", VENUES, LISTINGS)
def union_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two sources by column name; what one lacks is null."""
    return adapters.union_sources(venues(spark, sf_dir).select("id", "name", F.lit("venue").alias("kind")), listings(spark, sf_dir).select("id", F.col("title").alias("name"), "start", "kind"))


@query("SELECT s AS status, CASE WHEN s BETWEEN 200 AND 299 THEN 'success' WHEN s BETWEEN 500 AND 599 THEN 'http_5xx' WHEN s = 401 THEN 'http_403' ELSE 'http_' || s END AS class, CASE WHEN s IN (404, 403, 429) THEN 'failed_' || s WHEN s % 3 = 0 THEN 'failed_timeout' ELSE 'failed_fetch' END AS failure, count(*)::BIGINT AS n FROM (SELECT (200 + o_orderkey % 400)::INT AS s FROM orders) GROUP BY 1")
def status_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers and failures by their class."""
    rows = read(spark, sf_dir, "orders", "o_orderkey").groupBy((200 + F.col("o_orderkey") % 400).cast("int").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    message = F.concat(F.lit("GET: HTTP_"), "status", F.when(F.col("status") % 3 == 0, " Timed out").otherwise(""))
    return rows.select("status", rules.http_class(F.col("status")).alias("class"), rules.fetch_failure(message).alias("failure"), "n")


AGES = ("12+", "ages 3 to 7", "teens", "Adults", "family, 5+", "all", "Ages 8–11", "4-6 years")


@query("SELECT id, [12, 3, 13, 18, NULL, NULL, 8, 4][(id % 8 + 1)::INT]::INT AS least FROM listings", LISTINGS)
def least_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least age that an age text states."""
    age = F.element_at(F.array(*map(F.lit, AGES)), (F.col("id") % 8 + 1).cast("int"))
    return listings(spark, sf_dir).select("id", rules.least_age(age).alias("least"))


@query(r"""SELECT id, CASE WHEN start IS NULL THEN true WHEN contains(t, 'summer') AND month(start) IN (10, 11, 12, 1, 2, 3) THEN true WHEN regexp_matches(t, 'christmas|santa|festive') AND month(start) NOT IN (11, 12, 1) THEN true
  ELSE regexp_matches(t, '\bnew year\s+20[0-9]{2}\b') AND month(start) NOT IN (1, 2) END AS season, NOT regexp_matches(t, 'overnight|sunrise|dawn|early morning') AND (id % 4 = 0 OR id % 4 = 1) AS mistimed, id % 7 = 3 AS adults
  FROM (SELECT id, CASE WHEN id % 13 = 0 THEN NULL ELSE start END AS start, lower(['Summer fair', 'Santa visit', 'New Year 2024', title][(id % 4 + 1)::INT] || CASE WHEN id % 5 = 0 THEN ' at dawn' WHEN id % 5 = 1 THEN ' with a festive tea' ELSE '' END) AS t FROM listings)""", LISTINGS)
def season_and_time_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings that contradict their month or have no start, times at night that they do not explain, and those for adults only."""
    title = F.element_at(F.array(F.lit("Summer fair"), F.lit("Santa visit"), F.lit("New Year 2024"), F.col("title")), (F.col("id") % 4 + 1).cast("int"))
    told = F.when(F.col("id") % 5 == 0, "at dawn").when(F.col("id") % 5 == 1, "with a Festive tea")
    time = F.element_at(F.array(F.lit("04:30"), F.lit("2:15 am to 11:00 am"), F.lit("12:05 am"), F.lit("11:00 am to 5:00 am")), (F.col("id") % 4 + 1).cast("int"))
    start = F.when(F.col("id") % 13 != 0, F.col("start"))
    adults = rules.adults_only(title, F.when(F.col("id") % 7 == 3, "Adults  only"))
    return listings(spark, sf_dir).select("id", rules.season_conflict(title, told, start).alias("season"), rules.suspicious_time(time, title, told).alias("mistimed"), adults.alias("adults"))


@query("SELECT p_partkey AS id, p_size % 3 = 0 AS child FROM part")
def child_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with a word for a child, whole words only."""
    title = F.concat("p_name", F.element_at(F.array(F.lit(" for Kids!"), F.lit(" kidskin"), F.lit(" schools")), (F.col("p_size") % 3 + 1).cast("int")))
    return read(spark, sf_dir, "part", "p_partkey", "p_name", "p_size").select(F.col("p_partkey").alias("id"), rules.has_child_word(title).alias("child"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 4 = 1 THEN 'missing_applicability: holiday dates, party size and fee breakdown required' WHEN p_size % 4 = 3 THEN 'missing_applicability: tuition subject, age, mode, duration and commitment required' END AS reason FROM part")
def offers_that_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holidays and tuition must state whom and what they are for."""
    rows = read(spark, sf_dir, "part", "p_partkey", "p_size")
    words = ("From 3 May 2024: 2 adults, 1 child, all fees", "From 3 May 2024: 2 adults, all fees", "Maths, year 4, online, 10 lessons, cancel any time", "Maths, year 4, online")
    item = F.when(F.col("p_size") % 4 < 2, "Ski holidays").otherwise("Group tutoring")
    return rows.select(F.col("p_partkey").alias("id"), rules.applicability(item, F.element_at(F.array(*map(F.lit, words)), (F.col("p_size") % 4 + 1).cast("int"))).alias("reason"))


@query("SELECT id, CASE id % 5 WHEN 0 THEN 'Price unknown' WHEN 1 THEN 'Price unknown' WHEN 2 THEN 'Free' WHEN 3 THEN 'Free' ELSE '£' || venue_id END AS price FROM listings", LISTINGS)
def price_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.expr("CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' N/A ' WHEN 2 THEN 'FREE!' WHEN 3 THEN ' free' ELSE concat(' £', venue_id, ' ') END")
    return listings(spark, sf_dir).select("id", rules.price_label(value).alias("price"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN '' ELSE '1 High Street, ' END || upper(category) || CASE WHEN id % 2 = 0 THEN '' ELSE ', ' || postcode END AS address FROM venues", VENUES)
def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Street, town and postcode as far as they are known, none twice."""
    street = F.when(F.col("id") % 3 == 0, None).otherwise("1 High Street")
    last = F.when(F.col("id") % 2 == 0, F.lower("category")).otherwise(F.col("postcode"))
    return venues(spark, sf_dir).select("id", rules.address(street, F.upper("category"), last).alias("address"))


@query("""SELECT id, round(5 + CASE WHEN id % 2 = 0 THEN 4 ELSE 0 END + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 5 = 0 THEN 2 WHEN id % 5 = 1 THEN 0 ELSE 0 END + CASE WHEN id % 7 = 0 THEN least(3.0, ln(1 + (id % 10) / 10.0::DOUBLE * 10)) ELSE 0 END, 3)::DOUBLE AS score FROM venues""", VENUES)
def spot_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of places by their tags, and of reserves by their area."""
    tags = F.create_map(F.lit("wikidata"), F.when(F.col("id") % 2 == 0, "Q1"), F.lit("contact:website"), F.when(F.col("id") % 3 == 0, "https://a"), F.lit("changing_table"), F.when(F.col("id") % 5 == 0, "yes").when(F.col("id") % 5 == 1, "no"))
    rows = venues(spark, sf_dir).select("id", tags.alias("tags"), (F.col("id") % 10 / 10.0).alias("area"))
    return rows.select("id", rules.spot_score(F.lit(5.0), F.col("tags"), F.col("area"), F.col("id") % 7 == 0).alias("score"))


@query("SELECT id, CASE WHEN flag = 'R' THEN 'stock' WHEN NOT (price > 0 AND was > price) THEN 'prices' WHEN relevance = 3 THEN 'saving' END AS reason FROM offers", OFFERS)
def retail_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price pairs that prove a saving."""
    stated = F.when(F.col("relevance") == 3, F.col("was") - F.col("price") + 1).otherwise(F.col("was") - F.col("price"))
    return offers(spark, sf_dir).select("id", rules.retail_pair(F.col("price"), F.col("was"), stated, F.lit("GBP"), F.col("flag") != "R").alias("reason"))


@query("""WITH s AS (SELECT user_id % 50 AS workflow, max(ts) AS slot FROM events WHERE event_type = 'signup' AND ts <= TIMESTAMP '2024-01-20' GROUP BY 1),
  r AS (SELECT user_id % 50 AS workflow, ts AS run FROM events WHERE event_type = 'purchase' AND ts <= TIMESTAMP '2024-01-20'),
  f AS (SELECT s.workflow, slot, min(run) FILTER (WHERE run >= slot) AS run FROM s LEFT JOIN r USING (workflow) GROUP BY 1, 2),
  d AS (SELECT *, floor(date_diff('second', slot, run) / 60)::BIGINT AS delay FROM f)
  SELECT workflow, slot, delay, CASE WHEN run IS NULL THEN CASE WHEN date_diff('second', slot, TIMESTAMP '2024-01-20') / 60 > 60 THEN 'missing' ELSE 'pending' END WHEN delay > 60 THEN 'late' ELSE 'on_time' END AS state FROM d""")
def latest_slot_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest due slot of each workflow and the first run after it."""
    rows = read(spark, sf_dir, "events", "user_id", "ts", "event_type").withColumn("workflow", F.col("user_id") % 50)
    slots, runs = (rows.where(F.col("event_type") == kind) for kind in ("signup", "purchase"))
    return rules.first_run_after_slot(slots.select("workflow", F.col("ts").alias("slot")), runs.select("workflow", F.col("ts").alias("at")), dates.instant("2024-01-20 00:00:00"))


@query("SELECT id FROM listings l WHERE id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM listings s WHERE s.id % 2 = 0 AND s.url = l.url AND s.id % 3 = 0) AND NOT EXISTS (SELECT 1 FROM listings s WHERE s.id % 2 = 0 AND s.url || '?b' = l.url || CASE WHEN l.id % 5 = 0 THEN '?b' ELSE '' END AND s.id % 3 = 1)", LISTINGS)
def second_chance_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose link is in neither of two link columns of the stored ones."""
    rows = listings(spark, sf_dir).select("id", "url")
    stored = rows.where("id % 2 = 0")
    links = stored.where("id % 3 = 0").select("url").union(stored.where("id % 3 = 1").select(F.concat("url", F.lit("?b")))).distinct()
    new = rows.where("id % 2 = 1").select("id", F.explode(F.array("url", F.when(F.col("id") % 5 == 0, F.concat("url", F.lit("?b"))).otherwise(F.col("url")))).alias("url"))
    seen = new.join(links, "url", "left_semi").select("id").distinct()
    return rows.where("id % 2 = 1").select("id").join(seen, "id", "left_anti")


@query("SELECT s.l_orderkey AS id, s.l_linenumber AS line, CASE WHEN n = 1 THEN total END AS total, coalesce(n = 1, false) AS matched FROM lineitem s LEFT JOIN (SELECT l_orderkey, l_suppkey, count(*) AS n, any_value(round(l_quantity, 2)) AS total FROM lineitem WHERE l_linenumber > 2 GROUP BY 1, 2) r ON r.l_orderkey = s.l_orderkey AND r.l_suppkey = s.l_suppkey WHERE s.l_linenumber <= 2")
def unique_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence by a composite key; a key with several rows proves nothing."""
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity")
    evidence = rows.where("l_linenumber > 2").select("l_orderkey", "l_suppkey", F.round("l_quantity", 2).alias("total"))
    found = rules.unique_match(rows.where("l_linenumber <= 2").select("l_orderkey", "l_suppkey", "l_linenumber"), evidence, ["l_orderkey", "l_suppkey"])
    return found.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.when(F.col("matched"), F.col("total")).alias("total"), "matched")


@query("SELECT worker, id, row_number() OVER (ORDER BY turn, worker)::INT AS place FROM (SELECT merchant AS worker, id, row_number() OVER (PARTITION BY merchant ORDER BY id) AS turn FROM offers) QUALIFY place <= 40", OFFERS)
def interleaved_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty samples, taken from the workers in turn."""
    return rules.interleaved(offers(spark, sf_dir).select(F.col("merchant").alias("worker"), "id"), "worker", [F.col("id")], 40)


@query("SELECT status AS source, max(start) > DATE '2001-07-31' AS complete, count(*) FILTER (WHERE start <= DATE '2001-07-31')::BIGINT AS inside FROM listings GROUP BY 1", LISTINGS)
def window_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source was read to the end of the window only if a record lies beyond it."""
    return rules.window_complete(listings(spark, sf_dir).select(F.col("status").alias("source"), "start"), "source", "start", F.lit("2001-07-31").cast("date"))


@query("""WITH RECURSIVE q AS (SELECT 'f' || user_id % 40 AS family, ts AS asked, lpad(event_id::VARCHAR, 12, '0') AS id, CASE WHEN value > 2 THEN ts + to_minutes(floor(value)::BIGINT % 25) END AS done_at, value >= 1 AND event_type IS NOT NULL AS valid FROM events),
  g(family, asked, id, free) AS (
    SELECT family, min(asked), arg_min(id, (asked, id)), arg_min(greatest(asked + INTERVAL 10 MINUTE, coalesce(done_at, TIMESTAMP '9999-01-01')), (asked, id)) FROM q WHERE valid GROUP BY family
    UNION ALL
    SELECT q.family, min(q.asked), arg_min(q.id, (q.asked, q.id)), arg_min(greatest(q.asked + INTERVAL 10 MINUTE, coalesce(q.done_at, TIMESTAMP '9999-01-01')), (q.asked, q.id)) FROM g JOIN q ON q.family = g.family AND q.asked >= g.free AND q.valid GROUP BY q.family),
  last AS (SELECT q.*, g.id IS NOT NULL AS granted, max(g.asked) OVER w AS before, max(CASE WHEN g.id IS NOT NULL THEN coalesce(q.done_at, TIMESTAMP '9999-01-01') END) OVER w AS busy FROM q LEFT JOIN g ON g.family = q.family AND g.id = q.id
           WINDOW w AS (PARTITION BY q.family ORDER BY q.asked, q.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT family, id, CASE WHEN NOT valid THEN 'invalid' WHEN granted THEN 'granted' WHEN busy > asked THEN 'outstanding' ELSE 'cooldown' END AS claim FROM last""")
def outbox_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One outstanding dispatch of a family, and ten minutes between two: all events as requests, some without a reason, some never done."""
    rows = read(spark, sf_dir, "events", "user_id", "ts", "event_id", "event_type", "value")
    done = F.when(F.col("value") > 2, F.col("ts") + F.make_dt_interval(mins=(F.floor("value") % 25).cast("int")))
    reason = F.when(F.col("value") >= 1, F.concat(F.lit("because of "), "event_type")).otherwise(F.lit(" short "))
    asked = rows.select(F.concat(F.lit("f"), F.col("user_id") % 40).alias("family"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), F.col("ts").alias("at"), done.alias("done_at"), reason.alias("reason"))
    return outbox.claims(asked, None).select("family", "id", "claim")


@query("SELECT council, list_sort(list(DISTINCT id)) = list_sort(list(DISTINCT id) FILTER (WHERE id % 211 <> 0)) AS whole FROM venues GROUP BY council", VENUES)
def complete_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches whose answer has exactly the ids that were asked for: none missing and none more, by counts from both sides."""
    asked = venues(spark, sf_dir).select("council", "id")
    got = asked.where("id % 211 <> 0").withColumn("got", F.lit(1))
    both = asked.withColumn("asked", F.lit(1)).join(got, ["council", "id"], "full")
    return both.groupBy("council").agg((F.count("asked") + F.count("got") == 2 * F.count(F.lit(1))).alias("whole"))


@query("SELECT id, 'https://www.venue' || venue_id % 40 || '.example.co.uk/Listing/' || venue_id % 300 || '/?a=1&b=' || id % 3 AS cleaned, 'https://www.venue' || venue_id % 40 || '.example.co.uk/Listing/' || venue_id % 300 || '?a=1&b=' || id % 3 || '&utm_source=x' AS canonical FROM listings", LISTINGS)
def two_more_canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article's link without tracking, and an offer's with its keys in order."""
    rows = listings(spark, sf_dir).select("id", F.concat(F.replace("url", F.lit("#top"), F.lit("")), F.lit("?a=1&b="), (F.col("id") % 3).cast("string"), F.lit("&utm_source=x#frag")).alias("link"))
    return rows.select("id", urls.clean_url(F.col("link")).alias("cleaned"), urls.canonical_link(F.col("link")).alias("canonical"))
