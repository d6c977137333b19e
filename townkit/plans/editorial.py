"""Queries over written posts and the times of their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townkit.functions import dates, text
from townkit.operators import editorial, geography, merge, paging
from townkit.plans.registry import query
from townkit.sources.tables import VENUES, read, venues


@query("""SELECT event_id AS id, cadence, day, CASE WHEN cadence = 'weekly' THEN (day - DATE '0001-01-01' + 1) // 7 ELSE day - DATE '0001-01-01' + 1 END::BIGINT AS topic_place FROM
  (SELECT event_id, local::DATE AS day, unnest(CASE WHEN hour(local) * 60 + minute(local) < 437 THEN [] WHEN isodow(local) = 5 THEN ['daily', 'weekly'] ELSE ['daily'] END) AS cadence FROM
   (SELECT event_id, CASE WHEN t >= TIMESTAMP '2024-03-31 01:00' THEN t + INTERVAL 1 HOUR ELSE t END AS local FROM (SELECT event_id, ts + INTERVAL 75 DAY AS t FROM events)))""")
def due_editorial_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts that are due at the time of every event, 75 days later: before and after the clocks change."""
    rows = read(spark, sf_dir, "events", "event_id", "ts").select(F.col("event_id").alias("id"), F.explode(editorial.due_slots(F.col("ts") + F.expr("INTERVAL 75 DAYS"))).alias("slot"))
    return rows.select("id", "slot.cadence", "slot.day", editorial.topic_place(F.col("slot.cadence"), F.col("slot.day")).alias("topic_place"))


@query(r"""WITH p AS (SELECT conv_id AS post, turn AS section, text FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS text FROM conversations WHERE text IS NOT NULL)),
  each AS (SELECT post, section, count(*) AS n, count(*) FILTER (WHERE length(text) NOT BETWEEN 20 AND 1800) AS bad, sum(len(regexp_extract_all(text, '\S+'))) AS words FROM p GROUP BY ALL),
  parts AS (SELECT conv_id AS post, count(*) AS sections, count(*) FILTER (WHERE coalesce(n NOT BETWEEN 1 AND 4, true) OR bad > 0) AS bad, coalesce(sum(words), 0)::BIGINT AS words FROM conversations LEFT JOIN each ON post = conv_id AND section = turn GROUP BY conv_id),
  posts AS (SELECT conv_id AS post, min_by(regexp_extract(coalesce(text, ''), '^[^.\n]*'), turn) AS title, min_by(left(coalesce(text, ''), 200), turn) AS summary FROM conversations GROUP BY conv_id),
  known AS (SELECT DISTINCT lower(trim(regexp_extract(coalesce(text, ''), '^[^.\n]*'))) AS k FROM conversations WHERE turn = 1)
  SELECT post, CASE WHEN length(trim(title)) NOT BETWEEN 10 AND 120 THEN 'Invalid title' WHEN length(trim(summary)) NOT BETWEEN 40 AND 320 THEN 'Invalid summary' WHEN lower(trim(title)) IN (SELECT k FROM known) THEN 'Duplicate title' WHEN sections NOT BETWEEN 2 AND 7 THEN 'Invalid sections' WHEN bad > 0 THEN 'Invalid paragraphs'
    WHEN words NOT BETWEEN CASE WHEN post % 2 = 0 THEN 130 ELSE 450 END AND CASE WHEN post % 2 = 0 THEN 300 ELSE 900 END THEN 'Invalid word count: ' || words END AS problem, words,
    CASE WHEN post % 2 = 0 THEN CASE WHEN words < 160 THEN 'add ' || (160 - words) WHEN words > 230 THEN 'cut ' || (words - 230) END ELSE CASE WHEN words < 550 THEN 'add ' || (550 - words) WHEN words > 750 THEN 'cut ' || (words - 750) END END AS hint FROM posts JOIN parts USING (post)""")
def post_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as posts, a turn a section: the first rule that each breaks, and what its length lacks."""
    rows = read(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumnsRenamed({"conv_id": "post", "turn": "section"})
    body = F.coalesce("text", F.lit(""))
    title = F.regexp_extract(body, r"^[^.\n]*", 0)
    posts = rows.groupBy("post").agg(F.min_by(F.struct(title.alias("title"), F.substring(body, 1, 200).alias("summary")), "section").alias("p")).select("post", F.when(F.col("post") % 2 == 0, "daily").otherwise("weekly").alias("cadence"), "p.*")
    sections = rows.select("post", "section", F.concat(F.lit("Part "), "section").alias("heading"))
    paragraphs = rows.where("text IS NOT NULL").select("post", "section", F.explode(F.split("text", "\n")).alias("text"))
    return editorial.post_problems(posts, sections, paragraphs, rows.where("section = 1").select(title.alias("title")))


@query("""SELECT id, t - to_minutes(m) AS instant, strftime(t - to_minutes(m), '%a, %d %b %Y %H:%M:%S +0000') AS written FROM (SELECT o_orderkey AS id, o_orderdate::TIMESTAMP + to_seconds(o_orderkey % 86400) AS t, [0, 60, -330, -300, 0][(o_orderkey % 5 + 1)::INT] AS m FROM orders)""")
def mail_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of orders, written as mail dates of several zones, as instants and in one form."""
    zone = F.element_at(F.array(*map(F.lit, (" GMT", " +0100", " -0530", " EST", ""))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    at = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("o_orderkey") % 86400)
    rows = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select(F.col("o_orderkey").alias("id"), dates.mail_instant(F.concat(F.date_format(at, "EEE, d MMM yyyy HH:mm:ss"), zone)).alias("instant"))
    return rows.select("id", "instant", dates.mail_date(F.col("instant")).alias("written"))


@query("SELECT doc_id AS id, nullif(substr(trim(text, ' '), 1, 120), '') AS shown, trim(regexp_replace(regexp_replace(replace(replace(lower(coalesce(text, '')), '''', ''), '’', ''), '[-_/|,:;()\\[\\]&+]+', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM documents")
def clean_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as it may be shown (trimmed, cut, empty as null), and as terms are matched in it."""
    return read(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), text.trim_to_null(F.col("text"), 120).alias("shown"), text.norm_listing(F.col("text")).alias("plain"))


@query("SELECT id, name, (SELECT count(*) > 48 FROM venues WHERE visible AND council = 3) AS has_more FROM venues WHERE visible AND council = 3 ORDER BY name, id LIMIT 48", VENUES)
def page_with_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A council's first page, and whether there is another, from one row too many."""
    rows, more = paging.has_more(venues(spark, sf_dir).where("visible AND council = 3").select("id", "name"), [F.col("name"), F.col("id")], 48)
    return rows.withColumn("has_more", F.lit(more))


@query("""SELECT local::DATE AS day, hour(local)::INT AS hour, count(*)::BIGINT AS n FROM (SELECT CASE WHEN t >= TIMESTAMP '2024-03-31 01:00' THEN t + INTERVAL 1 HOUR ELSE t END AS local FROM (SELECT ts + INTERVAL 75 DAY AS t FROM events)) GROUP BY ALL""")
def london_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events by London day and hour, 75 days later: before and after the clocks change."""
    at = F.col("ts") + F.expr("INTERVAL 75 DAYS")
    return read(spark, sf_dir, "events", "ts").groupBy(dates.london_date(at).alias("day"), F.hour(dates.to_london(at)).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, CASE WHEN council = 3 AND free THEN 'reviewed' ELSE 'open' END AS status FROM venues", VENUES)
def reviewed_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change of one council's free venues, made only if they are as many as the plan, here the council's own sums, says."""
    rows = venues(spark, sf_dir).select("id", "council", "free")
    planned = rows.groupBy("council").agg(F.count(F.when(F.col("free"), 1)).alias("n")).where("council = 3").agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).collect()[0]["n"]
    cohort = merge.assert_count(rows.where("council = 3 AND free").select("id"), planned)
    return rows.join(cohort.withColumn("hit", F.lit(True)), "id", "left").select("id", F.when(F.col("hit"), "reviewed").otherwise("open").alias("status"))


@query("""SELECT conv_id AS batch, count(*)::BIGINT AS expected, count(DISTINCT a)::BIGINT AS received, CASE WHEN count(*) <> count(DISTINCT a) THEN 'missing/duplicate/out-of-range article results' END AS warning
  FROM (SELECT c.conv_id, c.turn, CASE WHEN EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.conv_id % 4 <> 0 AND c.turn = CASE WHEN d.turn % 5 = 3 THEN d.turn - 1 ELSE d.turn END) THEN c.turn END AS a FROM conversations c) GROUP BY conv_id""")
def answered_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as batches of items, with answers of which some state another's index or none: which batches are not answered whole."""
    rows = read(spark, sf_dir, "conversations", "conv_id", "turn", "role").select(F.col("conv_id").alias("batch"), F.col("turn").cast("int").alias("index"), "role")
    stated = F.when(F.col("batch") % 4 == 0, F.concat(F.lit("x"), "index")).when(F.col("index") % 5 == 3, (F.col("index") - 1).cast("string")).otherwise(F.col("index").cast("string"))
    answers = rows.select("batch", F.col("index").alias("place"), stated.alias("i"), F.col("role").alias("answer"))
    return geography.attached(answers, rows.select("batch", "index"))[1]
