"""Queries over news and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townkit.functions import text
from townkit.operators import eligibility, identity, numbering, ranking, views
from townkit.plans.registry import query
from townkit.sources import documents
from townkit.sources.tables import NEWS, news, read

TODAY = "2024-01-31"


@query(f"SELECT id, title, source, relevance FROM news WHERE relevance >= 3 AND NOT hidden AND published > DATE '{TODAY}' - 14", NEWS)
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.feed_items(news(spark, sf_dir), TODAY).select("id", "title", "source", "relevance")


@query("SELECT id, regexp_replace(lower(regexp_replace(title, ' - [^-]*$', '')), '[^a-z0-9]+', '', 'g') AS key, length(title) AS n FROM news", NEWS)
def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news(spark, sf_dir).select("id", text.title_key(F.col("title")).alias("key"), F.length("title").cast("long").alias("n"))


@query("""SELECT id FROM news a WHERE id % 3 <> 0 AND title <> '' AND NOT EXISTS (SELECT 1 FROM news b WHERE b.id % 3 = 0 AND lower(b.title) = lower(a.title))""", NEWS)
def seen_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News whose title is not stored yet."""
    rows = news(spark, sf_dir).withColumn("low", F.lower("title"))
    stored = rows.where("id % 3 = 0").select("low").distinct()
    return rows.where("id % 3 <> 0 AND title <> ''").join(stored, "low", "left_anti").select("id")


WORDS = "list_distinct(list_filter(string_split(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= 3))"


@query(f""", sets AS (SELECT id, list_sort({WORDS}) AS w FROM news), classes AS (SELECT w, min(id) AS id FROM sets WHERE len(w) >= 4 GROUP BY w)
  SELECT b.id AS id, a.id AS first_id, round(len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))), 6) AS similarity
  FROM classes a JOIN classes b ON a.id < b.id WHERE len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) >= 0.6
  UNION ALL SELECT s.id, c.id, 1.0::DOUBLE FROM sets s JOIN classes c ON s.w = c.w AND s.id <> c.id""", "news AS (SELECT doc_id AS id, regexp_replace(regexp_extract(coalesce(text, ''), '^[^.\\n]*', 0), ' - [^-]*$', '') AS title FROM documents)")
def jaccard_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines of equal words with the first of them, and pairs of such classes whose words are 0.6 alike."""
    rows = news(spark, sf_dir).select("id", text.word_set(F.col("title")).alias("words"))
    return identity.near_classes(rows).select("id", "first_id", F.round("similarity", 6).alias("similarity"))


@query("""SELECT id, story, row_number() OVER (PARTITION BY story ORDER BY relevance DESC, official DESC, id) = 1 AND story NOT IN (SELECT title FROM news WHERE id % 10 = 0) AS "primary"
  FROM (SELECT id, title AS story, relevance, source = 'src0' AS official FROM news WHERE id % 10 <> 0)""", NEWS)
def story_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One primary row of each new story; official sources win ties."""
    rows = news(spark, sf_dir).withColumnRenamed("title", "story").withColumn("official", F.col("source") == "src0")
    return identity.story_groups(rows.where("id % 10 <> 0").select("id", "story", "relevance", "official"), rows.where("id % 10 = 0")).select("id", "story", "primary")


@query("""SELECT id FROM (SELECT id, CASE id % 6 WHEN 0 THEN 'uk' WHEN 5 THEN NULL WHEN 4 THEN 'wales' ELSE 'england' END AS n, CASE WHEN id % 6 IN (1, 2) THEN 'region' || (id % 4) END AS r, CASE WHEN id % 6 = 2 THEN 'district' || (id % 5) END AS d FROM news)
  WHERE n = 'uk' OR n IS NULL OR (n = 'england' AND r IS NULL AND d IS NULL) OR (r = 'region1' AND d IS NULL) OR d = 'district2'""", NEWS)
def news_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News for one district: its own, its region's, the nation's, the country's and what has no place."""
    rows = news(spark, sf_dir).selectExpr(
        "id", "CASE id % 6 WHEN 0 THEN 'uk' WHEN 5 THEN NULL WHEN 4 THEN 'wales' ELSE 'england' END AS geo_nation", "CASE WHEN id % 6 IN (1, 2) THEN concat('region', id % 4) END AS geo_region",
        "CASE WHEN id % 6 = 2 THEN concat('district', id % 5) END AS geo_district", "CAST(NULL AS string) AS geo_county",
    )
    return views.news_near(rows, "england", "region1", "district2").select("id")


@query("""SELECT id, CASE WHEN title = '' THEN 'no_title' WHEN regexp_matches(lower(title), '(^|[^a-z])(the|des)($|[^a-z])') THEN 'blocked' WHEN length(title) < 20 THEN 'short' END AS reason FROM news""", NEWS)
def prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a headline is not scored."""
    title = F.col("title")
    rules = (("no_title", title == ""), ("blocked", F.lower(title).rlike(r"(^|[^a-z])(the|des)($|[^a-z])")), ("short", F.length(title) < 20))
    return news(spark, sf_dir).select("id", eligibility.first_reason(*rules).alias("reason"))


@query("SELECT strftime(published, '%Y-%m') AS month, region, count(*)::BIGINT AS n, count(*) FILTER (WHERE relevance >= 3)::BIGINT AS relevant FROM news GROUP BY 1, 2", NEWS)
def monthly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news(spark, sf_dir).groupBy(F.date_format("published", "yyyy-MM").alias("month"), "region").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("relevance") >= 3, 1)).alias("relevant"))


@query("""SELECT source, id FROM (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM news) WHERE k % greatest(1, n // 10) = 0 AND k / greatest(1, n // 10) < 10""", NEWS)
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten of each source at an even stride."""
    return ranking.every(news(spark, sf_dir).select("source", "id"), ["source"], [F.col("id")], 10)


@query("""SELECT source, id, least(length(text), greatest(0, 20000 - before))::BIGINT AS taken FROM (SELECT source, doc_id AS id, text, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT source, doc_id, coalesce(text, '') AS text FROM documents)) WHERE before < 20000""")
def text_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many characters of each text fit into 20,000 a source, in order: only lengths are sorted, not texts."""
    rows = read(spark, sf_dir, "documents", "doc_id", "source", "text").select("source", F.col("doc_id").alias("id"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    spent = numbering.numbered_in_groups(rows, ["source"], [F.col("id")], "n").where("before < 20000")
    return spent.select("source", "id", F.least(F.col("n").cast("long"), 20000 - F.col("before")).alias("taken"))


@query("""SELECT source, array_to_string(list_filter([CASE WHEN n > 40 THEN 'many' END, CASE WHEN bad * 5 > n THEN 'low_quality' END, CASE WHEN short > 0 THEN 'short' END], lambda x: x IS NOT NULL), ',') AS reasons,
  CASE WHEN bad * 2 > n THEN 'failed' WHEN n > 40 OR bad * 5 > n OR short > 0 THEN 'degraded' ELSE 'ok' END AS status
  FROM (SELECT source, count(*) AS n, count(*) FILTER (WHERE relevance < 2) AS bad, count(*) FILTER (WHERE length(title) < 10) AS short FROM news GROUP BY source)""", NEWS)
def failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons and status of each source's run from its counters."""
    n, bad, short = F.col("n"), F.col("bad"), F.col("short")
    counted = news(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("relevance") < 2, 1)).alias("bad"), F.count(F.when(F.length("title") < 10, 1)).alias("short"))
    reasons = eligibility.all_reasons(("many", n > 40), ("low_quality", bad * 5 > n), ("short", short > 0))
    return counted.select("source", F.array_join(reasons, ",").alias("reasons"), F.when(bad * 2 > n, "failed").when(F.size(reasons) > 0, "degraded").otherwise("ok").alias("status"))


@query("SELECT lang, quality, count(*)::BIGINT AS n, round(avg(CASE WHEN toxic = 0 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, avg(CASE WHEN toxic = 0 THEN 1.0 ELSE 0.0 END) >= 0.9 AS met FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2")
def review_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass rate of reviewed rows against a target of 90 %."""
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents", "doc_id", "lang"), "doc_id")
    rate = F.avg((F.col("toxic") == 0).cast("double"))
    return rows.groupBy("lang", "quality").agg(F.count(F.lit(1)).alias("n"), F.round(rate, 6).alias("pass_rate"), (rate >= 0.9).alias("met"))


@query("SELECT source, sum(n_chars)::BIGINT AS chars, count(*)::BIGINT AS docs, count(DISTINCT md5(coalesce(text, '')))::BIGINT AS distinct_texts FROM documents GROUP BY source")
def structural_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct contents of each source, by digest."""
    rows = read(spark, sf_dir, "documents", "source", "n_chars", "text").select("source", "n_chars", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    return rows.groupBy("source").agg(F.sum("n_chars").alias("chars"), F.count(F.lit(1)).alias("docs"), F.count_distinct("digest").alias("distinct_texts"))


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and structure of every page."""
    found = documents.read_pages(read(spark, sf_dir, "pages"))
    return found.select("page_id", "title", "heading", F.length("text").alias("n_chars"), F.size("links").alias("n_links"), "n_rows", "n_events")


@query()
def detail_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first links of each page that may lead to details on its own host."""
    pages = read(spark, sf_dir, "pages")
    return documents.detail_links(documents.read_pages(pages), pages, r"^https?://[^/]+/[A-Za-z]")


@query("SELECT page_id, trim(regexp_replace(regexp_replace(coalesce(regexp_extract(html, '<title>([^<]*)', 1), ''), '&amp;', '&', 'g'), '\\s+', ' ', 'g')) AS title, regexp_extract(html, '<html lang=\"([a-z]*)\"', 1) AS lang, length(html)::BIGINT AS n FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and language of every page, by columns alone."""
    title = text.collapse_spaces(F.replace(F.regexp_extract("html", r"<title>([^<]*)", 1), F.lit("&amp;"), F.lit("&")))
    return read(spark, sf_dir, "pages").select("page_id", title.alias("title"), F.regexp_extract("html", r'<html lang="([a-z]*)"', 1).alias("lang"), F.length("html").cast("long").alias("n"))
