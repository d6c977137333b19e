"""The relations of the listings domain, as views over the supplied tables, and the same in SQL for checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, category, lat, lng, visible, free, council, postcode, fee."""
    c = read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category"),
        F.expr("49.0D + (c_custkey * 7919 % 1250) / 100.0D").alias("lat"), F.expr("-9.0D + (c_custkey * 104729 % 1150) / 100.0D").alias("lng"),
        (key % 17 != 0).alias("visible"), (F.col("c_acctbal") < 0).alias("free"), F.col("c_nationkey").alias("council"), F.col("c_acctbal").alias("fee"),
        F.expr("concat(substring('BCDEGHKLMNPRSTWY', cast(c_custkey % 16 AS int) + 1, 1), c_custkey % 20 + 1, ' ', c_custkey % 9 + 1, 'AB')").alias("postcode"),
    )


VENUES = """venues AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS category, 49.0::DOUBLE + (c_custkey * 7919 % 1250) / 100.0::DOUBLE AS lat,
  -9.0::DOUBLE + (c_custkey * 104729 % 1150) / 100.0::DOUBLE AS lng, c_custkey % 17 <> 0 AS visible, c_acctbal < 0 AS free, c_nationkey AS council, c_acctbal AS fee,
  substr('BCDEGHKLMNPRSTWY', (c_custkey % 16)::INT + 1, 1) || (c_custkey % 20 + 1) || ' ' || (c_custkey % 9 + 1) || 'AB' AS postcode FROM customer)"""


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, venue_id, title, kind, status, start, end, price, last_seen, url, of events and activities."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("venue_id"),
        F.expr("concat('The ', o_orderpriority, ' Session ', o_custkey % 50)").alias("title"),
        F.expr("if(substring(o_orderpriority, 1, 1) IN ('1', '2'), 'event', 'activity')").alias("kind"), F.col("o_orderstatus").alias("status"),
        F.expr("cast(o_orderdate AS date)").alias("start"), F.expr("if(o_orderkey % 7 = 0, NULL, date_add(cast(o_orderdate AS date), cast(o_orderkey % 5 AS int)))").alias("end"),
        F.col("o_totalprice").alias("price"), F.expr("date_add(cast(o_orderdate AS date), cast(o_custkey % 30 AS int))").alias("last_seen"),
        F.expr("concat('https://www.venue', o_custkey % 40, '.example.co.uk/Listing/', o_custkey % 300, '/#top')").alias("url"),
    )


LISTINGS = """listings AS (SELECT o_orderkey AS id, o_custkey AS venue_id, 'The ' || o_orderpriority || ' Session ' || (o_custkey % 50) AS title,
  CASE WHEN left(o_orderpriority, 1) IN ('1', '2') THEN 'event' ELSE 'activity' END AS kind, o_orderstatus AS status, o_orderdate::DATE AS start,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate::DATE + (o_orderkey % 5)::INT END AS "end", o_totalprice AS price, o_orderdate::DATE + (o_custkey % 30)::INT AS last_seen,
  'https://www.venue' || (o_custkey % 40) || '.example.co.uk/Listing/' || (o_custkey % 300) || '/#top' AS url FROM orders)"""


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, merchant, item, grp, was, price, pct, relevance, last_seen, link, flag, of line items with their parts."""
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate")
    parts = read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_name")
    return rows.join(parts, rows["l_partkey"] == parts["p_partkey"]).select(
        F.expr("concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', cast(round(l_extendedprice * 100) AS bigint))").alias("id"), F.col("l_suppkey").alias("merchant"), F.col("p_brand").alias("item"),
        F.col("p_type").alias("grp"), F.col("p_name").alias("title"), F.col("l_extendedprice").alias("was"), F.expr("round(l_extendedprice * (1 - abs(l_discount) * 4), 2)").alias("price"),
        F.expr("round(abs(l_discount) * 400, 1)").alias("pct"), F.expr("1 + l_linenumber % 5").alias("relevance"), F.expr("cast(l_shipdate AS date)").alias("last_seen"),
        F.expr("concat('https://shop', l_suppkey, '.example.com/', l_partkey)").alias("link"), F.col("l_returnflag").alias("flag"),
    )


OFFERS = """offers AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || round(l_extendedprice * 100)::BIGINT AS id, l_suppkey AS merchant, p_brand AS item, p_type AS grp, p_name AS title,
  l_extendedprice AS was, round(l_extendedprice * (1 - abs(l_discount) * 4), 2) AS price, round(abs(l_discount) * 400, 1) AS pct, 1 + l_linenumber % 5 AS relevance,
  l_shipdate::DATE AS last_seen, 'https://shop' || l_suppkey || '.example.com/' || l_partkey AS link, l_returnflag AS flag FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title (first sentence), source, region, relevance, published, hidden, of documents and their labels."""
    docs, labels = read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"), read(spark, sf_dir, "labels", "doc_id", "quality")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.regexp_extract(F.coalesce("text", F.lit("")), r"^[^.\n]*", 0).alias("title"), "source", F.col("lang").alias("region"),
        F.coalesce(F.col("quality") * 3 + F.col("doc_id") % 3, F.col("doc_id") % 6).alias("relevance"), F.expr("date_sub(date'2024-01-31', cast(doc_id % 40 AS int))").alias("published"), (F.col("doc_id") % 23 == 0).alias("hidden"),
    )


NEWS = """news AS (SELECT d.doc_id AS id, regexp_extract(coalesce(text, ''), '^[^.\\n]*', 0) AS title, source, lang AS region,
  coalesce(quality * 3 + d.doc_id % 3, d.doc_id % 6) AS relevance, DATE '2024-01-31' - (d.doc_id % 40)::INT AS published, d.doc_id % 23 = 0 AS hidden FROM documents d LEFT JOIN labels USING (doc_id))"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ts, series, kind, value, k, of events; props is JSON."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("series"), F.col("event_type").alias("kind"), "value", F.get_json_object("props", "$.k").cast("int").alias("k")
    )


SIGNALS = "signals AS (SELECT event_id AS seq, ts, user_id AS series, event_type AS kind, value, (props::JSON ->> '$.k')::INT AS k FROM events)"
