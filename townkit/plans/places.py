"""Queries over places: matching, hierarchies, alias chains, merges of stored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townkit.functions import places, text
from townkit.operators import graph, matching, merge, views
from townkit.plans.registry import query
from townkit.sources.tables import LISTINGS, VENUES, listings, read, venues


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_size")


@query("""SELECT candidate, "match", round(score, 6) AS score FROM (SELECT a.p_partkey AS candidate, b.p_partkey AS "match", CASE WHEN a.p_name = b.p_name THEN 1.0 ELSE
  len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' ')))::DOUBLE / len(list_distinct(list_concat(string_split(a.p_name, ' '), string_split(b.p_name, ' ')))) END AS score,
  row_number() OVER (PARTITION BY a.p_partkey ORDER BY CASE WHEN a.p_name = b.p_name THEN 1.0 ELSE len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' ')))::DOUBLE / len(list_distinct(list_concat(string_split(a.p_name, ' '), string_split(b.p_name, ' ')))) END DESC, b.p_partkey) AS n
  FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey % 2 = 0 AND b.p_partkey % 2 = 1) WHERE n = 1 AND score >= 0.3""")
def fuzzy_block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most alike name of the same brand, by shared words."""
    rows = part_names(spark, sf_dir)
    candidates = rows.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("candidate"), F.col("p_name").alias("name"), "p_brand")
    stored = rows.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("match"), F.col("p_name").alias("stored_name"), "p_brand")
    return matching.token_matches(candidates, stored, "p_brand", 0.3).select("candidate", "match", F.round("score", 6).alias("score"))


@query()
def fuzzy_ratio_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most alike name of the same brand and size, by the Ratcliff-Obershelp ratio."""
    rows = part_names(spark, sf_dir).withColumn("block", F.concat_ws("|", "p_brand", "p_size"))
    candidates = rows.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("candidate"), F.col("p_name").alias("name"), "block")
    stored = rows.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("match"), F.col("p_name").alias("stored_name"), "block")
    return matching.ratio_matches(candidates, stored, "block", 0.55).select("candidate", "match", F.round("score", 6).alias("score"))


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return venues(spark, sf_dir).select(
        F.col("id").alias("candidate"), text.norm_name(F.concat(F.col("name"), F.when(F.col("id") % 2 == 0, " Ltd").otherwise(" Annex"))).alias("name"), "postcode", (F.col("lat") + 0.0005).alias("lat"), "lng",
        (F.col("lat") - 0.002).alias("south"), (F.col("lat") + 0.002).alias("north"), (F.col("lng") - 0.002).alias("west"), (F.col("lng") + 0.002).alias("east"),
    )


def stored_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return venues(spark, sf_dir).select(F.col("id").alias("match"), text.norm_name(F.col("name")).alias("stored_name"), "postcode", "lat", "lng")


@query()
def reference_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference rows matched by postcode and name, or by nearness and name."""
    return matching.reference_matches(spots(spark, sf_dir), stored_places(spark, sf_dir)).select("candidate", "match", "method", F.round("confidence", 6).alias("confidence"))


@query()
def spatial_hash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovered spots: existing, possible or new."""
    return matching.discovery_matches(spots(spark, sf_dir), stored_places(spark, sf_dir))


@query("""SELECT candidate, CASE WHEN ok IS NULL THEN 'no_match' WHEN ok = 1 THEN 'matched' WHEN ok > 1 THEN 'ambiguous' ELSE 'review' END AS outcome, CASE WHEN ok = 1 THEN first END AS "match", coalesce(rejected, '') AS rejected FROM
  (SELECT id AS candidate FROM venues) LEFT JOIN (SELECT candidate, count(*) FILTER (WHERE reason IS NULL)::BIGINT AS ok, min("match") FILTER (WHERE reason IS NULL) AS first, coalesce(array_to_string(list_sort(list(DISTINCT reason) FILTER (WHERE reason IS NOT NULL)), ','), '') AS rejected
  FROM (SELECT a.id AS candidate, b.id AS "match", CASE WHEN b.id % 5 = 0 THEN 'closed' WHEN a.category <> b.category THEN 'type' WHEN 12742000.0::DOUBLE * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))) > 500000 THEN 'far' END AS reason
  FROM venues a JOIN venues b ON a.id % 700 = b.id % 700 AND b.id >= 100) GROUP BY candidate) USING (candidate)""", VENUES)
def identifier_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of one identifier, accepted or rejected with reasons."""
    rows = venues(spark, sf_dir).withColumn("link", F.col("id") % 700).withColumn("types", F.array("category"))
    stored = rows.where("id >= 100").withColumn("closed", F.col("id") % 5 == 0).withColumnRenamed("id", "match")
    return matching.identifier_matches(rows.withColumnRenamed("id", "candidate"), stored, 500_000.0)


@query()
def greedy_bipartite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one pairs of parts of a brand and size, the most alike first."""
    rows = part_names(spark, sf_dir).withColumn("block", F.concat_ws("|", "p_brand", "p_size"))
    a, b = rows.where("p_partkey % 2 = 0").select("block", F.col("p_partkey").alias("left"), F.col("p_name").alias("name")), rows.where("p_partkey % 2 = 1").select("block", F.col("p_partkey").alias("right"), F.col("p_name").alias("stored_name"))
    return matching.greedy_named_pairs(a, b, "block", text.jaccard(F.split("name", " "), F.split("stored_name", " ")))


@query()
def resolve_venue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The venue that a listing's address means."""
    rows = venues(spark, sf_dir)
    items = rows.where("id % 2 = 0").select(F.col("id").alias("item"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("The "), F.col("name"))).otherwise(F.concat(F.col("name"), F.lit(" annex"))).alias("name"), F.when(F.col("id") % 10 != 0, F.col("postcode")).alias("postcode"))
    return matching.resolve(items, rows.select(F.col("id").alias("venue_id"), F.col("name").alias("venue_name"), "postcode"))


EDGES_SQL = """edges AS (SELECT 'customer' || c_custkey AS child, 'nation' || c_nationkey AS parent FROM customer UNION ALL SELECT 'nation' || n_nationkey, 'region' || n_regionkey FROM nation UNION ALL SELECT 'region' || r_regionkey, 'world' FROM region)"""


@query(""", one AS (SELECT child, parent AS ancestor, 1 AS depth FROM edges), two AS (SELECT u.child, e.parent AS ancestor, 2 AS depth FROM one u JOIN edges e ON e.child = u.ancestor), three AS (SELECT u.child, e.parent AS ancestor, 3 AS depth FROM two u JOIN edges e ON e.child = u.ancestor)
  SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three""", EDGES_SQL)
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All areas above each area."""
    edges = read(spark, sf_dir, "customer").selectExpr("concat('customer', c_custkey) AS child", "concat('nation', c_nationkey) AS parent")
    edges = edges.union(read(spark, sf_dir, "nation").selectExpr("concat('nation', n_nationkey)", "concat('region', n_regionkey)")).union(read(spark, sf_dir, "region").selectExpr("concat('region', r_regionkey)", "'world'"))
    return graph.ancestors(edges)


@query("""SELECT id, CASE WHEN NOT lost THEN root END AS canonical, CASE WHEN NOT lost THEN (id - root)::INT END AS hops FROM (SELECT id, root, EXISTS (SELECT 1 FROM customer x WHERE x.c_custkey % 97 = 5 AND x.c_custkey // 8 = id // 8 AND x.c_custkey BETWEEN root AND id) AS lost
  FROM (SELECT c_custkey AS id, greatest((c_custkey // 8) * 8, CASE WHEN c_custkey >= 5 THEN (c_custkey - 5) // 40 * 40 + 5 ELSE 0 END) AS root FROM customer))""")
def canonical_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of each row's chain of merges: the first of its eight, or a row of its own chain that was never merged; rows whose chain meets a cycle have none."""
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    target = F.when(F.col("id") % 97 == 5, F.col("id")).when((F.col("id") % 8 != 0) & (F.col("id") % 40 != 5), F.col("id") - 1)
    return graph.canonical(rows.withColumn("merged_into", target), "id", "merged_into", lost=True)


@query("""SELECT c_custkey AS id, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND a <> b THEN 'conflict' ELSE coalesce(a, b) END AS country FROM (SELECT c_custkey, ['england', 'scotland', 'wales', 'northern_ireland', NULL][c_custkey % 5 + 1] AS a, ['england', 'scotland', 'wales', NULL, NULL, NULL][c_nationkey % 6 + 1] AS b FROM customer)""")
def resolve_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = lambda letters, n: F.concat(F.element_at(F.split(F.lit(letters), ","), n.cast("int") + 1), F.lit("01"))
    rows = read(spark, sf_dir, "customer")
    return rows.select(F.col("c_custkey").alias("id"), places.resolve_country(code("E,S,W,N,X", F.col("c_custkey") % 5), code("E,S,W,X,X,X", F.col("c_nationkey") % 6)).alias("country"))


@query("""SELECT id FROM venues WHERE id NOT IN (SELECT venue_id FROM listings WHERE (status <> 'F' AND DATE '2001-06-15' - start < 180) OR (status = 'F' AND DATE '2001-06-15' - start < 7)) ORDER BY id LIMIT 10""", VENUES, LISTINGS)
def due_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten venues without a fresh run: a success counts for 180 days, a failure for 7."""
    runs = listings(spark, sf_dir).select(F.col("venue_id").alias("id"), (F.col("status") != "F").alias("ok"), F.col("start").cast("timestamp_ntz").alias("ran_at"))
    return views.due(venues(spark, sf_dir).select("id"), runs, "2001-06-15 00:00:00")


@query("""SELECT id, CASE WHEN good THEN greatest(last_seen, DATE '2001-07-01')::VARCHAR ELSE last_seen::VARCHAR END AS last_seen FROM (SELECT id, last_seen, venue_id % 3 <> 0 AND venue_id % 5 <> 0 AS good FROM listings WHERE kind = 'activity')""", LISTINGS)
def freshness_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activities take their source's check as last seen, if it succeeded and found nothing changed."""
    rows = listings(spark, sf_dir).where("kind = 'activity'").select("id", F.col("venue_id").alias("source"), "last_seen")
    checks = venues(spark, sf_dir).select(
        F.col("id").alias("source"), F.lit("2001-07-01").cast("date").alias("checked"), (F.col("id") % 3 != 0).alias("ok"), F.lit("h").alias("hash"), F.when(F.col("id") % 5 == 0, "old").otherwise("h").alias("old_hash"), F.lit(None).cast("string").alias("error")
    )
    return merge.refresh_seen(rows, checks).select("id", F.col("last_seen").cast("string").alias("last_seen"))


@query("""SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL OR (o.id IS NOT NULL AND o.id % 5 = 0) THEN o.name ELSE n.name END AS name, coalesce(n.category, o.category) AS category, CASE WHEN o.id IS NULL THEN n.fee ELSE coalesce(o.fee, n.fee) END AS fee
  FROM (SELECT id, name, category, CASE WHEN id % 4 = 0 THEN NULL ELSE fee END AS fee FROM venues WHERE id % 10 <> 9) o FULL JOIN (SELECT id, 'New ' || name AS name, CASE WHEN id % 2 = 0 THEN NULL ELSE 'CHANGED' END AS category, fee + 1 AS fee FROM venues WHERE id % 10 = 9 OR id % 3 = 0) n ON o.id = n.id""", VENUES)
def protected_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed rows keep their names; categories stay where the change has none; fees are only filled."""
    rows = venues(spark, sf_dir).select("id", "name", "category", "fee")
    current = rows.where("id % 10 <> 9").withColumn("fee", F.when(F.col("id") % 4 != 0, F.col("fee")))
    delta = rows.where("id % 10 = 9 OR id % 3 = 0").select("id", F.concat(F.lit("New "), F.col("name")).alias("name"), F.when(F.col("id") % 2 != 0, "CHANGED").alias("category"), (F.col("fee") + 1).alias("fee"))
    return merge.merge(current, delta, ["id"], {"category": "keep", "fee": "fill"}, F.col("id") % 5 == 0, ("name",))


@query("SELECT id, CASE WHEN id % 5 >= 3 THEN 'New' ELSE name END AS name FROM venues", VENUES)
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert, then rows that are only added where absent."""
    rows = venues(spark, sf_dir).select("id", "name")
    changed = merge.upsert(rows.where("id % 5 <> 4"), rows.where("id % 5 = 3").withColumn("name", F.lit("New")), ["id"])
    return merge.insert_absent(changed, rows.where("id % 5 >= 2").withColumn("name", F.lit("New")), ["id"])


@query("""SELECT id, CASE WHEN (CASE WHEN id % 6 = 0 AND id % 9 <> 0 THEN CASE WHEN id % 12 = 0 THEN 'expired' ELSE 'review' END ELSE 'live' END) = 'live' AND start < DATE '1999-01-01' THEN 'expired' WHEN id % 6 = 0 AND id % 9 <> 0 THEN CASE WHEN id % 12 = 0 THEN 'expired' ELSE 'review' END ELSE 'live' END AS status FROM listings""", LISTINGS)
def status_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected rows expire or go to review, unless accepted in the same run; what is past its date expires."""
    rows = listings(spark, sf_dir).select("id", F.lit("live").alias("status"), F.col("start").alias("expires"))
    rejected = rows.where("id % 6 = 0").select("id", F.when(F.col("id") % 12 == 0, "gone: page").otherwise("price").alias("reason"))
    return merge.expire(rows, rejected, rows.where("id % 9 = 0").select("id"), "id", F.lit("1999-01-01").cast("date")).select("id", "status")


@query("""SELECT md5(string_agg(h, '' ORDER BY part)) AS fingerprint, sum(n)::BIGINT AS n FROM (SELECT id // 1024 AS part, md5(string_agg(md5(name || '|' || category), '' ORDER BY id)) AS h, count(*) AS n FROM venues GROUP BY 1)""", VENUES)
def sorted_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.fingerprint(venues(spark, sf_dir), "id", "name", "category")


@query("SELECT id, CASE WHEN id % 3 <> 0 THEN 'none' WHEN id % 6 = 0 THEN 'applied' ELSE 'stale' END AS applied, CASE WHEN id % 6 = 0 THEN 'Renamed' ELSE name END AS name FROM venues", VENUES)
def guarded_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned changes apply only to rows that are still as they were planned."""
    rows = venues(spark, sf_dir).select("id", "name", "category")
    plan = rows.where("id % 3 = 0").select("id", F.when(F.col("id") % 6 == 0, F.md5(F.to_json(F.struct("category", "id", "name")))).otherwise("old").alias("expected"), F.lit("Renamed").alias("value"))
    return merge.apply_plan(rows, plan, "id", "name").select("id", "applied", "name")


@query("SELECT id, name FROM venues WHERE fee >= 0 OR fee IS NULL", VENUES)
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.retained(venues(spark, sf_dir), "fee", F.lit(0.0)).select("id", "name")
