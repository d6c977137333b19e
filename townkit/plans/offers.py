"""Queries over offers: eligibility, reasons, best of each item, budgets, terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townkit.functions import money
from townkit.operators import eligibility, identity, programme, ranking, rules, terms
from townkit.plans.registry import query
from townkit.sources.tables import OFFERS, offers, read

TODAY = "2000-06-15"
WORTH = "((was - price >= 10 AND pct >= 10) OR (was - price >= 1 AND pct >= 20))"
SCORE = f"(relevance * 10 + greatest(0, 10 - (DATE '{TODAY}' - last_seen)) + least(40.0, pct))"
ELIGIBLE = f"relevance >= 3 AND (DATE '{TODAY}' - last_seen) BETWEEN 0 AND 30 AND {WORTH} AND abs((was - price) / was * 100 - pct) <= 0.2"


@query(f"SELECT id, merchant, price, pct FROM offers WHERE {ELIGIBLE}", OFFERS)
def eligible_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligibility.eligible_offers(offers(spark, sf_dir), TODAY, 30).select("id", "merchant", "price", "pct")


REASON = f"""CASE WHEN price IS NULL OR price <= 0 THEN 'no_price' WHEN price >= was THEN 'price_not_lower' WHEN relevance < 2 THEN 'not_relevant'
  WHEN last_seen > DATE '{TODAY}' THEN 'future' WHEN NOT {WORTH} THEN 'small_saving' END"""


@query(f"SELECT id, {REASON} AS reason FROM offers", OFFERS)
def offer_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers(spark, sf_dir).select("id", eligibility.offer_reason(TODAY).alias("reason"))


@query(f"SELECT coalesce({REASON}, 'kept') AS reason, count(*)::BIGINT AS n FROM offers GROUP BY 1", OFFERS)
def reason_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.concat(eligibility.offer_reason(TODAY), F.lit(": "), F.col("id"))
    return eligibility.reason_counts(offers(spark, sf_dir).select(reason.alias("reason")))


@query(f"SELECT item, id, {SCORE}::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY {SCORE} DESC, id) AS n FROM offers WHERE {ELIGIBLE}) WHERE n = 1", OFFERS)
def best_offer_per_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = eligibility.eligible_offers(offers(spark, sf_dir), TODAY, 30).withColumn("score", eligibility.offer_score(TODAY).cast("double"))
    return identity.best_per_key(rows.select("item", "id", "score"), "item", "score")


@query()
def greedy_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hundred of the items' best offers, each taken merchant and group making later ones of it worth less."""
    rows = eligibility.eligible_offers(offers(spark, sf_dir), TODAY, 30).withColumn("score", eligibility.offer_score(TODAY).cast("double"))
    return ranking.greedy_diverse(identity.best_per_key(rows.select("item", "id", "score", "merchant", "grp", "link"), "item", "score"), 100)


@query("SELECT p_type AS grp, count(*)::BIGINT AS n, round(avg(l_extendedprice), 4) AS mean FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 10 GROUP BY 1")
def dim_inner_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers of the active part of a dimension; the sums by item meet the dimension, not the rows."""
    sums = read(spark, sf_dir, "lineitem", "l_partkey", "l_extendedprice").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("s"))
    active = read(spark, sf_dir, "part", "p_partkey", "p_type", "p_size").where("p_size <= 10")
    return sums.join(active, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_type").alias("grp")).agg(F.sum("n").alias("n"), F.round(F.sum("s") / F.sum("n"), 4).alias("mean"))


TERMS = [("toys", "widget; red widget"), ("rings", "rings"), ("bolts", "bolt"), ("small", "small ring"), ("gear", "gear;blue gear")]


@query("""SELECT p_partkey AS id, item, term, CASE WHEN p_size <= 20 OR strong THEN 'strong' ELSE 'weak' END AS strength FROM (SELECT p_partkey, p_size, item, term, strong, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN p_size <= 20 OR strong THEN 0 ELSE 1 END, -length(term), NOT strong, term) AS n FROM part
  JOIN (VALUES ('toys', 'widget', true), ('toys', 'red widget', false), ('rings', 'rings', true), ('rings', 'ring', true), ('bolts', 'bolt', false), ('small', 'small ring', true), ('gear', 'gear', true), ('gear', 'blue gear', false)) t(item, term, strong)
  ON regexp_matches(lower(p_name), '(^|[^a-z0-9])' || term || '(s|es)?($|[^a-z0-9])')) WHERE n = 1""")
def regex_term_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item of the longest term in each name: any where the size is for children, else a strong one first."""
    items = spark.createDataFrame([(item, words, "B" if item == "bolts" else "A", False, True, n) for n, (item, words) in enumerate(TERMS)], "item string, uk_terms string, tier string, needs_child boolean, active boolean, place int")
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_size") <= 20, "for children").alias("description"))
    return terms.match_items(rows, terms.item_terms(items, rules.has_child_word), rules.has_child_word)


@query("SELECT p_partkey AS id, CASE WHEN p_name LIKE '%bolt' THEN 'tools' ELSE 'adult' END AS reason, CASE WHEN p_name LIKE '%bolt' THEN 'Bolt' ELSE 'ring' END AS term FROM part WHERE p_name LIKE '%bolt' OR (p_name LIKE '%ring' AND p_size > 20)")
def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that a hard term excludes, or a soft one where the size is not for children."""
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), "p_size")
    known = spark.createDataFrame([("Bolt", True, "tools", 1), ("ring", False, "adult", 2)], "term string, hard boolean, reason string, place int")
    return terms.excluded(rows, known, F.col("p_size") <= 20)


@query(r"""SELECT id, max_by(item, (length(term), term)) AS item, max_by(term, (length(term), term)) AS term FROM
  (SELECT doc_id AS id, ' ' || array_to_string(regexp_extract_all(lower(regexp_extract(coalesce(text, ''), '^[^.\n]*')), '[a-z0-9]+'), ' ') || ' ' AS t FROM documents)
  JOIN (SELECT term, min(item) AS item FROM (SELECT item_id AS item, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark)) GROUP BY term)
  ON contains(t, ' ' || term || ' ') GROUP BY id""".replace("\\n", "\n"))
def phrases_in_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest of all pairs of neighbouring words of the benchmark that each document's first sentence holds."""
    clean = lambda c: F.array_join(terms.words_of(F.lower(c)), " ")
    w = terms.words_of(F.lower(F.col("text")))
    pairs = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), w.alias("w")).where(F.size("w") > 1)
    pairs = pairs.select("item", F.explode(F.transform(F.expr("sequence(1, size(w) - 1)"), lambda i: F.array_join(F.slice("w", i, 2), " "))).alias("term")).groupBy("term").agg(F.min("item").alias("item"))
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), clean(F.regexp_extract(F.coalesce("text", F.lit("")), r"^[^.\n]*", 0)).alias("title"))
    best = terms.term_pairs(rows, pairs, plural=False).groupBy("title").agg(F.max_by(F.struct("item", "term"), F.struct(F.length("term"), F.col("term"))).alias("b"))
    return rows.join(best, "title").select("id", "b.item", "b.term")


KEY_SQL = r"""CASE WHEN regexp_matches(s.title, '(?i)\b(kids (eat|go) free)\b') AND l_linenumber % 3 <> 0 AND l_discount > 0.05 THEN 'benefit:kids go free:shop' || l_suppkey
  WHEN l_partkey % 5 = 0 AND l_partkey <> 0 THEN 'taxonomy:' || CASE WHEN l_partkey % 2 = 0 THEN l_partkey % 40 + 1 ELSE l_partkey END || CASE WHEN l_returnflag = 'R' THEN ':https://shop' || l_suppkey ELSE '' END
  WHEN regexp_matches(p_name, 'ring') THEN 'item:rings' WHEN regexp_matches(p_name, '(red|blue) (bolt|gear)') THEN 'item:parts'
  WHEN regexp_matches(p_name, 'gizmo') AND p_size <= 25 THEN 'item:rings' WHEN p_size <= 25 THEN 'matched:' || lower(p_type) || ' 1' ELSE 'title:' || p_name || CASE WHEN l_discount > 0.05 THEN ' kids go free under 5' ELSE '' END END"""


@query(f"""SELECT key, id, price FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY price, id) AS n FROM (SELECT {KEY_SQL} AS key, l_orderkey || '-' || l_linenumber || '-' || l_suppkey || '-' || l_partkey AS id, l_extendedprice AS price
  FROM lineitem JOIN part ON l_partkey = p_partkey, LATERAL (SELECT p_name || CASE WHEN l_discount > 0.05 THEN ' kids go free under 5' ELSE '' END AS title) s)) WHERE n = 1""")
def best_of_programme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest offer of each kind: by benefit, taxonomy, words of title or matched item, or title without its price."""
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount", "l_returnflag")
    rows = rows.join(read(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    deals = rows.select(
        F.expr("concat_ws('-', l_orderkey, l_linenumber, l_suppkey, l_partkey)").alias("id"), F.col("l_extendedprice").alias("price"),
        F.expr("concat(p_name, ' £', p_size, '.50', if(l_discount > 0.05, ' Kids go free under 5', ''))").alias("title"), F.lit(None).cast("string").alias("description"), F.expr("concat('Shop', l_suppkey)").alias("retailer"),
        F.expr("if(l_linenumber % 3 = 0, 'quality-v1:source-page:merchant-advertised:x', 'quality-v1:source-api:y')").alias("classified_by"), F.expr("if(l_partkey % 5 = 0, l_partkey, 0)").alias("item_id"),
        F.expr("if(l_partkey % 2 = 0, l_partkey % 40 + 1, 0)").alias("equivalent_item_id"), F.expr("if(l_returnflag = 'R', 'service', 'product')").alias("deal_type"),
        F.expr("if(p_size <= 25, if(p_name LIKE '%gizmo', ' The Ring ', concat(p_type, '-1 ')), ' ')").alias("matched_item"), F.expr("concat('https://shop', l_suppkey)").alias("link"),
    )
    kinds = (("rings", ("ring", "rings")), ("parts", ("red", "blue"), ("bolt", "gear")))
    return deals.withColumn("key", programme.item_key(kinds)).groupBy("key").agg(F.min(F.struct("price", "id")).alias("b")).select("key", "b.id", "b.price")


@query("""SELECT p_partkey AS id, p_retailprice AS price, round(p_retailprice * 2, 2) AS was, 50.0::DOUBLE AS discount FROM part""")
def price_triple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices out of text like 'Was £1,200.00, now £600.00'."""
    shown = F.concat(F.lit("Offer! Was £"), F.format_number(F.col("p_retailprice") * 2, 2), F.lit(", now £"), F.format_number("p_retailprice", 2))
    parts = read(spark, sf_dir, "part", "p_partkey", "p_retailprice")
    # texts take longer to read than their rows' bytes tell: dealt by number
    parts = parts.repartition(max(1, -(-parts.count() // 50_000)))
    return money.with_prices(parts, shown).select(F.col("p_partkey").alias("id"), "price", "was", "discount")


@query(f"""SELECT id, turn, in_budget FROM (
  WITH a AS (SELECT id, merchant, item, {SCORE} AS s FROM offers WHERE {ELIGIBLE}),
  b AS (SELECT *, row_number() OVER (PARTITION BY merchant, item ORDER BY s DESC, id) AS variant, row_number() OVER (PARTITION BY merchant ORDER BY s DESC, id) AS seen FROM a),
  c AS (SELECT *, min(seen) OVER (PARTITION BY merchant, item) AS first FROM b),
  d AS (SELECT *, row_number() OVER (PARTITION BY merchant ORDER BY variant, first) AS turn FROM c),
  m AS (SELECT merchant, row_number() OVER (ORDER BY s DESC, id) AS place FROM d WHERE seen = 1)
  SELECT id, turn, row_number() OVER (ORDER BY turn, place) <= 120 AS in_budget FROM d JOIN m USING (merchant))""", OFFERS)
def two_level_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 120 offers by fair turns of merchants, and of items within a merchant."""
    rows = eligibility.eligible_offers(offers(spark, sf_dir), TODAY, 30).withColumn("score", eligibility.offer_score(TODAY).cast("double"))
    return ranking.two_level_round_robin(rows.select("id", "merchant", "item", "score"), "merchant", "item", [F.desc("score"), F.col("id")], 120).select("id", "turn", "in_budget")


@query("""SELECT grp, count(*)::BIGINT AS n, count(*) FILTER (WHERE pct >= 20)::BIGINT AS deep, round(sum(CASE WHEN flag = 'R' THEN price ELSE 0 END), 2) AS returned, max(top) / count(*) > 0.5 AS concentrated
  FROM (SELECT *, max(m) OVER (PARTITION BY grp) AS top FROM (SELECT *, count(*) OVER (PARTITION BY grp, merchant) AS m FROM offers)) GROUP BY grp""", OFFERS)
def status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of each group, with an alert where one merchant holds over half: two aggregates, the first of which has all rows' sums."""
    by_merchant = offers(spark, sf_dir).groupBy("grp", "merchant").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("pct") >= 20, 1)).alias("deep"), F.sum(F.when(F.col("flag") == "R", F.col("price")).otherwise(0.0)).alias("r"))
    return by_merchant.groupBy("grp").agg(F.sum("n").alias("n"), F.sum("deep").alias("deep"), F.round(F.sum("r"), 2).alias("returned"), (F.max("n") / F.sum("n") > 0.5).alias("concentrated"))


@query("""WITH s AS (SELECT p_brand, count(*) AS size FROM part GROUP BY 1),
  p AS (SELECT *, sum(size) OVER () AS n, least(1, size) AS least FROM s),
  q AS (SELECT *, CASE WHEN n <= 60 THEN size ELSE greatest(least, 60 * size // n) END AS part FROM p),
  o AS (SELECT p_brand, size::BIGINT AS size, n::BIGINT AS n, least::BIGINT AS least, part::BIGINT AS part, (sum(part) OVER () - least(60, n))::BIGINT AS over FROM q),
  g AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY CASE WHEN part < size THEN 60 * size - part * n END DESC NULLS LAST, p_brand) <= -over THEN 1 ELSE 0 END AS given FROM o),
  u AS (SELECT p_brand, over, unnest(range(least + 1, part + 1)) AS unit FROM o WHERE over > 0 AND part > least),
  t AS (SELECT p_brand, count(*) AS taken FROM (SELECT *, row_number() OVER (ORDER BY unit DESC, p_brand) AS place FROM u) WHERE place <= over GROUP BY 1)
  SELECT p_brand, (part + given - coalesce(taken, 0))::BIGINT AS drawn FROM g LEFT JOIN t USING (p_brand) WHERE part + given - coalesce(taken, 0) > 0""")
def stratified_alloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of 60 samples each brand gets, and how many it has."""
    rows = read(spark, sf_dir, "part", "p_partkey", "p_brand")
    drawn = ranking.stratified(rows, "p_brand", "p_partkey", 60, 1)
    return drawn.groupBy("p_brand").agg(F.count(F.lit(1)).alias("drawn"))


@query(f"SELECT merchant, id, price FROM (SELECT *, row_number() OVER (PARTITION BY merchant ORDER BY price, id) AS n FROM offers WHERE {WORTH}) WHERE n <= 3", OFFERS)
def head_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three cheapest worthwhile offers of each merchant."""
    rows = offers(spark, sf_dir).where(eligibility.worth_having(F.col("was") - F.col("price"), F.col("pct")))
    return ranking.first_in(rows, ["merchant"], [F.col("price"), F.col("id")], 3).select("merchant", "id", "price")


@query("""SELECT p_partkey AS id, size, round(p_retailprice + size, 2) AS price FROM (SELECT p_partkey, p_retailprice, unnest(range(1, 1 + p_size % 5)) AS size FROM part)""")
def explode_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each variant of a part; parts without variants have none."""
    sizes = F.expr("if(p_size % 5 = 0, cast(array() AS array<int>), sequence(1, p_size % 5))")
    rows = read(spark, sf_dir, "part", "p_partkey", "p_retailprice", "p_size").select(F.col("p_partkey").alias("id"), "p_retailprice", F.explode(sizes).alias("size"))
    return rows.select("id", F.col("size").cast("long").alias("size"), F.round(F.col("p_retailprice") + F.col("size"), 2).alias("price"))
