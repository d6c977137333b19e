"""Queries over events: vitals, feeds, slots, streaks, budgets, differences, and the extensions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from townkit.operators import eligibility, feeds, identity, merge, numbering, schedule
from townkit.operators.stages import shared_dir
from townkit.plans.registry import query
from townkit.sources import feed_walk
from townkit.sources.tables import SIGNALS, read, signals


@query("SELECT kind, round(quantile_cont(value, 0.75), 6) AS p75, round(avg(CASE WHEN value <= 20 THEN 1.0 ELSE 0.0 END) * 100, 4) AS good, count(*)::BIGINT AS n FROM signals GROUP BY kind HAVING count(*) >= 20", SIGNALS)
def vitals_p75(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals(spark, sf_dir)
    quartile = feeds.percentile_cont(rows, "kind", "value", 0.75).select("kind", F.round("at", 6).alias("p75"))
    found = rows.groupBy("kind").agg(F.round(F.avg((F.col("value") <= 20).cast("double")) * 100, 4).alias("good"), F.count(F.lit(1)).alias("n"))
    return quartile.join(found.where("n >= 20"), "kind")


@query("SELECT kind, CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 11 ELSE floor(value / 10)::BIGINT + 1 END AS bucket, count(*)::BIGINT AS n FROM signals GROUP BY 1, 2", SIGNALS)
def vitals_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).groupBy("kind", F.width_bucket("value", F.lit(0.0), F.lit(100.0), F.lit(10)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT kind, count(*)::BIGINT AS n, list_sort(list(value))[ceil(count(*) * 0.95)::BIGINT] AS at, max(value) AS most FROM signals GROUP BY kind", SIGNALS)
def p95_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.nearest_rank(signals(spark, sf_dir), "kind", "value")


@query("SELECT series, list_sort(list(value))[count(*) // 2 + 1] AS median, count(*)::BIGINT AS n FROM signals GROUP BY series", SIGNALS)
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.upper_median(signals(spark, sf_dir), "series", "value")


@query("SELECT k AS item, seq, kind, value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS n FROM (SELECT seq, kind, value, series * 100 + k AS k FROM signals)) WHERE n = 1 AND kind <> 'error'", SIGNALS)
def cdc_current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live items of a change feed, where an error deletes."""
    changes = signals(spark, sf_dir).select((F.col("series") * 100 + F.col("k")).alias("item"), "seq", "kind", "value")
    return feeds.current_items(changes, "item", "seq", F.col("kind") == "error")


@query("""WITH_LIVE SELECT series, items, last_seq, last_item FROM (SELECT series, count(*)::BIGINT AS items FROM live GROUP BY series)
  JOIN (SELECT series, max(seq) AS last_seq, arg_max(item, seq) AS last_item FROM changes WHERE kind <> 'error' GROUP BY series) USING (series)""".replace("WITH_LIVE", """,
  changes AS (SELECT k AS item, series, seq, kind FROM signals), live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY seq DESC) AS n FROM changes) WHERE n = 1 AND kind <> 'error')"""), SIGNALS)
def series_refcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series with the number of live items that map to them, and their last update."""
    changes = signals(spark, sf_dir).select(F.col("k").alias("item"), "series", "seq", "kind")
    return feeds.series_state(changes, "item", "series", "seq", F.col("kind") == "error")


@query("""SELECT series, coalesce(sum(f) FILTER (WHERE run = top), 0)::BIGINT AS streak, sum(f)::BIGINT AS total, max(n) >= 3 AS deactivated FROM (SELECT *, max(run) OVER (PARTITION BY series) AS top, sum(f) OVER (PARTITION BY series, run) AS n FROM
  (SELECT series, CASE WHEN kind = 'error' THEN 1 ELSE 0 END AS f, sum(CASE WHEN kind <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY seq) AS run FROM signals)) GROUP BY series""", SIGNALS)
def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failures of each series since its last success, and whether it ever failed three times in a row."""
    rows = signals(spark, sf_dir).select("series", "seq", (F.col("kind") == "error").alias("failed"))
    return schedule.streaks(rows, "series", "seq", "failed")


@query("SELECT series, seq, round(coalesce(before, 0), 4) AS spent, coalesce(before, 0) + value <= 500 AS taken FROM (SELECT *, sum(value) OVER (PARTITION BY series ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM signals)", SIGNALS)
def budget_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = schedule.within_budget(signals(spark, sf_dir).select("series", "seq", "value"), "series", [F.col("seq")], "value", 500.0)
    return found.select("series", "seq", F.round("spent", 4).alias("spent"), "taken")


@query("""SELECT seq, CASE WHEN n = 1 AND kind <> 'view' THEN 'claimed' ELSE 'already' END AS state FROM (SELECT seq, kind, row_number() OVER (PARTITION BY kind, date_trunc('hour', ts) ORDER BY seq) AS n FROM signals WHERE kind <> 'error')""", SIGNALS)
def slot_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first request of each hour claims its slot; all slots of one workflow are taken already."""
    wanted = signals(spark, sf_dir).where("kind <> 'error'").select("seq", "kind", F.date_trunc("hour", "ts").alias("slot"))
    claimed = wanted.where("kind = 'view'").select("kind", "slot").distinct()
    return merge.claim_slots(claimed, wanted, ["kind", "slot"], "seq").select("seq", "state")


@query(""", hours AS (SELECT unnest([7, 19]) AS h), days AS (SELECT unnest(range(30)) AS d),
  slots AS (SELECT workflow, TIMESTAMP '2024-01-01' + to_days(d::INT) + to_hours(h::INT) AS slot FROM (SELECT DISTINCT series AS workflow FROM signals), days, hours),
  windows AS (SELECT *, lead(slot, 1, TIMESTAMP '2024-01-31 12:00:00') OVER (PARTITION BY workflow ORDER BY slot) AS next FROM slots),
  runs AS (SELECT workflow, slot, seq, ts, kind, row_number() OVER (PARTITION BY workflow, slot ORDER BY ts, seq) AS n FROM windows LEFT JOIN signals ON series = workflow AND ts >= slot AND ts < next),
  first AS (SELECT *, round_even(trunc(epoch(ts - slot)) / 60.0, 0)::BIGINT AS delay FROM runs WHERE n = 1)
  SELECT workflow, strftime(slot, '%Y-%m-%d %H:%M') AS slot, seq AS run_id, delay, CASE WHEN seq IS NULL THEN 'MISSING' WHEN kind = 'error' THEN 'FAILED' WHEN delay > 60 THEN 'LATE' ELSE 'OK' END AS state FROM first""", SIGNALS)
def slot_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two slots a day of each workflow, with the first run of each."""
    rows = signals(spark, sf_dir)
    runs = rows.select(F.col("series").alias("workflow"), F.col("seq").alias("run_id"), F.col("ts").alias("created"), (F.col("kind") != "error").alias("ok"))
    times = F.expr("transform(sequence(0, 59), i -> make_timestamp_ntz(2024, 1, 1 + cast(i / 2 AS int), if(i % 2 = 0, 7, 19), 0, 0))")
    slots = runs.select("workflow").distinct().select("workflow", F.explode(times).alias("slot"))
    ledger = schedule.slot_ledger(slots, runs, F.lit("2024-01-31 12:00:00").cast("timestamp_ntz"))
    return ledger.select("workflow", F.date_format("slot", "yyyy-MM-dd HH:mm").alias("slot"), "run_id", "delay", "state")


@query("SELECT conv_id, max(turn)::BIGINT AS last_turn, arg_max(role, turn) AS role, count(*) FILTER (WHERE role = 'user')::BIGINT AS asked FROM conversations GROUP BY conv_id")
def latest_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each record after its last comment."""
    return read(spark, sf_dir, "conversations", "conv_id", "turn", "role").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("role"), F.count(F.when(F.col("role") == "user", 1)).alias("asked"))


@query("""SELECT coalesce(a.series, b.series) AS series, CASE WHEN a.series IS NULL THEN 'added' WHEN b.series IS NULL THEN 'missing' ELSE 'changed' END AS change,
  CASE WHEN a.series IS NULL OR b.series IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN a.n IS DISTINCT FROM b.n THEN 'n' END, CASE WHEN a.kinds IS DISTINCT FROM b.kinds THEN 'kinds' END], lambda x: x IS NOT NULL), ',') END AS fields
  FROM (SELECT series, count(*) AS n, count(DISTINCT kind) AS kinds FROM signals WHERE seq % 2 = 0 AND series % 9 <> 0 GROUP BY 1) a FULL JOIN (SELECT series, count(*) AS n, count(DISTINCT kind) AS kinds FROM signals WHERE seq % 2 = 1 AND series % 8 <> 0 GROUP BY 1) b USING (series)
  WHERE a.series IS NULL OR b.series IS NULL OR a.n IS DISTINCT FROM b.n OR a.kinds IS DISTINCT FROM b.kinds""", SIGNALS)
def diff_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series that are added, missing or changed between two snapshots, and the fields that changed."""
    rows = signals(spark, sf_dir)
    state = lambda df: df.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("kind").alias("kinds"))
    before, after = state(rows.where("seq % 2 = 0 AND series % 9 <> 0")), state(rows.where("seq % 2 = 1 AND series % 8 <> 0"))
    found = merge.difference(before, after, ["series"], ["n", "kinds"])
    return found.select("series", "change", F.array_join("fields", ",").alias("fields"))


@query("SELECT series, round(last(value ORDER BY seq) - first(value ORDER BY seq), 6) AS delta, round(sum(abs(step)), 4) AS moved FROM (SELECT *, value - lag(value) OVER (PARTITION BY series ORDER BY seq) AS step FROM signals) GROUP BY series", SIGNALS)
def usage_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First against last value of each series, and the sum of its steps."""
    rows = signals(spark, sf_dir).withColumn("step", F.col("value") - F.lag("value").over(Window.partitionBy("series").orderBy("seq")))
    return rows.groupBy("series").agg(F.round(F.max_by("value", "seq") - F.min_by("value", "seq"), 6).alias("delta"), F.round(F.sum(F.abs("step")), 4).alias("moved"))


@query("SELECT kind AS source, extracted, kept, duplicates, extracted - kept - duplicates AS rejected, true AS complete FROM (SELECT kind, count(*)::BIGINT AS extracted, count(*) FILTER (WHERE n = 1 AND value > 5)::BIGINT AS kept, count(*) FILTER (WHERE n > 1 AND value > 5)::BIGINT AS duplicates FROM (SELECT *, row_number() OVER (PARTITION BY kind, series, k, value > 5 ORDER BY seq) AS n FROM signals) GROUP BY kind)", SIGNALS)
def run_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source gave: kept, duplicates, and the rest as rejected."""
    rows = signals(spark, sf_dir).withColumn("good", F.col("value") > 5)
    marked = identity.mark_duplicates(rows, ["kind", "series", "k", "good"], [F.col("seq")])
    sums = marked.groupBy(F.col("kind").alias("source")).agg(F.count(F.lit(1)).alias("extracted"), F.count(F.when(F.col("good") & F.col("reason").isNull(), 1)).alias("kept"), F.count(F.when(F.col("good") & F.col("reason").isNotNull(), 1)).alias("duplicates"))
    return feeds.account(sums)


@query("SELECT kind, CASE WHEN count(*) = 3 THEN list_sort(list(value))[2] END AS median FROM (SELECT kind, value, row_number() OVER (PARTITION BY kind ORDER BY seq) AS n FROM signals) WHERE n <= CASE WHEN kind = 'view' THEN 2 ELSE 3 END GROUP BY kind", SIGNALS)
def three_run_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of exactly three runs, null for fewer."""
    n = F.row_number().over(Window.partitionBy("kind").orderBy("seq"))
    first = signals(spark, sf_dir).withColumn("n", n).where(F.col("n") <= F.when(F.col("kind") == "view", 2).otherwise(3))
    return first.groupBy("kind").agg(F.when(F.count(F.lit(1)) == 3, F.sort_array(F.collect_list("value"))[1]).alias("median"))  # three values


@query("SELECT seq, CASE WHEN k IS NULL THEN 'no_props' WHEN value > 100 THEN 'range' WHEN kind NOT IN ('view', 'click', 'purchase') THEN 'kind' END AS reason FROM signals", SIGNALS)
def vitals_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = (("no_props", F.col("k").isNull()), ("range", F.col("value") > 100), ("kind", ~F.col("kind").isin("view", "click", "purchase")))
    return signals(spark, sf_dir).select("seq", eligibility.first_reason(*rules).alias("reason"))


@query("SELECT conv_id, count(*) = max(turn) + 1 - min(turn) AND min(turn) IN (0, 1) AS covered FROM (SELECT DISTINCT conv_id, turn FROM conversations) GROUP BY conv_id")
def span_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the turns of a conversation follow one another without gaps."""
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn").distinct()
    return turns.groupBy("conv_id").agg(((F.count(F.lit(1)) == F.max("turn") + 1 - F.min("turn")) & F.min("turn").isin(0, 1)).alias("covered"))


@query("SELECT kind, series % 3 AS part, count(*)::BIGINT AS n, grouping(kind) + 0 AS g FROM signals GROUP BY ROLLUP (kind, series % 3)", SIGNALS)
def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: subtotals."""
    rows = signals(spark, sf_dir).withColumn("part", F.col("series") % 3)
    return rows.rollup("kind", "part").agg(F.count(F.lit(1)).alias("n"), F.grouping("kind").cast("long").alias("g"))


@query("SELECT kind, series % 3 AS part, count(*)::BIGINT AS n, round(sum(value), 4) AS value FROM signals GROUP BY CUBE (kind, series % 3)", SIGNALS)
def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: all subtotals."""
    return signals(spark, sf_dir).withColumn("part", F.col("series") % 3).cube("kind", "part").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query("""SELECT series, count(*)::BIGINT AS sessions, max(n)::BIGINT AS longest FROM (SELECT series, session, count(*) AS n FROM (SELECT series, sum(CASE WHEN ts >= prev + INTERVAL 30 MINUTE OR prev IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY ts, seq) AS session
  FROM (SELECT *, lag(ts) OVER (PARTITION BY series ORDER BY ts, seq) AS prev FROM signals)) GROUP BY 1, 2) GROUP BY series""", SIGNALS)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: sessions with gaps of 30 minutes."""
    sessions = signals(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).groupBy("series", F.session_window("ts", "30 minutes")).agg(F.count(F.lit(1)).alias("n"))
    return sessions.groupBy("series").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H') AS hour, kind, count(*)::BIGINT AS n FROM signals GROUP BY 1, 2", SIGNALS)
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: counts by the hour."""
    hours = signals(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour").alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"))
    return hours.select(F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "kind", "n")


@query("(SELECT DISTINCT series FROM signals WHERE kind = 'purchase' INTERSECT SELECT series FROM signals WHERE value > 150) EXCEPT SELECT series FROM signals WHERE kind = 'error' AND value > 100", SIGNALS)
def intersect_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: set operations."""
    rows = signals(spark, sf_dir)
    part = lambda c: rows.where(c).select("series")
    return part("kind = 'purchase'").intersect(part("value > 150")).subtract(part("kind = 'error' AND value > 100"))


@query("SELECT feed, k AS item, value FROM (SELECT *, row_number() OVER (PARTITION BY feed, k ORDER BY seq DESC) AS n FROM (SELECT 'f' || series % 4 AS feed, seq, kind, value, series * 100 + k AS k FROM signals)) WHERE n = 1 AND kind <> 'error' AND feed <> 'f3'", SIGNALS)
def feed_walk_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live items of all events as paged feeds, streamed page by page; a feed whose pages break off gives none."""
    folder = f"{shared_dir(spark)}/feeds-{uuid.uuid4().hex}"
    rows = signals(spark, sf_dir).select(F.concat(F.lit("f"), F.col("series") % 4).alias("feed"), "seq", (F.col("series") * 100 + F.col("k")).cast("string").alias("item"), "kind", "value")
    # places in each feed: numbers over all rows, less the number of the feed's first
    placed = numbering.numbered(rows, [F.col("feed"), F.col("seq")])
    first = placed.groupBy("feed").agg(F.min("row_number").alias("first"))
    state = F.when(F.col("kind") == "error", "deleted").otherwise("updated")
    data = F.when(F.col("kind") != "error", F.to_json(F.struct(F.struct("value").alias("offer"), "kind")))
    changes = placed.join(F.broadcast(first), "feed").select("feed", (F.col("row_number") - F.col("first")).alias("n"), "item", state.alias("state"), F.col("seq").cast("string").alias("modified"), data.alias("data"))
    written_pages = feed_walk.write_pages(changes, f"{folder}/pages", 2_000).collect()  # a row a feed
    feeds = {r["feed"]: f"{folder}/pages/{r['feed']}/{0 if r['feed'] != 'f3' else 'gone'}.json" for r in written_pages}
    if not feeds:
        return rows.select("feed", F.col("item").cast("long").alias("item"), "value").limit(0)
    feed_walk.follow(spark, feeds, folder, "offer.value", pages=50, most=max(r["pages"] for r in written_pages))
    items = feed_walk.live_items(spark.read.schema(feed_walk.ITEMS).parquet(f"{folder}/items"))
    found = feed_walk.of_complete_feeds(items, feed_walk.feed_report(spark, f"{folder}/cursors"))
    return found.select("feed", F.col("item").cast("long").alias("item"), F.get_json_object("data", "$['offer.value']").cast("double").alias("value"))
