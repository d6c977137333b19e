"""Order-dependent selection as windows: dense order, round robins, votes, allocation, strides."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townkit.operators.numbering import numbered_in_groups
from townkit.operators.stages import written


def dense_order(rows: DataFrame, group: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """1..n in a total order within each group."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def first_in(rows: DataFrame, group: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group. Spark keeps n rows of a group a task before it shuffles them."""
    return dense_order(rows, group, order, "_n").where(F.col("_n") <= n).drop("_n")


def round_robin(rows: DataFrame, bucket: str, order: list[Column]) -> DataFrame:
    """round and bucket_place: rows taken from the buckets in turn, the buckets in the order of their first row.

    The final order is (round, bucket_place). Buckets are ranked by their first rows, of which there are few.
    """
    taken = dense_order(rows, [bucket], order, "round")
    first = taken.where(F.col("round") == 1)
    places = first.withColumn("bucket_place", F.row_number().over(Window.orderBy(*order))).select(F.col(bucket), "bucket_place")
    return taken.join(places, bucket)


def two_level_round_robin(rows: DataFrame, source: str, item: str, order: list[Column], budget: int) -> DataFrame:
    """turn, source_place and within: rows in fair turns between sources, and within a source between items; in_budget for the first `budget`.

    Within a source an item's next row follows only when all of its items had one: place by (row of the item, first place of the item).
    """
    by_item = dense_order(rows, [source, item], order, "variant")
    by_source = by_item.withColumn("_seen", F.row_number().over(Window.partitionBy(source).orderBy(*order)))
    by_source = by_source.withColumn("_first", F.min("_seen").over(Window.partitionBy(source, item)))
    turns = by_source.withColumn("turn", F.row_number().over(Window.partitionBy(source).orderBy("variant", "_first")))
    first = first_in(rows, [source], order).withColumn("source_place", F.row_number().over(Window.orderBy(*order))).select(source, "source_place")
    placed = turns.join(first, source)
    # a row is in the budget if the rows of earlier turns and earlier sources leave room: counts by turn, not a sort of all rows
    sizes = placed.groupBy("turn").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.join(F.broadcast(before.where(F.col("_before") < budget).select("turn", "_before")), "turn", "left")
    rank = F.row_number().over(Window.partitionBy("turn").orderBy("source_place"))
    return placed.withColumn("in_budget", F.coalesce(F.col("_before") + rank <= budget, F.lit(False))).drop("_seen", "_first", "_before")


def greedy_diverse(rows: DataFrame, count: int, candidates: int = 1_000) -> DataFrame:
    """place, id, adjusted: the best `count` rows where each taken row costs later ones of its merchant 12 and of its group 6 points.

    rows: id, score, merchant, grp, link. A row whose link is taken already is used up without a place. Within a merchant and group the
    order is that of the scores, so of these the best row of each link and the best `count` rows are enough. The best `candidates` of
    them are tried in one task; their choice stands if its last row beats every score left out. Else each place is a maximum over all.
    """
    own = rows.select("id", F.col("score").cast("double").alias("score"), F.lower(F.coalesce(F.col("merchant").cast("string"), F.lit(""))).alias("merchant"), F.coalesce(F.col("grp").cast("string"), F.lit("")).alias("grp"), "link")
    links = own.groupBy("merchant", "grp", "link").agg(F.min(F.struct((-F.col("score")).alias("minus"), "id")).alias("best"))
    links = links.select("best.id", (-F.col("best.minus")).alias("score"), "merchant", "grp", "link")
    kept = written(first_in(links, ["merchant", "grp"], [F.desc("score"), F.col("id")], count), "diverse")
    best = kept.orderBy(F.desc("score"), "id").limit(candidates + 1).withColumn("_n", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).withColumn("_all", F.lit(1))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n")
        left, rest = pdf[:candidates].to_dict("records"), pdf["score"][candidates:].tolist()
        merchants, groups, links, out = {}, {}, set(), []
        while left and len(out) < count:
            value = lambda r: r["score"] - 12 * merchants.get(r["merchant"], 0) - 6 * groups.get(r["grp"], 0)
            best_row = min(left, key=lambda r: (-value(r), r["id"]))
            left.remove(best_row)
            if best_row["link"] in links:
                continue
            out.append((len(out) + 1, best_row["id"], float(value(best_row))))
            links.add(best_row["link"])
            merchants[best_row["merchant"]] = merchants.get(best_row["merchant"], 0) + 1
            groups[best_row["grp"]] = groups.get(best_row["grp"], 0) + 1
        if rest and (len(out) < count or out[-1][2] <= rest[0]):
            out = []  # a row that was left out may come before
        return pd.DataFrame(out, columns=["place", "id", "adjusted"])

    chosen = written(best.groupBy("_all").applyInPandas(choose, f"place int, id {dict(rows.dtypes)['id']}, adjusted double"), "chosen")
    return greedy_rounds(kept, count) if chosen.isEmpty() else chosen


def greedy_rounds(kept: DataFrame, count: int) -> DataFrame:
    """The same choice, place by place: each is the best row of all, of which only that row comes to the driver."""
    merchants, groups, links, out = {}, {}, [], []

    def costs(column: str, taken: dict, points: int) -> Column:
        pairs = [F.lit(x) for pair in taken.items() for x in pair]
        return points * F.coalesce(F.create_map(*pairs)[F.col(column)], F.lit(0)) if pairs else F.lit(0)

    while len(out) < count:
        value = F.col("score") - costs("merchant", merchants, 12) - costs("grp", groups, 6)
        free = F.lit(True)
        if any(x is None for x in links):
            free = F.col("link").isNotNull()
        if some := [x for x in links if x is not None]:
            free = free & (F.col("link").isNull() | ~F.col("link").isin(some))
        top = kept.where(free).withColumn("adjusted", value).orderBy(F.desc("adjusted"), "id").limit(1).collect()
        if not top:
            break
        out.append((len(out) + 1, top[0]["id"], top[0]["adjusted"]))
        links.append(top[0]["link"])
        merchants[top[0]["merchant"]] = merchants.get(top[0]["merchant"], 0) + 1
        groups[top[0]["grp"]] = groups.get(top[0]["grp"], 0) + 1
    return kept.sparkSession.createDataFrame(out, f"place int, id {dict(kept.dtypes)['id']}, adjusted double")


def allocation(rows: DataFrame, stratum: str, total: int, least: int) -> DataFrame:
    """stratum, size, quota: how many of `total` samples each stratum gives, in columns over the strata's sizes.

    All rows if there are no more than `total`. Else a stratum's part is its share, rounded down, but `least` (or its size) at least.
    What is then missing goes to the greatest remainders, one each; what is too much is taken from the highest parts, one by one, down
    to no less than the least. Ties: the stratum that sorts first. Windows see one row a stratum, and one row for each unit too many.
    """
    sizes = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("size"))
    whole = Window.partitionBy()  # a row a stratum
    sizes = sizes.withColumn("_n", F.sum("size").over(whole)).withColumn("_least", F.least(F.lit(least), "size"))
    part = F.when(F.col("_n") <= total, F.col("size")).otherwise(F.greatest("_least", F.floor(F.lit(total) * F.col("size") / F.col("_n"))))
    parts = sizes.withColumn("_part", part).withColumn("_over", F.sum("_part").over(whole) - F.least(F.lit(total), "_n"))
    remainder = F.lit(total) * F.col("size") - F.col("_part") * F.col("_n")
    by_remainder = F.row_number().over(whole.orderBy(F.desc(F.when(F.col("_part") < F.col("size"), remainder)), stratum))
    parts = written(parts.withColumn("_given", F.when(by_remainder <= -F.col("_over"), 1).otherwise(0)), "parts")
    units = parts.where("_over > 0 AND _part > _least").select(stratum, "_over", F.explode(F.expr("sequence(_least + 1, _part)")).alias("_unit"))
    taken = units.withColumn("_place", F.row_number().over(whole.orderBy(F.desc("_unit"), stratum))).where("_place <= _over").groupBy(stratum).agg(F.count(F.lit(1)).alias("_taken"))
    return parts.join(taken, stratum, "left").select(stratum, "size", (F.col("_part") + F.col("_given") - F.coalesce("_taken", F.lit(0))).alias("quota"))


def stratified(rows: DataFrame, stratum: str, key: str, total: int, least: int = 1, seed: int = 7) -> DataFrame:
    """`total` rows of all strata: each gets its allocation, and gives the rows of the least hash of seed and key.

    No stratum gives more than `total` rows, so only so many of each leave a task.
    """
    quota = allocation(rows, stratum, total, least).select(stratum, "quota")
    drawn = dense_order(rows, [stratum], [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)], "draw").where(F.col("draw") <= total)
    return drawn.join(quota, stratum).where(F.col("draw") <= F.col("quota")).drop("quota")


def every(rows: DataFrame, group: list[str], order: list[Column], most: int) -> DataFrame:
    """At most `most` rows of each group at an even stride; groups are numbered by task offsets, none is one task's."""
    step = F.greatest(F.lit(1), F.floor(F.col("group_size") / most))
    placed = numbered_in_groups(rows, group, order)
    return placed.where((F.col("place") % step == 0) & (F.col("place") / step < most)).select(*rows.columns)


def neighbour_votes(candidates: DataFrame, km: float = 40.0, strict: bool = True) -> DataFrame:
    """entry, option of the best candidate point of each entry: the one that most other entries of the source have a candidate nearer than km.

    candidates: source, entry, option, lat, lng. Different points meet through cells, so only neighbours are compared: bands of latitude, each cut
    into cells as wide as km is long at the poleward edge of the band beyond. Entries at one point are counted there first. strict drops entries of several options whose best is tied
    or has no votes; else the first option wins.
    """
    from townkit.functions import geo

    size = km / 111.0

    def width(band: Column) -> Column:
        edge = F.least(F.lit(89.9), (F.greatest(F.abs(band), F.abs(band + 1)) + 1) * size)
        return F.least(F.lit(360.0), size / F.cos(F.radians(edge)))

    def met(asked: DataFrame, others: DataFrame) -> DataFrame:
        """asked (source, la, lo and more) with others (source, lat, lng and more) that are nearer than km."""
        home = others.withColumn("_y", F.floor(F.col("lat") / size)).withColumn("_x", F.floor(F.col("lng") / width(F.col("_y"))))
        around = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))
        own = asked.withColumn("_y", F.floor(F.col("la") / size)).withColumn("_d", F.explode(around)).withColumn("_y", F.col("_y") + F.col("_d.dy"))
        own = own.withColumn("_x", F.floor(F.col("lo") / width(F.col("_y"))) + F.col("_d.dx")).drop("_d")
        return own.join(home, ["source", "_y", "_x"]).where(geo.haversine(F.col("la"), F.col("lo"), F.col("lat"), F.col("lng")) < km)

    # an entry that is at one point of its source is a number there; only entries at several points are told apart
    rows = candidates.where("entry IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL").select("source", "entry", "option", "lat", "lng").distinct()
    entries = rows.groupBy("source", "entry").agg(F.min(F.struct("lat", "lng")).alias("p"), (F.min(F.struct("lat", "lng")) < F.max(F.struct("lat", "lng"))).alias("several"))
    single = written(entries.where("NOT several").groupBy("source", "p").agg(F.count(F.lit(1)).alias("n")).select("source", "p.*", "n"), "points")
    several = written(rows.join(entries.where("several").select("source", "entry"), ["source", "entry"], "left_semi").select("source", "entry", "lat", "lng").distinct(), "several")
    points = written(rows.select("source", F.col("lat").alias("la"), F.col("lng").alias("lo")).distinct(), "asked")
    at = ["source", "la", "lo"]
    counts = met(points, single).groupBy(*at).agg(F.sum("n").alias("n")).unionByName(met(points, several).select(*at, "entry").distinct().groupBy(*at).agg(F.count(F.lit(1)).alias("n")))
    by_point = counts.groupBy(*at).agg(F.sum("n").alias("n")).withColumnsRenamed({"la": "lat", "lo": "lng"})
    # every entry is near its own points
    keys = rows.groupBy("source", "entry", "option").agg(F.min(F.struct("lat", "lng")).alias("p"), (F.min(F.struct("lat", "lng")) < F.max(F.struct("lat", "lng"))).alias("spread"))
    votes = keys.where("NOT spread").select("source", "entry", "option", "p.*").join(by_point, ["source", "lat", "lng"]).select("source", F.col("entry").alias("e"), F.col("option").alias("o"), (F.col("n") - 1).alias("votes"))
    # an option of several points has the entries near any of them
    spread = rows.join(keys.where("spread").select("source", "entry", "option"), ["source", "entry", "option"], "left_semi").select("source", F.col("entry").alias("e"), F.col("option").alias("o"), F.col("lat").alias("la"), F.col("lng").alias("lo"))
    votes = votes.unionByName(met(spread, rows.select("source", "entry", "lat", "lng").distinct()).where("e <> entry").groupBy("source", "e", "o").agg(F.count_distinct("entry").alias("votes")))
    scored = candidates.join(votes.select("source", F.col("e").alias("entry"), F.col("o").alias("option"), "votes"), ["source", "entry", "option"], "left").withColumn("votes", F.coalesce("votes", F.lit(0)))
    group = Window.partitionBy("source", "entry")
    best = scored.withColumns({"options": F.count(F.lit(1)).over(group), "n": F.row_number().over(group.orderBy(F.desc("votes"), "option")), "top": F.max("votes").over(group)})
    best = best.withColumn("tied", F.sum((F.col("votes") == F.col("top")).cast("int")).over(group)).where("n = 1")
    kept = (F.col("options") == 1) | ((F.col("votes") > 0) & (F.col("tied") == 1)) if strict else F.lit(True)
    return best.where(kept).select("source", "entry", "option", "votes")
