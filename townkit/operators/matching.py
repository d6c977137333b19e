"""Fuzzy and spatial matching of candidates with stored places, always inside blocks that candidates name by equal keys."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townkit.functions import geo, text
from townkit.functions.similarity import ratio
from townkit.operators.stages import written

METRES = 12_742_000.0


def block_matches(candidates: DataFrame, stored: DataFrame, block: str, least: float, similarity: Column) -> DataFrame:
    """candidate, match, score: the best stored row of the block for each candidate, ties by the least match; equal names score 1.

    candidates: candidate, name, block; stored: match, stored_name, block. similarity is over name and stored_name. Names that repeat in
    a block are compared once: its pairs are those of its different names, whatever the number of rows.
    """
    names, kept = candidates.select(block, "name").distinct(), stored.groupBy(block, "stored_name").agg(F.min("match").alias("match"))
    scored = names.join(kept, block).withColumn("score", F.when(F.col("name") == F.col("stored_name"), 1.0).otherwise(similarity)).where(F.col("score") >= least)
    best_first = F.struct(-F.col("score"), "match")
    best = scored.groupBy(block, "name").agg(F.min_by(F.struct("match", "score"), best_first).alias("b")).select(block, "name", "b.*")
    found = candidates.join(best, [block, "name"]).groupBy("candidate").agg(F.min_by(F.struct("match", "score"), best_first).alias("b"))
    return found.select("candidate", "b.match", "b.score")


def token_matches(candidates: DataFrame, stored: DataFrame, block: str, least: float = 0.5) -> DataFrame:
    """As block_matches, by shared words: columns only.

    Names of equal words are one, and those that the other side has are alike by 1. The others meet by prefixes: two sets of words that
    alike share one of the rarest words of each, so no pair of a block is made for its own sake, and none that counts is lost.
    """
    bag = lambda c: F.array_sort(F.array_distinct(F.split(F.col(c), " ")))
    asked = candidates.withColumn("bag", bag("name"))
    sets = written(asked.where(F.col("bag").isNotNull()).select(block, "bag").distinct(), "asked")
    kept = written(stored.select(block, bag("stored_name").alias("bag"), "match").where(F.col("bag").isNotNull()).groupBy(block, "bag").agg(F.min("match").alias("match")), "kept")
    equal = sets.join(kept, [block, "bag"]).select(block, "bag", "match", F.lit(1.0).alias("score"))
    rest = sets.join(kept.select(block, "bag"), [block, "bag"], "left_anti")
    counts = kept.select(block, F.explode("bag").alias("w")).groupBy(block, "w").agg(F.count(F.lit(1)).alias("df"))

    def prefixes(rows: DataFrame, *others: str) -> DataFrame:
        """The words that no more than the least share of the set come after; words of no stored name are rarest."""
        each = rows.select(block, "bag", *others, F.explode("bag").alias("w")).join(counts, [block, "w"], "left")
        ranked = each.groupBy(block, "bag", *others).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "w"))).alias("r"))  # of one name's words
        n = F.size("bag") - F.ceil(F.size("bag") * least - 1e-9) + 1
        return ranked.select(block, "bag", *others, F.explode(F.slice("r", F.lit(1), F.least(n, F.size("bag")).cast("int"))).alias("r")).withColumn("w", F.col("r.w")).drop("r")

    tasks = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # few bytes make many pairs: the number of tasks is given, or all of them land in one
    left = prefixes(rest).repartition(tasks, block, "w")
    pairs = left.join(prefixes(kept, "match").withColumnRenamed("bag", "other").repartition(tasks, block, "w"), [block, "w"])
    scored = pairs.withColumn("score", text.jaccard(F.col("bag"), F.col("other"))).where(F.col("score") >= least)
    best_first = F.struct(-F.col("score"), "match")
    like = scored.groupBy(block, "bag").agg(F.min_by(F.struct("match", "score"), best_first).alias("b")).select(block, "bag", "b.*")
    found = asked.join(equal.unionByName(like), [block, "bag"]).groupBy("candidate").agg(F.min_by(F.struct("match", "score"), best_first).alias("b"))
    return found.select("candidate", "b.match", "b.score")


def ratio_matches(candidates: DataFrame, stored: DataFrame, block: str, least: float = 0.86) -> DataFrame:
    """As block_matches, by the Ratcliff-Obershelp ratio, which only pairs of different names of a block are measured by."""
    return block_matches(candidates, stored, block, least, ratio("name", "stored_name"))


def fits(least: float) -> Column:
    """Whether names of these lengths can be that alike."""
    return 2 * F.least("size", "kept_size") >= least * (F.col("size") + F.col("kept_size")) - 1e-9


def sized(asked: DataFrame, stored: DataFrame, on: list[str], least: float) -> tuple[DataFrame, DataFrame]:
    """Both sides with lengths, the asked one with each length of its block that can be alike enough, so that they join by `on` and kept_size."""
    kept = stored.withColumn("kept_size", F.length("stored_name"))
    lengths = kept.select(*on, "kept_size").distinct()
    return asked.withColumn("size", F.length("name")).join(lengths, on).where(fits(least)), kept


def best_alike(asked: DataFrame, stored: DataFrame, on: list[str], by: list[str], least: float, where: Column | None = None) -> DataFrame:
    """by, name, match, r: the stored row most alike by the ratio, of those with equal `on` that satisfy `where`; ties by the least match.

    asked: by, name, on and what `where` needs; stored: match, stored_name, on and the like. No ratio is above what the lengths of two
    names allow, nor above what their edits leave. The most promising row is measured first, and then only rows that could be as much
    alike. Few bytes make many pairs, so the number of tasks is given.
    """
    a, b = sized(asked, stored, on, least)
    key, tasks = [*on, "kept_size"], int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    b = b.repartition(tasks, *key)
    both = F.col("size") + F.col("kept_size")
    # an edit leaves one character unmatched at least
    bound = F.when(both == 0, 1.0).otherwise(1 - F.levenshtein("name", "stored_name") / both)
    group = [*by, "name"]

    def pairs(rows: DataFrame) -> DataFrame:
        met = rows.repartition(tasks, *key).join(b, key)
        return (met if where is None else met.where(where)).withColumn("bound", bound).where(F.col("bound") >= least - 1e-9)

    first = pairs(a).groupBy(*group).agg(F.max_by("stored_name", F.struct("bound", (-F.col("match")).alias("m"))).alias("stored_name"))
    first = written(first.select(*group, ratio("name", "stored_name").alias("floor")), "first")
    rest = pairs(a.join(first, group)).where(F.col("bound") >= F.col("floor") - 1e-9)
    scored = rest.withColumn("r", ratio("name", "stored_name")).where(F.col("r") >= least)
    return scored.groupBy(*group).agg(F.min_by(F.struct("match", "r"), F.struct(-F.col("r"), "match")).alias("b")).select(*group, "b.*")


def distinct_stored(stored: DataFrame, *columns: str) -> DataFrame:
    return stored.groupBy(*columns, "stored_name").agg(F.min("match").alias("match"))


def reference_matches(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """candidate, match, method, confidence of the best stored place: exact name in the postcode, a like name there, or a like name within 80 m.

    candidates: candidate, name, postcode, lat, lng; stored: match, stored_name, postcode, lat, lng. The methods rank in this order, as
    their confidences do, so each is asked only for what the one before did not find: equal keys, then equal postcodes, then neighbouring
    grid cells. Rows that are equal in what is compared are compared once.
    """
    a = candidates.select("candidate", "name", F.col("postcode").alias("pc"), F.col("lat").alias("la"), F.col("lng").alias("lo"))
    b = stored.select("match", "stored_name", F.col("postcode").alias("pc"), "lat", "lng")
    best = lambda df, method, confidence: df.groupBy("candidate").agg(F.min_by(F.struct("match", confidence.alias("c")), F.struct(-confidence, "match")).alias("b")).select("candidate", "b.match", F.lit(method).alias("method"), F.col("b.c").alias("confidence"))
    exact = a.join(distinct_stored(b, "pc").withColumnRenamed("stored_name", "name"), ["pc", "name"])
    exact = written(best(exact, "exact", F.lit(1.0)), "exact")
    rest = written(a.where("name IS NOT NULL").join(exact, "candidate", "left_anti"), "rest")
    like = best_alike(rest.select("pc", "name").distinct(), distinct_stored(b, "pc"), ["pc"], ["pc"], 0.86)
    like = written(best(rest.join(like, ["pc", "name"]), "postcode_fuzzy_name", F.least(F.lit(0.99), 0.78 + 0.2 * F.col("r"))), "like")
    rest = rest.join(like, "candidate", "left_anti")
    # 80 m reach the fine cells around at most; of the grid's cells only neighbours count
    own, theirs = geo.cell(F.col("la"), F.col("lo")), geo.cell(F.col("lat"), F.col("lng"))
    close = (metres_apart() <= 80) & (F.abs(own["y"] - theirs["y"]) <= 1) & (F.abs(own["x"] - theirs["x"]) <= 1)
    points = rest.where("la IS NOT NULL AND lo IS NOT NULL").select("la", "lo", "name").distinct().withColumn("cell", F.explode(geo.fine_cells_around(F.col("la"), F.col("lo"))))
    near = best_alike(points, distinct_stored(b, "lat", "lng").withColumn("cell", geo.fine_cell(F.floor(F.col("lat") / geo.FINE), F.col("lng"))), ["cell"], ["la", "lo"], 0.75, close)
    near = best(rest.join(near, ["la", "lo", "name"]), "near_name", F.least(F.lit(0.97), 0.72 + 0.2 * F.col("r")))
    return exact.unionByName(like).unionByName(near)


def metres_apart() -> Column:
    return geo.haversine(F.col("la"), F.col("lo"), F.col("lat"), F.col("lng"), METRES)


def discovery_matches(spots: DataFrame, stored: DataFrame) -> DataFrame:
    """candidate, match, outcome of every spot: 'existing' by reference, or inside its box with a name 0.75 alike; 'possible' within 150 m and 0.55; 'new'."""
    sure = written(reference_matches(spots, stored).select("candidate", F.col("match").alias("sure")), "sure")
    sides = ["south", "north", "west", "east"]
    rest = spots.where("lat IS NOT NULL AND lng IS NOT NULL").select("candidate", "name", F.col("lat").alias("la"), F.col("lng").alias("lo"), *sides).join(sure, "candidate", "left_anti")
    points = written(rest.withColumn("cell", F.explode(geo.cells_around(F.col("la"), F.col("lo")))), "points")
    kept = distinct_stored(stored, "lat", "lng").withColumn("cell", geo.cell(F.col("lat"), F.col("lng")))
    inside = F.coalesce(F.col("lat").between(F.col("south"), F.col("north")) & F.col("lng").between(F.col("west"), F.col("east")), F.lit(False))
    one = lambda df, rank: df.groupBy("candidate").agg(F.min_by("match", F.struct(-F.col("r"), "match")).alias("match")).withColumn("rank", F.lit(rank))
    boxed = written(one(best_alike(points, kept, ["cell"], ["candidate"], 0.75, inside), 2), "boxed")
    maybe = one(best_alike(points.join(boxed, "candidate", "left_anti"), kept, ["cell"], ["candidate"], 0.55, inside | (metres_apart() <= 150)), 1)
    joined = spots.select("candidate").join(sure, "candidate", "left").join(boxed.unionByName(maybe), "candidate", "left")
    outcome = F.when(F.col("sure").isNotNull() | (F.col("rank") == 2), "existing").when(F.col("rank") == 1, "possible").otherwise("new")
    return joined.select("candidate", F.coalesce("sure", "match").alias("match"), outcome.alias("outcome"))


def identifier_matches(rows: DataFrame, places: DataFrame, near_m: float = 500.0) -> DataFrame:
    """candidate, outcome, match, rejected: places of the same linked identifier, each accepted or with the first reason against it.

    outcome: 'matched' for one accepted place, 'ambiguous' for more, 'review' if all were rejected, 'no_match' without any.
    rows: candidate, link, lat, lng, types; places: match, link, lat, lng, types, closed. Only rows of different types and points meet, and
    only open places of fitting types; no row leaves the join for each pair.
    """
    b = places.select("match", "link", F.col("lat").alias("la"), F.col("lng").alias("lo"), F.col("types").alias("t"), F.coalesce("closed", F.lit(False)).alias("closed"))
    own = F.struct("types", "lat", "lng").alias("own")
    asked = written(rows.where("link IS NOT NULL").select("link", own).distinct(), "asked")
    # what only the link tells, or only the link and the types, is not asked of pairs
    closed = b.groupBy("link").agg(F.max("closed").alias("closed"))
    open_ = written(b.where("NOT closed").groupBy("link", F.struct("t", "la", "lo").alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("match").alias("match")), "open")
    kinds = asked.select("link", F.col("own.types").alias("types")).distinct().join(open_.select("link", F.col("at.t").alias("t")).distinct(), "link")
    kinds = written(kinds.withColumn("fits", F.coalesce(F.arrays_overlap("types", "t"), F.lit(True))), "kinds")
    other = kinds.groupBy("link", F.struct("types").alias("own_types")).agg(F.max(~F.col("fits")).alias("other"))
    fitting = kinds.where("fits").groupBy("link", F.struct("types").alias("own_types")).agg(F.collect_list(F.struct("t")).alias("fitting"))  # different sets of types
    pairs = asked.withColumn("own_types", F.struct("own.types")).join(fitting, ["link", "own_types"]).withColumn("kind", F.explode("fitting")).drop("fitting", "own_types")
    pairs = pairs.join(open_.withColumn("kind", F.struct("at.t")), ["link", "kind"])
    far = F.coalesce(geo.haversine(F.col("own.lat"), F.col("own.lng"), F.col("at.la"), F.col("at.lo"), METRES) > near_m, F.lit(False))
    near = pairs.withColumn("far", far).groupBy("link", "own").agg(F.sum(F.when(~F.col("far"), F.col("n")).otherwise(0)).alias("ok"), F.min(F.when(~F.col("far"), F.col("match"))).alias("first"), F.max("far").alias("far"))
    met = rows.select("candidate", "link", own).join(near, ["link", "own"], "left").withColumn("own_types", F.struct("own.types")).join(other, ["link", "own_types"], "left").join(closed, "link", "left")
    met = met.where("ok IS NOT NULL OR other IS NOT NULL OR closed IS NOT NULL")
    flags = [F.max(F.coalesce(reason, F.lit(False))).alias(reason) for reason in ("closed", "far", "other")]
    judged = met.groupBy("candidate").agg(F.sum(F.coalesce("ok", F.lit(0))).alias("ok"), F.min("first").alias("first"), *flags)
    rejected = F.concat_ws(",", F.when(F.col("closed"), "closed"), F.when(F.col("far"), "far"), F.when(F.col("other"), "type"))
    judged = judged.select("candidate", "ok", "first", rejected.alias("rejected"))
    joined = rows.select("candidate").join(judged, "candidate", "left")
    outcome = F.when(F.col("ok").isNull(), "no_match").when(F.col("ok") == 1, "matched").when(F.col("ok") > 1, "ambiguous").otherwise("review")
    return joined.select("candidate", outcome.alias("outcome"), F.when(F.col("ok") == 1, F.col("first")).alias("match"), F.coalesce("rejected", F.lit("")).alias("rejected"))


def greedy_pairs(pairs: DataFrame, block: str) -> DataFrame:
    """block, left, right, score: one-to-one pairs, best score first (ties by left, then right), within each block."""
    schema = pairs.select(block, "left", "right", "score").schema

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        used_left, used_right, keep = set(), set(), []
        for row in pdf.sort_values(["score", "left", "right"], ascending=[False, True, True]).itertuples():
            if row.left not in used_left and row.right not in used_right:
                used_left.add(row.left)
                used_right.add(row.right)
                keep.append(row.Index)
        return pdf.loc[keep]

    return pairs.select(block, "left", "right", "score").groupBy(block).applyInPandas(choose, schema)


def greedy_named_pairs(left: DataFrame, right: DataFrame, block: str, similarity: Column) -> DataFrame:
    """As greedy_pairs over all pairs of a block with a similarity above 0, which is that of their names: different names are compared once, and no pair is a row.

    left: block, left, name; right: block, right, stored_name. Of one score, each left row in turn takes the least right row that is
    free and has a name of that score: what the order of score, left and right gives. A task holds the rows of a block, not their pairs.
    """
    scores = left.select(block, "name").distinct().join(right.select(block, "stored_name").distinct(), block).withColumn("score", similarity).where("score > 0")
    scores = written(scores, "scores")
    rows = left.select(block, F.lit(True).alias("is_left"), F.col("left").alias("id"), "name").unionByName(right.select(block, F.lit(False).alias("is_left"), F.col("right").alias("id"), F.col("stored_name").alias("name")))
    kind = dict(rows.dtypes)["id"]
    schema = f"{block} {dict(rows.dtypes)[block]}, left {kind}, right {kind}, score double"

    def choose(rows: pd.DataFrame, scores: pd.DataFrame) -> pd.DataFrame:
        lefts = {name: sorted(ids) for name, ids in rows[rows["is_left"]].groupby("name")["id"]}
        free = {name: deque(sorted(ids)) for name, ids in rows[~rows["is_left"]].groupby("name")["id"]}
        chosen = []
        for score, level in scores.sort_values("score", ascending=False).groupby("score", sort=False):
            alike = {name: [*others] for name, others in level.groupby("name")["stored_name"]}
            taken = set()
            for one, name in sorted((one, name) for name in alike for one in lefts.get(name, ())):
                names = alike[name] = [other for other in alike[name] if free.get(other)]
                if names:
                    least = min(names, key=lambda other: free[other][0])
                    chosen.append((one, free[least].popleft(), score))
                    taken.add(one)
            for name in alike:
                lefts[name] = [one for one in lefts.get(name, ()) if one not in taken]
        out = pd.DataFrame(chosen, columns=["left", "right", "score"])
        out.insert(0, block, rows[block].iloc[0] if len(rows) else None)
        return out

    return rows.groupBy(block).cogroup(scores.groupBy(block)).applyInPandas(choose, schema)


def resolve(items: DataFrame, venues: DataFrame, least: float = 0.55) -> DataFrame:
    """item, venue_id, outcome of each item's address: 'exact' name in the postcode, 'unsure' for a like one (no id), 'none' without an address, 'new'.

    items: item, name, postcode; venues: venue_id, venue_name, postcode.
    """
    a = items.select("item", text.norm_title(F.col("name")).alias("name"), "postcode")
    b = venues.select(F.col("venue_id").alias("match"), text.norm_title(F.col("venue_name")).alias("stored_name"), "postcode").where("postcode <> ''")
    kept = written(distinct_stored(b, "postcode"), "kept")
    exact = kept.select("postcode", F.col("stored_name").alias("name"), F.col("match").alias("venue_id"))
    met = written(a.join(exact, ["postcode", "name"], "left"), "met")
    # one name of each length first: only names that are unlike all of these meet the others
    asked = met.where("venue_id IS NULL").select("postcode", "name").distinct()
    one, few = sized(asked, kept.groupBy("postcode", F.length("stored_name").alias("l")).agg(F.min("stored_name").alias("stored_name")).drop("l"), ["postcode"], least)
    like = written(one.join(few, ["postcode", "kept_size"]).where(ratio("name", "stored_name") >= least).select("postcode", "name").distinct(), "like")
    others = best_alike(asked.join(like, ["postcode", "name"], "left_anti"), kept, ["postcode"], ["postcode"], least).select("postcode", "name")
    found = met.join(like.unionByName(others).withColumn("like", F.lit(True)), ["postcode", "name"], "left")
    best = found.groupBy("item").agg(F.min("venue_id").alias("venue_id"), F.max("like").alias("like"), F.first("postcode").alias("postcode"))
    outcome = F.when(F.coalesce("postcode", F.lit("")) == "", "none").when(F.col("venue_id").isNotNull(), "exact").when(F.col("like"), "unsure").otherwise("new")
    return best.select("item", F.when(outcome == "exact", F.col("venue_id")).alias("venue_id"), outcome.alias("outcome"))
