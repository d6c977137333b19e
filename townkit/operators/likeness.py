"""Names that mean the same: one within the other, or alike by the Ratcliff-Obershelp ratio, joined without blocks and without a product."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townkit.functions import text
from townkit.functions.places import stated_postcode
from townkit.functions.similarity import ratio
from townkit.operators.joins import look_up
from townkit.operators.stages import written

#: The least length of a name that may be found within another, and characters of the pieces by which it is looked up.
SHORTEST, PIECE = 6, 4


def pieces(name: Column, n: int) -> Column:
    """All runs of n characters."""
    return F.when(F.length(name) >= n, F.transform(F.sequence(F.lit(1), F.length(name) - (n - 1)), lambda i: F.substring(name, i, n))).otherwise(F.array().cast("array<string>"))


def within(short: DataFrame, long: DataFrame) -> DataFrame:
    """inner, outer: all pairs of different names of which one stands within the other; both have a row for each name (column name).

    A name is looked up by the rarest of its pieces among the outer names, and not at all if one of them occurs in none; what shares that
    piece is then searched. So the work grows with the characters of all names and with the pairs that share a rare piece. A piece stands
    beside its name's number, not its text, and names longer than all outer ones are in none.
    """
    number = F.monotonically_increasing_id()  # written, so that it stays
    outer = written(long.select(F.col("name").alias("outer"), number.alias("o")), "outer")
    longest = outer.agg(F.max(F.length("outer")).alias("n")).collect()[0]["n"] or 0
    inner = written(short.where(F.length("name").between(SHORTEST, longest)).select(F.col("name").alias("inner"), number.alias("i")), "inner")
    own = written(inner.select("i", F.explode(F.array_distinct(pieces(F.col("inner"), PIECE))).alias("piece")), "pieces")
    asked = written(own.select("piece").distinct(), "asked")
    posted = written(look_up(written(outer.select("o", F.explode(F.array_distinct(pieces(F.col("outer"), PIECE))).alias("piece")), "posted"), asked, ["piece"]), "pieces")
    counts = written(posted.groupBy("piece").agg(F.count(F.lit(1)).alias("n")), "counts")
    rare = look_up(own, counts, ["piece"], "left").groupBy("i").agg(F.max(F.col("n").isNull()).alias("absent"), F.min_by("piece", F.struct("n", "piece")).alias("piece"))
    met = rare.where("NOT absent").join(posted, "piece").select("i", "o")
    pairs = met.join(inner, "i").join(outer, "o").where(F.col("outer").contains(F.col("inner")) & (F.col("outer") != F.col("inner")))
    return pairs.select("inner", "outer")


def most_edits(length: Column, threshold: float) -> Column:
    """Characters that may be left unmatched in both of two names, one of the given length, whose ratio is at least the threshold."""
    longest = F.floor(length * ((2 - threshold) / threshold) + 1e-9)
    return F.floor((1 - threshold) * (length + longest) + 1e-9)


def alike(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """a, b, score: all pairs of different names with a ratio of at least the threshold (over 0.75), not blocked by anything.

    What the ratio matches is a common subsequence, so names that are alike differ by few left-out characters, each of which destroys two
    pairs of neighbouring characters at most: such names share one of the rarest 2 * edits + 1 of these pairs. Names too short for that
    use their single characters instead. Candidates are cut by their lengths, by how many pairs they share, and measured last.
    """
    if not 0.75 < threshold <= 1:
        raise ValueError("the threshold must be above 0.75")
    least = math.ceil(2 / (4 * threshold - 3))  # from this length on, alike names share a pair
    both = written(left.select("name", F.lit(True).alias("is_left")).unionByName(right.select("name", F.lit(False).alias("is_left"))).where("name <> ''").distinct(), "names")
    names = both.select("name").distinct()
    # the longer of a pair decides, so names below the least length, and those that may meet one, are posted by characters too
    reach = math.floor(least * threshold / (2 - threshold))
    kinds = F.concat(F.when(F.length("name") < least, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")), F.when(F.length("name") >= reach, F.array(F.lit(2))).otherwise(F.array().cast("array<int>")))
    each = names.select("name", F.explode(kinds).alias("q"))
    each = each.select("name", "q", F.posexplode(F.when(F.col("q") == 1, pieces(F.col("name"), 1)).otherwise(pieces(F.col("name"), 2))).alias("at", "piece"))
    # repeats count as pieces of their own
    each = each.withColumn("k", F.row_number().over(Window.partitionBy("name", "q", "piece").orderBy("at")))
    each = written(each.select("name", "q", F.struct("piece", "k").alias("token")), "tokens")
    counts = written(each.groupBy("q", "token").agg(F.count(F.lit(1)).alias("n")), "counts")
    bags = look_up(each, counts, ["q", "token"]).groupBy("name", "q").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("bag"))  # of one name's characters
    room = most_edits(F.length("name"), threshold) * F.col("q") + 1
    bags = written(bags.select("name", "q", F.transform("bag", lambda t: t["token"]).alias("bag"), room.cast("int").alias("room")), "bags")
    prefixes = bags.select("name", "q", "bag", F.explode(F.slice("bag", F.lit(1), F.col("room"))).alias("token"))
    sided = lambda flag, n, b: prefixes.join(both.where(F.col("is_left") == flag).select("name"), "name").select("q", "token", F.col("name").alias(n), F.col("bag").alias(b))
    pairs = sided(True, "a", "x").join(sided(False, "b", "y"), ["q", "token"]).where(F.col("a") != F.col("b"))
    la, lb = F.length("a"), F.length("b")
    edits = F.floor((1 - threshold) * (la + lb) + 1e-9)
    fits = (2 * F.least(la, lb) >= threshold * (la + lb) - 1e-9) & ((F.col("q") == 2) | (F.greatest(la, lb) < least))
    shared = F.size(F.array_intersect("x", "y")) >= F.greatest(F.size("x"), F.size("y")) - F.col("q") * edits
    found = pairs.where(fits & shared).select("a", "b").distinct()
    return found.withColumn("score", ratio("a", "b")).where(F.col("score") >= threshold)


def same_names(left: DataFrame, right: DataFrame, threshold: float = 0.85) -> DataFrame:
    """left, right, kind, score of all pairs whose names are equal, one within the other (of six characters and more), or alike.

    left, right: id, name (normal forms; null and empty ones meet nothing). kind: the first of equal, within, alike; score 1 for the first
    two. Names that repeat are compared once and joined back by equal keys.
    """
    a, b = left.where("name <> ''").select("name").distinct(), right.where("name <> ''").select("name").distinct()
    equal = a.join(b, "name").select(F.col("name").alias("a"), F.col("name").alias("b"), F.lit(0).alias("rank"), F.lit(1.0).alias("score"))
    inner = within(a, b).select(F.col("inner").alias("a"), F.col("outer").alias("b"), F.lit(1).alias("rank"), F.lit(1.0).alias("score"))
    outer = within(b, a).select(F.col("outer").alias("a"), F.col("inner").alias("b"), F.lit(1).alias("rank"), F.lit(1.0).alias("score"))
    near = alike(a, b, threshold).select("a", "b", F.lit(2).alias("rank"), "score")
    best = equal.unionByName(inner).unionByName(outer).unionByName(near).groupBy("a", "b").agg(F.min_by(F.struct("rank", "score"), "rank").alias("r"))
    kind = F.element_at(F.array(*map(F.lit, ("equal", "within", "alike"))), F.col("r.rank") + 1)
    joined = best.join(left.select(F.col("id").alias("left"), F.col("name").alias("a")), "a").join(right.select(F.col("id").alias("right"), F.col("name").alias("b")), "b")
    return joined.select("left", "right", kind.alias("kind"), "r.score")


def one_alike(a: Column, b: Column, threshold: float) -> Column:
    """Whether two names of one row mean the same."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    there = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return there & (((F.length(short) >= SHORTEST) & long.contains(short)) | (ratio(a, b) >= threshold))


def field_agrees(key: str, expected: Column, row: dict[str, Column]) -> Column:
    """Whether a field of a row is what was expected of it; an expected null wants none.

    Dates by day, links by their normal form, a postcode anywhere in the row's places, titles and venues by likeness (a venue in any place
    field), age ranges by their numbers, others by their normal text.
    """
    got = row.get(key, F.lit(None).cast("string"))
    plain = text.comparable
    where = [row[k] for k in ("postcode", "venue_address", "location") if k in row]
    if key in ("start_date", "end_date"):
        agrees = F.substring(F.coalesce(got, F.lit("")), 1, 10) == expected
    elif key == "event_url":
        bare = lambda c: F.lower(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"[?#].*$|/+$|/+(?=[?#])", ""))
        agrees = F.regexp_replace(bare(got), "/+$", "") == F.regexp_replace(bare(expected), "/+$", "")
    elif key == "postcode":
        bare = lambda c: F.regexp_replace(stated_postcode(c), " ", "")
        agrees = bare(F.concat_ws(" ", *where)).contains(bare(expected))
    elif key == "title":
        agrees = one_alike(plain(got), plain(expected), 0.85)
    elif key == "venue_name":
        agrees = F.greatest(*(one_alike(plain(row[k]), plain(expected), 0.8) for k in ("venue_name", "location", "venue_address") if k in row), F.lit(False))
    elif key == "age_range":
        numbers = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[0-9]+(?:\.[0-9]+)?|½"), F.lit(0))
        agrees = (F.size(numbers(expected)) > 0) & (numbers(got) == numbers(expected))
    else:
        agrees = plain(got) == plain(expected)
    return F.coalesce(F.when(expected.isNull(), F.coalesce(got, F.lit("")).isin("", "[]")).otherwise(agrees), F.lit(False))
