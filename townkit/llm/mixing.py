"""Mixing sources to target weights by thresholds on a hash, found from histograms without sorting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townkit.llm import shared
from townkit.llm.shared import data_bytes, spread_join, written
from townkit.operators.numbering import numbered

#: Bits of a row's hash, and bits that one histogram splits a range by (8,192 buckets a source).
HASH_BITS, LEVEL_BITS = 52, 13
#: The table of sources grows by one cut a pass: so many times its bytes are counted before it is broadcast.
PASS_ROOM = 8
#: Java's pattern of a word.
WORD = r"[^\x20\x09-\x0D]+"


def row_hash(doc_id: Column, text: Column) -> Column:
    """52 bits of the id and the text, equal on every run: rows of one id and text are told apart by nothing."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def sized_rows(docs: DataFrame) -> DataFrame:
    """doc_id, key (the source, null apart), source, size (words of the whole text; null: 0), hash."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    source = F.col("source").cast("string")
    key = F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), source.alias("source"), size.alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("hash"))


def targets(sources: DataFrame, weights: tuple[int, ...], most: int, order: list[Column]) -> DataFrame:
    """sources (size: words) with `target`: all words shared by the weights, which repeat in the order of sources.

    A target stops at `most` times its source's size, and what is over is shared again by weight until no target is above. All targets
    below their stop are one level times their weight, so each round is two sums over the sources; the level only rises.
    """
    ranked = numbered(sources, order)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("row_number") % len(weights) + 1).cast("int"))
    ranked = written(ranked.withColumn("weight", weight.cast("long")).withColumn("stop", F.col("size") * most).drop("row_number"), "sources")
    total = ranked.agg(F.sum("size").alias("t"), F.sum("weight").alias("w")).collect()[0]
    level, stopped = (total["t"] / total["w"], -1) if total["w"] else (0.0, 0)
    while total["w"]:
        over = ranked.where(F.col("stop") < F.col("weight") * F.lit(level))
        now = over.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("stop"), F.lit(0)).alias("t"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).collect()[0]
        if now["n"] == stopped:
            break
        stopped, level = now["n"], (total["t"] - now["t"]) / (total["w"] - now["w"])
    share = F.col("weight") * F.lit(level)
    return ranked.withColumn("target", F.when(F.col("stop") < share, F.col("stop").cast("double")).otherwise(share))


def meet(rows: DataFrame, one: DataFrame, small: bool) -> DataFrame:
    """rows with the columns of their key's row in `one`. small: the table of all keys was measured, and fits a broadcast."""
    return rows.join(F.broadcast(one), "key") if small else spread_join(rows, one, ["key"], "n")


def thresholds(rows: DataFrame, budgets: DataFrame, small: bool) -> DataFrame:
    """key, below, got: for each budget the largest hash threshold whose rows hold at most `budget` words, and the words they hold.

    rows: key, size, hash. budgets: key, budget (double), n (rows of the key). A histogram of sums by key and bucket of the hash gives the
    bucket in which the budget ends; only the rows of that bucket are kept and split again, until it is one row (or rows of one hash, which
    are taken or left together). Nothing is sorted but the buckets of a key, 8,192 at most. A larger budget of the same rows has a threshold
    no smaller, so what it takes contains what the smaller one takes.
    """
    bounds = budgets.select("key", "n", "budget", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("got"))
    done, width = None, HASH_BITS
    while True:
        inside = meet(rows, bounds, small)
        if width < HASH_BITS:
            inside = written(inside.where((F.col("hash") >= F.col("low")) & (F.col("hash") < F.col("low") + F.lit(1 << width))), "boundary")
            rows = inside.select("key", "size", "hash")
        bits = max(0, width - LEVEL_BITS)
        sums = inside.groupBy("key", F.shiftright("hash", bits).alias("bucket")).agg(F.sum("size").alias("v"), F.count(F.lit(1)).alias("rows"), F.min("got").alias("was"), F.min("budget").alias("budget"))
        upto = F.col("was") + F.sum("v").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        over = F.when(F.col("upto") > F.col("budget"), F.col("bucket"))
        end = F.min_by(F.struct("bucket", "rows", (F.col("upto") - F.col("v")).alias("got")), over)
        step = sums.withColumn("upto", upto).groupBy("key").agg(end.alias("e"), F.max(over).isNull().alias("all"), F.max("upto").alias("whole"), F.min("budget").alias("budget"))
        # a budget that ends in no bucket takes all rows of the range: that can only be so at the first level
        found = written(step.select(
            "key", "budget",
            F.when(F.col("all"), F.lit(1 << HASH_BITS)).otherwise(F.col("e.bucket") * F.lit(1 << bits)).alias("low"),
            F.when(F.col("all"), F.col("whole")).otherwise(F.col("e.got")).alias("got"),
            F.when(F.col("all"), F.lit(0)).otherwise(F.col("e.rows")).cast("long").alias("n"),
        ), "bounds")
        settled = F.lit(bits == 0) | (F.col("n") <= 1)
        now = found.where(settled).select("key", F.col("low").alias("below"), "got")
        done, bounds, width = now if done is None else done.union(now), found.where(~settled), bits
        if bounds.isEmpty():
            return done


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, near: float = 1e-3, passes: int = 5) -> DataFrame:
    """doc_id, size, source_size, target, taken: a row for each document, and how many of its words the mix takes, repeats counted.

    Sources (by code point, null last) get the weights in turn. A source whose target is k times its size and a rest takes each document k
    times, and once more the documents whose hash is below the threshold of the rest. Documents are taken whole. Where the document at the
    threshold is large against the target, over the share `near` is open: it is filled from the source's documents that are no larger than
    what is open, by thresholds of their own, in at most `passes` passes. The mix of a source never exceeds its target.

    Null texts and texts without words have size 0 and take 0, very long ones count whole; a null doc_id is an id of its own kind; rows of
    one id and text are taken alike; a null source is a source. An empty table gives an empty result. Columns other than doc_id, text and
    source are left out. Texts are read once; the passes read ids, sizes and hashes.
    """
    rows = written(sized_rows(docs), "sizes")
    sources = rows.groupBy("key").agg(F.min("source").alias("source"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    planned = targets(sources, weights, most, [F.col("source").asc_nulls_last()])
    times = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(F.lit(0)).cast("long")
    planned = planned.select("key", "n", F.col("size").alias("source_size"), "target", times.alias("times"), (F.col("target") - times * F.col("size")).alias("open"))
    cut = F.array().cast("array<struct<below:long,largest:double>>")
    planned = written(planned.withColumn("cuts", cut), "planned")
    small = PASS_ROOM * data_bytes(planned) <= shared.BROADCAST_BYTES
    # cuts: a document is taken once more if it is below the threshold of any pass and no larger than what that pass took
    is_cut = F.exists("cuts", lambda c: (F.col("hash") < c["below"]) & (F.col("size") <= c["largest"]))
    for n in range(passes):
        # the first pass takes documents of any size, so that its thresholds are nested
        open_ = planned.where(F.col("open") > F.col("target") * near).select("key", "n", F.col("open").alias("budget"), "cuts")
        if open_.isEmpty():
            break
        left = meet(rows, open_, small).where(~is_cut & (F.lit(n == 0) | (F.col("size") <= F.col("budget")))).select("key", "size", "hash")
        found = thresholds(left, open_.select("key", "n", "budget"), small)
        largest = F.lit(float("inf")) if n == 0 else F.col("open")
        one_more = F.concat("cuts", F.array(F.struct(F.col("below").alias("below"), largest.alias("largest"))))
        columns = [F.col(c) for c in ("key", "n", "source_size", "target", "times")]
        open_now, cuts = F.col("open") - F.coalesce("got", F.lit(0)), F.when(F.col("below").isNull(), F.col("cuts")).otherwise(one_more)
        planned = written(planned.join(found, "key", "left").select(*columns, open_now.alias("open"), cuts.alias("cuts")), "planned")
    taken = F.col("size") * (F.col("times") + F.when(is_cut, 1).otherwise(0))
    return meet(rows, planned, small).select("doc_id", "size", "source_size", "target", taken.alias("taken"))
