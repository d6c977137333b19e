"""Terms in texts: an index of term words that texts meet by equal keys, so that no text is held against all terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townkit.functions import text
from townkit.operators.joins import look_up
from townkit.operators.stages import written

#: Terms that say enough by themselves.
STRONG_TERMS = (
    "pushchair", "pram", "nappy", "nappies", "cot", "cot bed", "toddler cot bed",
    "moses basket", "highchair", "isofix base", "stair gate", "safety gate",
    "booster seat", "high back booster", "baby car seat", "group 0+ car seat",
    "i-size car seat", "all stage car seat", "sleepsuit", "babygrow", "dummy",
    "soother", "junior bed", "toddler bed", "travel cot", "playpen", "travel system",
    "pram system", "baby sleeping bag", "swaddle blanket", "changing mat", "run bike",
    "kids scooter", "feeding pillow", "muslin", "muslins", "car seat", "baby monitor",
)
WORDS = "[a-z0-9]+"


def words_of(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(WORDS), F.lit(0))


def pattern_of(term: Column, plural: bool) -> Column:
    """The term between characters that are no letters or digits, with s or es after it where plural."""
    plain = F.regexp_replace(term, r"([^a-z0-9 ])", r"\\$1")
    return F.concat(F.lit("(?<![a-z0-9])"), plain, F.lit("(?:s|es)?(?![a-z0-9])" if plural else "(?![a-z0-9])"))


def term_pairs(titles: DataFrame, terms: DataFrame, plural: bool) -> DataFrame:
    """title and all columns of terms, for each distinct title and each term that it holds.

    titles: title; terms: term (both as text.norm_listing gives them) and other columns; terms are distinct. The words of a term, and those
    with the plural's ending, are its keys; titles look up their runs of as many words as terms have. Only what meets is then matched by the
    term's pattern, which decides about signs between words. A term without letters or digits is in no title. The work grows with the
    titles' words, the terms, and the pairs found.
    """
    w = words_of(F.col("term"))
    keyed = terms.select(F.struct("*").alias("t"), "term", w.alias("w")).where(F.size("w") > 0)
    endings = F.when(F.col("term").rlike("[a-z0-9]$"), F.array(*(F.lit(e) for e in ("", "s", "es")))).otherwise(F.array(F.lit(""))) if plural else F.array(F.lit(""))
    keyed = keyed.select("t", F.size("w").alias("n_words"), F.explode(F.transform(endings, lambda e: F.concat(F.array_join("w", " "), e))).alias("key"), pattern_of(F.col("term"), plural).alias("pattern"))
    index = written(keyed.groupBy("key").agg(F.collect_list(F.struct("t", "pattern")).alias("met"), F.max("n_words").alias("n_words")), "terms")
    lengths = sorted(r["n_words"] for r in index.select("n_words").distinct().collect())  # numbers of words
    if not lengths:
        return titles.join(terms.limit(0), F.lit(False)).limit(0)
    at = lambda n: F.transform(F.expr(f"sequence(1, size(w) - {n - 1})"), lambda i: F.array_join(F.slice("w", i, n), " "))
    runs = F.flatten(F.array(*(F.when(F.size("w") >= n, at(n)).otherwise(F.array().cast("array<string>")) for n in lengths)))
    distinct = titles.select("title").distinct().withColumn("w", words_of(F.col("title")))
    keys = written(distinct.select("title", F.explode(F.array_distinct(runs)).alias("key")), "runs")
    met = look_up(keys, index.select("key", "met"), ["key"]).select("title", F.explode("met").alias("m"))
    return met.where(F.expr("title RLIKE m.pattern")).select("title", "m.t.*").distinct()


def item_terms(items: DataFrame, child_signal) -> DataFrame:
    """term, item, strong of a taxonomy's active items, each term once: its first strong entry, else its first.

    items: item, uk_terms (parted by semicolons), tier, needs_child, active, place (their order). A term of four letters and more that ends
    in s counts without it too, one that ends in ies with y. Terms of fewer than three characters are left out. A term is strong if its item
    needs no word for children, and it is the first of an item of tier A, a strong term, or holds such a word itself.
    """
    each = items.where("active").select("item", "tier", "needs_child", "place", F.posexplode(F.filter(F.transform(F.split("uk_terms", ";"), F.trim), lambda t: t != "")).alias("n", "raw"))
    each = each.withColumn("t", text.norm_listing(F.col("raw")))
    singular = F.when(F.col("t").endswith("ies") & (F.length("t") > 5), F.concat(F.expr("left(t, length(t) - 3)"), F.lit("y"))).when(F.col("t").endswith("s") & ~F.col("t").endswith("ss") & (F.length("t") > 4), F.expr("left(t, length(t) - 1)"))
    each = each.select("item", "tier", "needs_child", "place", "n", F.posexplode(F.array_compact(F.array(F.col("t"), singular))).alias("v", "term")).where(F.length("term") >= 3)
    strong = ~F.coalesce("needs_child", F.lit(False)) & (((F.col("n") == 0) & (F.col("tier") == "A")) | F.col("term").isin(*STRONG_TERMS) | child_signal(F.col("term")))
    first = F.min_by(F.struct("item", "strong", "place", "n", "v"), F.struct(~F.col("strong"), F.col("place"), F.col("n"), F.col("v")))
    return each.withColumn("strong", F.coalesce(strong, F.lit(False))).groupBy("term").agg(first.alias("e")).select("term", "e.item", "e.strong", "e.place", "e.n", "e.v")


def match_items(rows: DataFrame, entries: DataFrame, child_signal) -> DataFrame:
    """id, item, term, strength of the rows that hold a term. rows: id, title, description; entries: as item_terms gives them.

    Longer terms come first, strong ones before others of their length. With a word for children in title or description the first one
    counts, and is strong; without, the first strong one, else the first, which is weak. Null titles hold nothing. Rows of one title are
    matched once.
    """
    titled = rows.select("id", text.norm_listing(F.col("title")).alias("title"), child_signal(F.concat_ws(" ", "title", "description")).alias("child"))
    order = F.struct((-F.length("term")).alias("length"), (~F.col("strong")).alias("weak"), "place", "n", "v", "term")
    pairs = term_pairs(titled, entries, plural=True)
    best = pairs.groupBy("title").agg(F.min_by(F.struct("item", "term", "strong"), order).alias("any"), F.min_by(F.struct("item", "term"), F.when(F.col("strong"), order)).alias("sure"))
    met = titled.join(best, "title")
    as_strong = F.coalesce(F.col("child"), F.lit(False)) | F.col("sure").isNotNull()
    chosen = F.when(F.col("child") | F.col("sure").isNull(), F.struct("any.item", "any.term")).otherwise(F.col("sure"))
    return met.withColumn("chosen", chosen).select("id", "chosen.item", "chosen.term", F.when(as_strong, "strong").otherwise("weak").alias("strength"))


def excluded(rows: DataFrame, exclusions: DataFrame, child_signal: Column) -> DataFrame:
    """id, reason, term of rows that an exclusion hits: hard ones always, soft ones unless child_signal holds. The first exclusion counts.

    rows: id, title; exclusions: term, hard, reason, place. Terms are matched as they are, without plurals.
    """
    known = exclusions.withColumn("raw", F.col("term")).withColumn("term", text.norm_listing(F.col("raw"))).where("term <> ''")
    known = known.groupBy("term").agg(F.min(F.when(F.col("hard"), F.struct("place", "raw", "reason"))).alias("always"), F.min(F.struct("place", "raw", "reason")).alias("unless"))
    titled = rows.select("id", text.norm_listing(F.col("title")).alias("title"), F.coalesce(child_signal, F.lit(False)).alias("child"))
    hits = term_pairs(titled, known, plural=False).groupBy("title").agg(F.min("always").alias("always"), F.min("unless").alias("unless"))
    found = titled.join(hits, "title").select("id", F.when(F.col("child"), F.col("always")).otherwise(F.col("unless")).alias("e")).where("e IS NOT NULL")
    return found.select("id", "e.reason", F.col("e.raw").alias("term"))
