"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townkit.llm.shared import sized, written


def words_of(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingles(rows: DataFrame, keys: list[str], n: int, whole: bool = False) -> DataFrame:
    """A row for each place of n words: keys and `shingle`, the hash of the words there. Texts of fewer words have none, with `whole` nor
    have those of more."""
    placed = rows.select(*keys, words_of(F.col("text")).alias("words")).where(F.size("words") == n if whole else F.size("words") >= n)
    placed = placed.select(*keys, "words", F.explode(F.expr(f"sequence(0, size(words) - {n})")).alias("at"))
    return placed.select(*keys, F.xxhash64(*(F.expr(f"words[at + {i}]") for i in range(n))).alias("shingle"))


def short_lengths(benchmark: DataFrame, n: int) -> list[int]:
    """The word counts under n of items that have fewer than n words: at most n - 1 numbers."""
    lengths = benchmark.where(F.col("item_id").isNotNull()).select(F.size(words_of(F.coalesce("text", F.lit("")))).alias("m")).where(f"m > 0 AND m < {n}").distinct()
    return sorted(row["m"] for row in lengths.collect())


def item_shingles(benchmark: DataFrame, n: int, short: list[int]) -> DataFrame:
    """item_id, shingle, n_shingles: the distinct shingles of each item; an item of 1 to n - 1 words has one, all its words."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).where(F.col("item_id").isNotNull())
    each = shingles(items, ["item_id"], n)
    for m in short:
        each = each.union(shingles(items, ["item_id"], m, whole=True))
    each = each.distinct()
    return each.join(each.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_shingles")), "item_id")


def document_shingles(rows: DataFrame, keys: list[str], n: int, short: list[int]) -> DataFrame:
    """Shingles of n words, and of those short lengths that items have."""
    each = shingles(rows, keys, n)
    for m in short:
        each = each.union(shingles(rows, keys, m))
    return each


def sketches(items: DataFrame, threshold: float) -> DataFrame:
    """item_id and shingle: the MinHash sketch of each item, its least shingles in a random order.

    Items are partitioned by size into classes up to u = 1, 2, 4, ... shingles. In the class of u an item keeps its
    floor((1 - threshold) * u) + 1 least shingles: a document that holds the threshold's share of its shingles misses at most
    floor((1 - threshold) * n) <= floor((1 - threshold) * u) of them, hence holds one of the sketch. The search loses nothing,
    however long the document is.
    """
    # 1e-9: (1 - threshold) * u has rounding below whole numbers
    kept = F.floor(F.pow(F.lit(2.0), F.ceil(F.log2("n_shingles"))) * F.lit(1 - threshold) + 1e-9) + 1
    order = Window.partitionBy("item_id").orderBy(F.xxhash64("shingle", F.lit(7)), "shingle")
    return items.withColumn("place", F.row_number().over(order)).where(F.col("place") <= kept).select("item_id", "shingle")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """doc_id, text_hash, item_id, shared, item_shingles, containment: each document and item of which it holds at least the threshold's share of shingles.

    An item of fewer than n words is one shingle of all of them, and is looked up among the documents' runs of that length. Null texts
    are empty; texts without words meet nothing, very long ones are searched whole; null item_ids are left out. Rows
    are told apart by doc_id (null too) and text: equal rows give one result row, rows of one id with other texts their own. Further
    columns are left out.

    Documents are exploded inside one generated stage, where the broadcast sketches of the items let through candidate places only;
    the exact count then reads just the candidate documents.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    short = short_lengths(benchmark, n)
    items = written(item_shingles(benchmark, n, short), "items")
    keys = ["doc_id", "text_hash"]
    sketch = written(sketches(items, threshold), "sketches")
    found = document_shingles(texts, keys, n, short).join(sized(sketch), "shingle").select(*keys, "item_id").distinct()
    found = written(found, "candidates")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])
    rows = found.select(*keys).distinct()
    rows = sized(rows)
    # equal rows hold the same shingles: counting distinct ones per key needs no distinct rows
    searched = texts.join(rows, same(texts, rows), "left_semi")
    hits = document_shingles(searched, keys, n, short).join(sized(items), "shingle").select(*keys, "item_id", "shingle", "n_shingles").distinct()
    shared = hits.groupBy(*keys, "item_id", "n_shingles").agg(F.count(F.lit(1)).alias("shared"))
    kept = shared.where(F.col("shared") >= F.col("n_shingles") * threshold - 1e-9)
    # only candidates of the search count
    kept = kept.join(found, same(kept, found) & (kept["item_id"] == found["item_id"]), "left_semi")
    return kept.select(*keys, "item_id", "shared", F.col("n_shingles").alias("item_shingles"), F.round(F.col("shared") / F.col("n_shingles"), 6).alias("containment"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """docs without the rows that hold a benchmark item; all columns and all other rows stay, repeated ones and null texts too.

    Rows are told apart by doc_id (null too) and text. An empty table stays empty, and an empty benchmark takes nothing away.
    """
    dirty = written(contaminated(docs, benchmark, threshold, n).select(F.col("doc_id").alias("dirty_id"), F.col("text_hash").alias("dirty_hash")).distinct(), "dirty")
    dirty = sized(dirty)
    return docs.join(dirty, docs["doc_id"].cast("long").eqNullSafe(dirty["dirty_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == dirty["dirty_hash"]), "left_anti")
