"""What several operators need: the shared folder, written stages, text batches, sized broadcasts, joins with hot keys, components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

from townkit.operators.stages import shared_dir, written  # noqa: F401  (for the operators here)

#: Characters of text that one Python step holds as word lists at a time.
CHARS_AT_ONCE = 1_000_000
#: Bytes of values that may be broadcast; what is larger is joined by a shuffle.
BROADCAST_BYTES = 48 << 20
#: A key is hot if it has over 1/HOT_SHARE of the rows, so that there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 200


def data_bytes(df: DataFrame) -> int:
    """Bytes of the values of df, counted by Spark: strings and binaries by their length, array elements and other values as 8 bytes."""

    def width(field):
        if isinstance(field.dataType, StringType | BinaryType):
            return F.coalesce(F.octet_length(F.col(field.name)), F.lit(0)) + 8
        if isinstance(field.dataType, ArrayType):
            return F.greatest(F.size(F.col(field.name)), F.lit(0)) * (32 if field.dataType.elementType.typeName() == "struct" else 8) + 16
        return F.lit(8)

    row = sum((width(f) for f in df.schema.fields), F.lit(16))
    return df.agg(F.coalesce(F.sum(row), F.lit(0)).alias("n")).collect()[0]["n"]


def fits(df: DataFrame) -> bool:
    return data_bytes(df) <= BROADCAST_BYTES


def sized(small: DataFrame) -> DataFrame:
    """small, to be broadcast if its values have at most BROADCAST_BYTES."""
    return F.broadcast(small) if fits(small) else small


def spread_join(rows: DataFrame, one: DataFrame, keys: list[str], count: str) -> DataFrame:
    """rows joined with `one`, which has a row for each key and in `count` the number of rows that have it (both written before).

    If `one` is small it is broadcast. Otherwise hot keys are joined by a broadcast of their few rows, and only the others by a shuffle.
    """
    if fits(one):
        return rows.join(F.broadcast(one), keys)
    total = one.agg(F.sum(count).alias("n")).collect()[0]["n"]
    is_hot = F.col(count) * HOT_SHARE > total
    hot = F.broadcast(one.where(is_hot))  # fewer than HOT_SHARE rows
    return rows.join(hot, keys).unionByName(rows.join(F.broadcast(one.where(is_hot).select(*keys)), keys, "left_anti").join(one.where(~is_hot), keys))


def text_groups(texts: list[str], most: int = CHARS_AT_ONCE) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of texts that hold about `most` characters, at least one text each."""
    start = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > most:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


#: Rows and bytes of a batch that Spark hands to Python. Spark's default of 10,000 rows is far too many where a row is a whole text.
ROWS_A_BATCH, BYTES_A_BATCH = 1_000, 16 << 20


def small_batches(docs: DataFrame) -> DataFrame:
    """docs, with the session's batches for Python bounded; a lower number of rows that the session sets stays."""
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= ROWS_A_BATCH:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_A_BATCH))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_A_BATCH))
    return docs


def id_and_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), whatever other columns there are."""
    return small_batches(docs).select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))


def batch_of(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b): component is the smallest node that links reach.

    Alternates large-star and small-star steps: every step is a min per node, so a node with very many links is summed up
    on the map side first, and the rounds grow with the logarithm of the longest path. Each round is written to the shared folder.
    A node's minimum goes back to its links by a broadcast where all minima are small, else hot nodes by a broadcast of their own.
    """
    current = written(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct(), "links")
    if current.isEmpty():
        return current.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    for _ in range(rounds):
        small = 2 * data_bytes(current) <= BROADCAST_BYTES

        def back(rows: DataFrame, least: DataFrame) -> DataFrame:
            return rows.join(F.broadcast(least.drop("n")), "x") if small else spread_join(rows, written(least, "minima"), ["x"], "n")  # noqa: B023

        # large star: every larger neighbour of a node is linked to the node's least neighbour
        both = current.select(F.col("hi").alias("x"), F.col("lo").alias("y")).union(current.select(F.col("lo").alias("x"), F.col("hi").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = back(both.where("y > x"), least).select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        if not small:
            large = written(large, "links")
        # small star: every smaller neighbour and the node itself are linked to the least of them
        least = large.groupBy("x").agg(F.min("y").alias("m"), F.count(F.lit(1)).alias("n"))
        joined = back(large, least).select("y", "m").where("y <> m").union(least.select(F.col("x").alias("y"), "m"))
        after = written(joined.select(F.col("y").alias("hi"), F.col("m").alias("lo")).distinct(), "links")
        # done when links are stars: every node has one target, and no target is itself linked
        stars = after.select("lo").distinct().join(after.select(F.col("hi").alias("lo")).distinct(), "lo", "left_semi").isEmpty() and after.groupBy("hi").count().where("count > 1").isEmpty()
        current = after
        if stars:
            break
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(current.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
