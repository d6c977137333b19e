"""Hierarchies and alias chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townkit.operators.stages import written


def ancestors(edges: DataFrame, depth: int = 8) -> DataFrame:
    """child, ancestor, depth (the least): closure of the edges (child, parent), by joins of the last level with the edges.

    Each round reads its level from a written table, so the plan does not grow; it ends when a level is empty, or raises at `depth`, as
    a hierarchy that is deeper has a cycle.
    """
    edges = written(edges.select("child", "parent").distinct(), "edges")
    level, found = edges.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")), None
    for n in range(1, depth + 1):
        found = level if found is None else found.unionByName(level)
        level = level.join(edges.select(F.col("child").alias("ancestor"), "parent"), "ancestor").select("child", F.col("parent").alias("ancestor"), F.lit(n + 1).alias("depth")).distinct()
        level = written(level, "level")
        if level.isEmpty():
            return found.groupBy("child", "ancestor").agg(F.min("depth").alias("depth"))
    raise ValueError(f"the hierarchy has a cycle, or is deeper than {depth}")


def canonical(rows: DataFrame, id_column: str, target: str, hops: int = 20, lost: bool = False) -> DataFrame:
    """id, canonical, hops: the end of each row's chain of targets. A target that is no row is an end. Raises if a chain is longer than `hops`, as one with a cycle is; if `lost`, the rows of such chains have nulls instead.

    Pointer doubling: after k rounds a chain of 2^k steps is followed; each round is written.
    """
    current = written(rows.select(F.col(id_column).alias("id"), F.coalesce(target, id_column).alias("to"), F.when(F.col(target).isNull(), 0).otherwise(1).alias("n")), "chains")
    more = current.where("n > 0").select(F.col("id").alias("to"))
    for _ in range(hops.bit_length()):
        after = current.select(F.col("id").alias("to"), F.col("to").alias("then"), F.col("n").alias("m")).where("m > 0")
        joined = current.join(after, "to", "left")
        current = written(joined.select("id", F.coalesce("then", "to").alias("to"), (F.col("n") + F.coalesce("m", F.lit(0))).alias("n")), "chains")
    if lost:
        open_ = current.join(more.select("to", F.lit(True).alias("open")).distinct(), "to", "left")
        ends = F.col("open").isNull() & (F.col("n") <= hops)
        return open_.select("id", F.when(ends, F.col("to")).alias("canonical"), F.when(ends, F.col("n")).alias("hops"))
    if not current.where(F.col("n") > hops).isEmpty() or not current.join(more, "to", "left_semi").isEmpty():
        raise ValueError(f"a chain has a cycle, or is longer than {hops}")
    return current.select("id", F.col("to").alias("canonical"), F.col("n").alias("hops"))
