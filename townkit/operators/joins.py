"""Joins with a relation that has one row for each key: broadcast where its values were measured small, else hot keys apart from the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: Bytes of values that may be broadcast.
BROADCAST_BYTES = 48 << 20
#: A key is hot if over 1/HOT_SHARE of the rows have it, so there are fewer hot keys than HOT_SHARE.
HOT_SHARE = 200


def value_bytes(column, kind: DataType):
    """Bytes of one value; list elements count 16 bytes a plain field."""
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 8
    if isinstance(kind, ArrayType):
        inner = len(kind.elementType.fields) if isinstance(kind.elementType, StructType) else 1
        return F.greatest(F.coalesce(F.size(column), F.lit(0)), F.lit(0)) * (16 * inner + 16) + 16
    if isinstance(kind, StructType):
        return sum((value_bytes(column[f.name], f.dataType) for f in kind.fields), F.lit(16))
    return F.lit(8)


def is_small(df: DataFrame) -> bool:
    """Whether the values of df have at most BROADCAST_BYTES, counted by Spark."""
    row = sum((value_bytes(F.col(f.name), f.dataType) for f in df.schema.fields), F.lit(16))
    return df.agg(F.coalesce(F.sum(row.cast("long")), F.lit(0)).alias("n")).collect()[0]["n"] <= BROADCAST_BYTES


def look_up(rows: DataFrame, one: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with `one`, which has at most one row for each key; both are read again, so they should be written before.

    If `one` is not small, the keys that many rows have are counted, and their few rows are broadcast; only the others are shuffled. `how`
    is inner or left; null keys meet nothing.
    """
    if is_small(one):
        return rows.join(F.broadcast(one), keys, how)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.count()
    hot = F.broadcast(counts.where(F.col("_n") * HOT_SHARE > total).select(*keys))  # fewer than HOT_SHARE rows
    few = F.broadcast(one.join(hot, keys, "left_semi"))
    return rows.join(hot, keys, "left_semi").join(few, keys, how).unionByName(rows.join(hot, keys, "left_anti").join(one, keys, how))
