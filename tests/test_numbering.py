import pytest
from pyspark.sql import functions as F

from townkit.operators.numbering import numbered


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_numbers_are_dense_and_sums_run(spark, partitions):
    rows = [(i * 7919 % 1000, None if i % 5 == 0 else i % 11) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(4)
    found = sorted(tuple(r) for r in numbered(df, [F.col("k")], "v", partitions).collect())
    total = 0
    for at, ((k, v), row) in enumerate(zip(sorted(rows), found, strict=True)):
        assert row == (k, v, at, total)
        total += v or 0


def test_nulls_ties_and_empty(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("a",)], "s string").withColumn("task", F.lit(1)).withColumn("n", F.lit("x"))
    found = numbered(df, [F.col("s").asc_nulls_last()], partitions=3)
    assert [(r["row_number"], r["s"], r["task"], r["n"]) for r in found.orderBy("row_number").collect()] == [(0, "a", 1, "x"), (1, "a", 1, "x"), (2, "b", 1, "x"), (3, None, 1, "x")]
    assert numbered(df.limit(0), [F.col("s")]).columns == [*df.columns, "row_number"] and numbered(df.limit(0), [F.col("s")]).count() == 0


def test_no_task_gets_all_rows(spark):
    plan = numbered(spark.range(1000), [F.col("id")], "id", 4)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]


def test_ranks_of_groups(spark):
    """A null group, a group of one value, and one with most of the rows; null values take no place."""
    import numpy as np

    from townkit.operators import feeds
    from townkit.operators.numbering import numbered_in_groups

    values = {"hot": [(i * 37) % 101 for i in range(700)], "one": [5] * 30, None: [3, 1, 2, 2], "few": [4, 1]}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [("hot", None)], "g string, v double").repartition(5)
    p75 = {r["g"]: (r["at"], r["n"]) for r in feeds.percentile_cont(df, "g", "v", 0.75).collect()}
    median = {r["g"]: r["median"] for r in feeds.upper_median(df, "g", "v").collect()}
    for g, vs in values.items():
        assert p75[g] == (float(np.percentile(vs, 75)), len(vs)) and median[g] == sorted(vs)[len(vs) // 2]
    placed = numbered_in_groups(df.where("v IS NOT NULL"), ["g"], [F.col("v")], "v").collect()
    for g, vs in values.items():
        rows = sorted(((r["place"], r["v"], r["before"]) for r in placed if r["g"] == g), key=lambda r: r[0])
        assert [r[0] for r in rows] == list(range(len(vs))) and [r[1] for r in rows] == sorted(vs) and [r[2] for r in rows] == [sum(sorted(vs)[:i]) for i in range(len(vs))]
