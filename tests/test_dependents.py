import pytest
from pyspark.sql import functions as F

from townkit.operators import dependents


@pytest.mark.parametrize("partitions", [1, 5])
def test_ids_are_dense_and_dependents_resolve(spark, partitions):
    stored = spark.createDataFrame([(7, "u3", "old"), (4, "u900", "kept")], "id long, url string, name string")
    rows = [(f"u{i % 300}", f"n{i}", i) for i in range(900)] + [(None, "x", 1)]
    incoming = spark.createDataFrame(rows, "url string, name string, at long").repartition(partitions)
    after, ids = dependents.upsert_returning(stored, incoming, "url", "id", "at")
    found = {r["url"]: (r["id"], r["name"]) for r in after.collect()}
    assert found["u3"] == (7, "n603") and found["u900"] == (4, "kept") and len(found) == 301 and after.count() == 301
    fresh = sorted(i for u, (i, _) in found.items() if u not in ("u3", "u900"))
    assert fresh == list(range(8, 8 + 299)) and [found[u][0] for u in sorted(u for u in found if u not in ("u3", "u900"))] == fresh
    children = incoming.where("url IS NOT NULL").select("url", F.col("at").alias("record"))
    assert {(r["id"], r["url"]) for r in dependents.with_ids(children, ids, "url").collect()} == {(found[u][0], u) for u, *_ in rows if u}
    again, _ = dependents.upsert_returning(after, incoming, "url", "id", "at")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, after.collect()))
    empty, none = dependents.upsert_returning(stored, incoming.limit(0), "url", "id", "at")
    assert empty.count() == 2 and none.count() == 0


def test_one_bad_record_withholds_its_batch_only(spark):
    records = spark.createDataFrame([("a", 1, None), ("a", 2, None), ("b", 3, None), ("b", 4, "no end"), ("b", 5, "no name"), ("c", 6, None), (None, 7, None)], "feed string, id int, problem string")
    expected = spark.createDataFrame([("a", 2), ("c", 2), ("d", 1), ("e", 0)], "feed string, expected long")
    kept, report = dependents.whole_batches(records, "feed", "problem", expected)
    assert sorted(r["id"] for r in kept.collect()) == [1, 2, 7]
    assert {r["feed"]: (r["records"], r["bad"], r["first_problem"], r["published"]) for r in report.collect()} == {"a": (2, 0, None, True), "b": (3, 2, "no end", False), "c": (1, 0, None, False), "d": (0, 0, None, False), "e": (0, 0, None, True), None: (1, 0, None, True)}
    kept, _ = dependents.whole_batches(records, "feed", "problem")
    assert sorted(r["id"] for r in kept.collect()) == [1, 2, 6, 7]
    assert dependents.whole_batches(records.limit(0), "feed", "problem")[1].count() == 0
