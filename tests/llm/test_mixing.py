from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from townkit.llm import mixing, queries


def by_source(docs, found):
    """source -> (words, target, taken); docs have distinct ids."""
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    out = defaultdict(lambda: [0, 0.0, 0])
    for r in found:
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        row = out[source[r["doc_id"]]]
        row[0], row[1], row[2] = row[0] + r["size"], r["target"], row[2] + r["taken"]
    return out


def stops(sizes, weights=(5, 2, 1), most=3):
    """Targets by rounds: what stops stays, the rest is shared again."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    total, stopped = sum(sizes), set()
    while True:
        level = (total - sum(most * sizes[i] for i in stopped)) / max(1, sum(w[i] for i in range(len(sizes)) if i not in stopped))
        more = {i for i in range(len(sizes)) if i not in stopped and most * sizes[i] < level * w[i]}
        if not more:
            return [most * sizes[i] if i in stopped else level * w[i] for i in range(len(sizes))]
        stopped |= more


@pytest.fixture(scope="module")
def many(spark):
    """Sources of very different sizes, one of them a third of all rows, one null."""
    source = F.expr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL WHEN id % 50 < 3 THEN 'tiny' ELSE concat('s', id % 7) END")
    return spark.range(6000).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', cast(3 + hash(id) % 3 + id % 40 AS int))").alias("text"), source.alias("source")).repartition(5)


@pytest.mark.parametrize("small", [True, False])
def test_targets_are_met(many, small, request):
    if not small:
        request.getfixturevalue("shuffles")
        many = many.where("doc_id < 800")
    found = mixing.mix(many).collect()
    sources = by_source(many, found)
    order = sorted(sources, key=lambda s: (s is None, s))
    for s, target in zip(order, stops([sources[s][0] for s in order]), strict=True):
        assert sources[s][1] == pytest.approx(target) and 0 <= sources[s][1] - sources[s][2] <= max(0.002 * target, 45)
    if small:
        assert sorted(map(tuple, found)) == sorted(map(tuple, mixing.mix(many.repartition(3)).collect()))


def test_thresholds_are_nested(spark, many):
    rows = mixing.sized_rows(many).cache()
    before = {}
    for share in (0.05, 0.31, 1.0):
        budgets = rows.groupBy("key").agg(F.count("*").alias("n"), (F.sum("size") * share).alias("budget"))
        got = {r["key"]: (r["below"], r["got"]) for r in mixing.thresholds(rows.select("key", "size", "hash"), budgets, True).collect()}
        below = spark.createDataFrame([(k, v[0]) for k, v in got.items()], "key string, below long")
        held = {r["key"]: r["v"] for r in rows.join(below, "key").where("hash < below").groupBy("key").agg(F.sum("size").alias("v")).collect()}
        assert all(got[k][0] >= before.get(k, 0) and got[k][1] == held.get(k, 0) for k in got)
        assert all(r["budget"] - got[r["key"]][1] < 50 for r in budgets.collect())
        before = {k: v[0] for k, v in got.items()}


def test_awkward_rows(spark, awkward, no_documents):
    found = mixing.mix(awkward).collect()
    assert len(found) == awkward.count() and {r["source_size"] for r in found} == {sum(r["size"] for r in found)}
    assert all(r["taken"] == r["size"] for r in found)  # one source is its own target
    assert mixing.mix(no_documents).count() == 0
    wordless = spark.createDataFrame([(1, None, "a"), (2, " \t", None)], "doc_id long, text string, source string")
    assert sorted(tuple(r) for r in mixing.mix(wordless).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    equal = spark.createDataFrame([(1, "a b c", "a")] * 8 + [(2, "x", "b")], "doc_id long, text string, source string")
    assert len({r["taken"] for r in mixing.mix(equal).where("doc_id = 1").collect()}) == 1


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    result = con.execute(queries.ORACLE_SQL["op12_source_mixing"])
    columns = [d[0] for d in result.description]
    assert sorted(tuple(r) for r in queries.QUERIES["op12_source_mixing"](spark, sf).select(*columns).collect()) == sorted(result.fetchall())
