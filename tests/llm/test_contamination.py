import random
import re

from pyspark.sql import functions as F

from townkit.llm import contamination

from .conftest import sentence


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items):
    out = set()
    for i, t in docs:
        w = words(t)
        held = {tuple(w[j : j + n]) for n in range(1, 6) for j in range(len(w) - n + 1)}
        for k, u in items:
            v = words(u)
            own = {tuple(v[j : j + 5]) for j in range(len(v) - 4)} or ({tuple(v)} if v else set())
            if k is not None and own and len(own & held) >= 0.8 * len(own) - 1e-9:
                out.add((i, k, len(own & held), len(own)))
    return sorted(map(repr, out))


def rows_of(df):
    return sorted(repr((r["doc_id"], r["item_id"], r["shared"], r["item_shingles"])) for r in df.collect())


def test_against_brute_force(spark):
    r = random.Random(5)
    items = [(k, sentence(100 + k, r.randint(5, 60))) for k in range(30)] + [(30, sentence(100, 60)), (31, "too short text"), (32, None), (33, "Changed"), (34, "so short an item"), (None, sentence(3, 30))]
    docs = []
    for i in range(60):
        words = sentence(500 + i, r.randint(0, 400)).split()
        part = sentence(100 + i % 30, 60).split()[: len(dict(items)[i % 30].split())] if i % 30 < 30 else []
        part = items[i % 30][1].split()
        for _ in range(i % 4):  # changed words take away up to five shingles each
            part[r.randrange(len(part))] = "changed"
        part += "So short! An ITEM, too short".split() if i % 7 == 0 else ["too short text"] if i % 7 == 1 else []
        docs.append((i, " ".join(words[:50] + part + words[50:]).upper() if i % 2 else " ".join(part)))
    docs += [(60, "so short an item"), (61, "too short"), (62, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("shingle", F.lit(1))
    assert rows_of(contamination.contaminated(d, b)) == brute(docs, items)


def test_sketches_lose_nothing(spark):
    """At every size, any set of missing shingles that leaves the threshold's share leaves one of the sketch."""
    rows = [(n, n * 1000 + i, n) for n in range(1, 70) for i in range(n)]
    items = spark.createDataFrame(rows, "item_id long, shingle long, n_shingles long")
    kept = {r["item_id"]: r["n"] for r in contamination.sketches(items, 0.8).groupBy("item_id").agg(F.count("*").alias("n")).collect()}
    for n in range(1, 70):
        missing = max(m for m in range(n + 1) if n - m >= 0.8 * n - 1e-9)
        assert kept[n] == n or kept[n] > missing


def test_awkward_rows(spark, awkward, no_documents):
    benchmark = spark.createDataFrame([(1, sentence(2, 120)), (2, sentence(4, 60)), (3, "")], "item_id long, text string")
    found = contamination.contaminated(awkward, benchmark)
    assert rows_of(found) == brute([(r["doc_id"], r["text"]) for r in awkward.collect()], [(1, sentence(2, 120)), (2, sentence(4, 60))])
    kept = contamination.decontaminate(awkward, benchmark)
    assert kept.columns == awkward.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(7) == 1 and ids.count(None) == 1 and not {1, 2, 12} & set(ids) and ids.count(6) == 2
    assert contamination.contaminated(no_documents, benchmark).count() == 0
    assert contamination.decontaminate(awkward, benchmark.limit(0)).count() == awkward.count()


def test_by_shuffles_and_against_the_sql(spark, shuffles):
    import duckdb
    import pandas as pd

    from townkit.llm.queries import OP7_SQL

    items = [(k, sentence(100 + k, 5 + k)) for k in range(12)] + [(20, "one two"), (21, "one"), (22, None)]
    docs = [(i, sentence(700 + i, 40) + " " + sentence(100 + i % 12, 5 + i % 12) + " One, two " * (i % 3)) for i in range(40)]
    documents, benchmark = pd.DataFrame(docs, columns=["doc_id", "text"]), pd.DataFrame(items, columns=["item_id", "text"])  # noqa: F841  (read by the SQL)
    expected = sorted(map(repr, (r[:4] for r in duckdb.sql(f"SELECT doc_id, item_id, shared, item_shingles FROM ({OP7_SQL})").fetchall())))
    found = contamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(found) == expected and len(expected) > 60
