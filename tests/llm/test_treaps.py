import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from townkit.llm import queries, treaps

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=50):
    """(item_id, rank, doc_id, score) by scoring every document."""
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_docs, total, df = len(held), sum(n for *_, n in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, counts, n in held:
            m = 50 + 50 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 20 * m)) for t in set(terms(text)) if t in counts)
            if s > 0:
                scored.append((-s, doc is None, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, doc) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(map(repr, out))


def rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_trees_are_treaps():
    r = np.random.default_rng(3)
    doc, term = np.unique(np.stack([r.integers(0, 300, 4000), r.integers(0, 25, 4000)]), axis=1)
    impact = r.integers(1, 6, len(doc))  # many ties
    t = treaps.build(doc, term, impact, 300, 27)
    seen = 0

    def check(node, low, high, most):
        if node == t.none:
            return 0
        assert low <= t.doc[node] <= high and t.impact[node] <= most
        return 1 + check(t.left[node], low, t.doc[node] - 1, t.impact[node]) + check(t.right[node], t.doc[node] + 1, high, t.impact[node])

    for root in t.root:
        seen += check(root, 0, 299, 10)
    assert seen == len(doc) and (t.root[25:] == t.none).all()


def test_walk_leaves_documents_out_and_loses_none():
    """The best of all, with far fewer documents scored than there are."""
    r = np.random.default_rng(5)
    n = 20_000
    doc, term = np.unique(np.stack([r.integers(0, n, 90_000), r.integers(0, 12, 90_000)]), axis=1)
    impact = (r.pareto(2.0, len(doc)) * 1000).astype(np.int64) + 1
    t = treaps.build(doc, term, impact, n, 12)
    best = treaps.Best(50)
    scored = treaps.walk(t, np.arange(9), np.arange(n), np.zeros(n, bool), best)
    total = np.bincount(doc[term < 9], impact[term < 9], n).astype(np.int64)
    order = np.lexsort((np.arange(n), -total))[:50]
    assert best.score.tolist() == total[order].tolist() and best.doc_id.tolist() == order.tolist() and scored < n / 5


@pytest.mark.parametrize("shard", [1_500_000, 40])
def test_awkward_rows(spark, awkward, no_documents, shard, monkeypatch):
    monkeypatch.setattr(treaps, "SHARD_POSTINGS", shard)
    asked = [(1, "The museum2 river7, ONE two"), (1, "three é"), (2, None), (None, "中文 x one"), (3, "nowhere at-all"), (4, "green5 " * 3000 + "story1")]
    items = spark.createDataFrame([(*a, "d", 9) for a in asked], "item_id long, text string, doc_id string, score int")
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert rows(treaps.ranked_search(awkward, items, k=5)) == brute(docs, asked, 5)
    assert treaps.ranked_search(no_documents, items).count() == 0 and treaps.ranked_search(awkward, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_blocks_of_items_are_searched_alike(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    expected = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], 7)
    monkeypatch.setattr(treaps, "BLOCK_TERMS", 500)
    monkeypatch.setattr(treaps, "BLOCK_ITEMS", 15)
    assert rows(treaps.ranked_search(docs, items, k=7)) == expected


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    found = queries.QUERIES["op11_ranked_search"](spark, sf).select("item_id", "rank", "doc_id", "score")
    assert rows(found) == sorted(map(repr, con.execute(queries.ORACLE_SQL["op11_ranked_search"]).fetchall()))
