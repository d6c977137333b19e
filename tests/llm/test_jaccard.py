import random
import re

import numpy as np
import pytest

from townkit.llm import jaccard

from .conftest import sentence


def sets_of(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, threshold=0.8):
    sets = [sets_of(t) for _, t in rows]
    n = len(rows)
    links = [[j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append(repr((rows[i][0], min(ids) if ids else None, len(links[i]))))
    return sorted(out)


def rows_of(df):
    return sorted(repr((r["doc_id"], r["class_id"], r["n_links"])) for r in df.collect())


@pytest.fixture(scope="module")
def near_copies():
    r = random.Random(7)
    rows = []
    for g in range(12):
        base = sentence(g, r.randint(40, 200)).split()
        for _ in range(25 if g == 0 else r.randint(1, 5)):
            words = list(base)
            for _ in range(r.randint(0, 6)):
                words[r.randrange(len(words))] = f"edit{r.randint(0, 9999)}"
            rows.append((len(rows), " ".join(words)))
    shared = sentence(999, 30)
    rows += [(len(rows) + i, sentence(2000 + i, 150) + " " + shared) for i in range(40)]
    rows += [(len(rows) + i, rows[0][1]) for i in range(10)]
    return rows


@pytest.mark.parametrize("change", [{}, {"small": 3, "block_sets": 4}, {"block_shingles": 200, "small": 8}])
def test_against_brute_force(spark, near_copies, change):
    """Small buckets and blocks send the same rows through splits and through cells of two blocks."""
    df = spark.createDataFrame(near_copies, "doc_id long, text string").repartition(4)
    assert rows_of(jaccard.jaccard_classes(df, jaccard.Join(**change))) == brute(near_copies)


def test_by_shuffles(spark, shuffles, near_copies):
    df = spark.createDataFrame(near_copies, "doc_id long, text string").repartition(4)
    assert rows_of(jaccard.jaccard_classes(df, jaccard.Join(small=8, block_sets=4))) == brute(near_copies)


def test_awkward_rows(awkward, no_documents):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert rows_of(jaccard.jaccard_classes(awkward)) == brute(rows)
    assert jaccard.jaccard_classes(no_documents).count() == 0


def test_one_of_each_stays(spark, awkward, no_documents):
    kept = jaccard.keep_one(awkward)
    rows = kept.collect()
    ids = [r["doc_id"] for r in rows]
    assert kept.columns == awkward.columns
    # both texts of id 7 stay, of the repeated row 6 one does, and the copy without an id goes; a null text stays
    assert sorted(ids, key=str) == sorted([1, 3, 4, 5, 6, 7, 7, 8, 10, 11, None], key=str) and [r["text"] for r in rows if r["doc_id"] is None] == [None]
    assert jaccard.keep_one(no_documents).count() == 0
    copies = spark.createDataFrame([(None, sentence(1, 30)), (None, sentence(1, 30)), (5, sentence(2, 30)), (5, sentence(2, 30)), (5, sentence(3, 30)), (4, sentence(3, 30))], "doc_id long, text string")
    assert sorted(map(repr, map(tuple, jaccard.keep_one(copies).collect()))) == sorted(map(repr, [(None, sentence(1, 30)), (5, sentence(2, 30)), (4, sentence(3, 30))]))


def test_runs_reach_the_recall():
    assert jaccard.Join().runs == 10 and jaccard.Join(recall=0.7).runs == 1 and jaccard.Join(recall=0.9).runs == 2


def test_minhash_estimates():
    r = np.random.Generator(np.random.PCG64(0))
    a = np.unique(r.integers(0, 2**63, 1000).astype(np.uint64))
    b = np.concatenate([a[:800], np.unique(r.integers(0, 2**63, 200).astype(np.uint64))])
    agree = (jaccard.minhash(a, 2048) == jaccard.minhash(b, 2048)).mean()
    assert abs(agree - 800 / 1200) < 0.05


def test_overlaps():
    r = random.Random(1)
    sets = [np.unique(np.array(r.choices(range(60), k=r.randint(1, 30)), np.uint64)) for _ in range(20)]
    expected = [[len({*a.tolist()} & {*b.tolist()}) for b in sets] for a in sets]
    assert jaccard.overlaps(sets, None).astype(int).tolist() == expected
    assert jaccard.overlaps(sets[:8], sets[8:]).astype(int).tolist() == [row[8:] for row in expected[:8]]


def test_components_of_long_chains(spark, shuffles):
    from townkit.llm.shared import components

    r = random.Random(3)
    names = list(range(200))
    r.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(120)] + [(names[i], names[i + 1]) for i in range(130, 199)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7)]
    found = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for part in (names[:121], names[130:], range(1000, 1100)):
        assert {found[i] for i in part} == {min(part)}


def test_pairs_at_the_threshold(spark):
    """4k shared shingles of 5k are 0.8 exactly, and one more of another size is below; the SQL decides."""
    import duckdb
    import pandas as pd

    from townkit.llm.queries import OP9_SQL

    rows = []
    for k in range(1, 81):
        words = [f"p{k}w{i}" for i in range(5 * k + 5)]
        rows += [(len(rows) + i, " ".join(words[:n])) for i, n in enumerate((4 * k + 4, 5 * k + 4))]
        words = [f"q{k}w{i}" for i in range(5 * k + 5)]
        rows += [(len(rows) + i, " ".join(words[:n])) for i, n in enumerate((4 * k + 4, 5 * k + 5))]
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841  (read by the SQL)
    expected = sorted(map(repr, duckdb.sql(OP9_SQL).fetchall()))
    assert sum(", 1)" in x for x in expected) == 160
    assert rows_of(jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))) == expected


def test_reaching_is_exact_at_every_size():
    k = np.arange(1, 2_000_000, 97)
    for below in (0, 1):
        found = jaccard.reaching((4 * k - below).astype(np.float32)[:, None], 9 * k, np.zeros(1), 0.8)
        assert (found == (below == 0)).all()
