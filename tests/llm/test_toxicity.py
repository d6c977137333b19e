import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from townkit.llm import toxicity

BAD = ["grumpo", "nastix", "vilefy"]


def texts(n, seed):
    r = random.Random(seed)
    common = [f"word{i}" for i in range(60)]
    out = []
    for i in range(n):
        words = r.choices(common, k=r.randint(10, 40))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(r.randint(0, len(words)), r.choice(BAD))
        out.append((i, " ".join(words), int(toxic)))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rows = texts(600, 1)
    docs = spark.createDataFrame([(i, t, "en", 9.0) for i, t, _ in rows], "doc_id long, text string, lang string, score double").repartition(3)
    return rows, docs, spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(tables):
    rows, docs, labels = tables
    truth = {i: y for i, _, y in rows}
    found = toxicity.toxicity(docs, labels).collect()
    assert len(found) == 600 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(r["nearest"] for r in held if truth[r["doc_id"]])


def test_labels_of_the_held_out_fold_are_not_read(spark, tables):
    rows, docs, labels = tables
    changed = spark.createDataFrame([(i, 1, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    score = lambda x: {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, x).collect()}
    assert score(labels) == score(changed)


def plain_scores(rows, labelled, settings):
    """The whole score by definition: exact cosines of all pairs, votes, isotonic calibration, without an index. Ids without repeats."""
    counts = {i: Counter(re.findall(r"[^\W_]+", (t or "").lower())) for i, t in rows}
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i, _ in labelled}
    usable = {i: y for i, y in labelled if fold[i] and i in counts}
    totals = Counter(y for i, y in labelled if fold[i])
    ids = sorted(usable)
    n1, n0 = sum(usable.values()), sum(1 - y for y in usable.values())
    class_weight = {y: totals[y] / max(1, (n0, n1)[y]) for y in (0, 1)}
    df = Counter(w for c in counts.values() for w in c)
    held = {y: Counter(w for i in ids if usable[i] == y for w in counts[i]) for y in (0, 1)}

    def weight(w):
        s1, s0 = n1 / (n1 + n0), n0 / (n1 + n0)
        a, b = held[1][w] + s1, held[0][w] + s0
        odds = math.log(a / (n1 + 2 * s1 - a)) - math.log(b / (n0 + 2 * s0 - b))
        return (math.log((1 + len(rows)) / (1 + df[w])) + 1) * odds**2 / (1 / a + 1 / b)

    weights = {w: weight(w) for i in ids for w in counts[i]}

    def vector(i):
        x = {w: (1 + math.log(n)) * weights[w] for w, n in counts[i].items() if w in weights}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {w: v / norm for w, v in x.items()} if norm else x

    vectors = {i: vector(i) for i in counts}
    strongest = {i: max(vectors[i].items(), key=lambda x: x[1])[0] if vectors[i] else "" for i in ids}
    prior = sum(class_weight[usable[i]] * usable[i] for i in ids) / sum(class_weight[usable[i]] for i in ids)

    def vote(i, leave=None):
        found = []
        for e in ids:
            cosine = sum(v * vectors[e].get(w, 0.0) for w, v in vectors[i].items())
            if cosine > 0 and e != leave:
                found.append((round(cosine, 12), cosine, e))
        found.sort(key=lambda x: -x[0])
        cut = found[settings.neighbours - 1][0] if len(found) >= settings.neighbours else 0
        tied = [f for f in found if f[0] == cut]
        if len(found) > settings.neighbours and len({usable[f[2]] for f in tied}) > 1 and sum(f[0] >= cut for f in found) > settings.neighbours:
            return None  # the cut goes through equal cosines of both labels
        found = found[: settings.neighbours]
        total = sum(class_weight[usable[e]] * c for _, c, e in found) + settings.pull
        return (sum(class_weight[usable[e]] * c * usable[e] for _, c, e in found) + settings.pull * prior) / total

    assert strongest
    votes = sorted((vote(i, i), usable[i]) for i in ids)
    # isotonic regression by its min-max formula, with the prior's one row in each step
    pools = []
    for v, y in votes:
        pools.append([v, class_weight[y], class_weight[y] * y])
        while len(pools) > 1 and (pools[-2][0] == pools[-1][0] or pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]):
            last = pools.pop()
            pools[-1][1] += last[1]
            pools[-1][2] += last[2]

    def score(v):
        below = [p for p in pools if p[0] <= v] or pools[:1]
        return min(1.0, max(0.0, 0.99 * (below[-1][2] + prior) / (below[-1][1] + 1) + 0.01 * v))

    return {i: None if (v := vote(i)) is None else score(v) for i in counts}


@pytest.mark.parametrize("block", [8, 512])
def test_scores_are_those_of_brute_force(spark, block):
    settings = toxicity.Settings(block=block, neighbours=7)
    rows = [(i, t) for i, t, _ in texts(240, 4)]
    r = random.Random(9)
    rows = [(i, t + " " + " ".join(f"rare{r.randint(0, 10**6)}" for _ in range(3))) for i, t in rows]  # no two cosines are equal
    labelled = [(i, int(any(b in t for b in BAD))) for i, t in rows if i % 6]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, spark.createDataFrame(labelled, "doc_id long, toxic int"), settings).collect()}
    expected = plain_scores(rows, labelled, settings)
    compared = [i for i in expected if expected[i] is not None]
    assert len(compared) > 230 and all(found[i] == pytest.approx(expected[i], abs=1e-9) for i in compared)


def test_nearest_is_exact(tables):
    _, docs, labels = tables
    index = toxicity.fit(docs, labels, toxicity.Settings(block=8, neighbours=5))
    whole = np.zeros((len(index.terms), index.blocks * 8))
    for t in range(len(index.terms)):
        for e in range(index.entry_of[t], index.entry_of[t + 1]):
            b = int(index.entry_block[e])
            if index.entry_row[e] >= 0:
                whole[t, b * 8 : b * 8 + 8] = index.rows[b][index.entry_row[e]]
            else:
                at = slice(index.posting_of[e], index.posting_of[e + 1])
                whole[t, b * 8 + index.member[at]] = index.posted[at]
            assert whole[t, b * 8 : b * 8 + 8].max() == index.entry_most[e]
    assert np.allclose((whole**2).sum(0)[: len(index.example_ids)], 1)
    r = random.Random(2)
    for _ in range(200):
        counts = dict(sorted(Counter(r.choices(range(len(index.terms)), k=r.randint(1, 6))).items()))
        query = np.array(list(counts)), np.array(list(counts.values()), float)
        places, cosines = index.nearest(*query)
        t, w = index.vector(*query)
        all_cosines = w @ whole[t]
        expected = np.lexsort((np.arange(whole.shape[1]), -np.round(all_cosines, 12)))
        expected = expected[all_cosines[expected] > 0][:5]
        assert places.tolist() == expected.tolist() and np.allclose(cosines, all_cosines[expected])


def test_every_word_of_the_examples_is_a_term(tables):
    rows, docs, labels = tables
    index = toxicity.fit(docs, labels)
    assert index.terms.tolist() == sorted(toxicity.word_hashes({w for i, t, _ in rows if i in set(index.example_ids.tolist()) for w in t.split()}).tolist())
    assert len(index.example_ids) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, *_ in rows)
    fewer = toxicity.fit(docs, labels, toxicity.Settings(postings=500))
    assert 10 < len(fewer.example_ids) < 60 and fewer.class_weight.min() > 1


def test_pipeline_form_keeps_columns_and_clean_rows(tables):
    rows, docs, labels = tables
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    gone = {i for i, *_ in rows} - {r["doc_id"] for r in kept.collect()}
    assert gone <= {i for i, _, y in rows if y} and len(gone) > 130


def test_awkward_rows(spark, awkward, no_documents):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None), (4, 0), (7, 1), (99, 1)], "doc_id long, toxic int")
    found = toxicity.toxicity(awkward, labels).collect()
    assert len(found) == awkward.count() and all(0 <= r["score"] <= 1 for r in found) and not any(r["held_out"] for r in found if r["doc_id"] is None)
    gone = sum(r["predicted"] for r in found)
    kept = toxicity.without_toxic(awkward, labels)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - gone
    assert toxicity.without_toxic(no_documents, labels).count() == 0
    assert toxicity.toxicity(no_documents, labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity(awkward, labels.limit(0)).collect()} == {0.0}


def test_blocks_are_not_looked_at_one_by_one(tables, monkeypatch):
    """However many blocks there are, the postings of a text are gathered twice at most, beside its entries."""
    _, docs, labels = tables
    index = toxicity.fit(docs, labels, toxicity.Settings(block=8, neighbours=5))
    assert index.blocks > 10
    calls, plain = [], toxicity.spans
    monkeypatch.setattr(toxicity, "spans", lambda *a: calls.append(1) or plain(*a))
    index.nearest(np.arange(len(index.terms)), np.ones(len(index.terms)))
    assert len(calls) <= 3
