import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from townkit.llm import suffixes


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"banana", bytes(range(256))])
def test_suffix_order(alphabet):
    r = random.Random(4)
    for _ in range(60):
        parts = [bytes(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(r.randint(1, 8))]
        sizes = np.array([len(p) for p in parts])
        ends = np.cumsum(sizes)
        data, end_of = b"".join(parts), np.repeat(ends, sizes)
        order = suffixes.suffix_order(data, ends - sizes, ends, np.arange(len(data)), 1000)
        assert [data[p : end_of[p]] for p in order] == sorted(data[p : end_of[p]] for p in range(len(data)))


def test_only_wanted_places_and_their_prefixes():
    r = random.Random(9)
    for depth in (2, 5, 30):
        parts = list({bytes(r.choice(b"abc") for _ in range(r.randint(depth, 90))) for _ in range(12)})
        counts = Counter(p[i : i + depth] for p in parts for i in range(len(p) - depth + 1))
        for part, flags in zip(parts, suffixes.repeated_starts(parts, depth), strict=True):
            assert flags.tolist() == [counts[part[i : i + depth]] > 1 for i in range(len(part) - depth + 1)]


def test_equal_strings_have_equal_anchors():
    settings = suffixes.Repeats(length=50, gram=12)
    r = random.Random(2)
    shared = bytes(r.choice(b"abcdefgh") for _ in range(50))
    found = set()
    for _ in range(20):
        before = bytes(r.choice(b"abcdefgh") for _ in range(r.randint(0, 80)))
        data = before + shared + bytes(r.choice(b"abcdefgh") for _ in range(r.randint(0, 80)))
        ((key, place, lo, hi),) = suffixes.anchors(data, settings)
        k = next(k for k in range(len(key)) if lo[k] <= len(before) <= hi[k])
        found.add((int(key[k]), int(place[k]) - len(before)))
    assert len(found) == 1


def test_windows_of_a_long_text():
    """Every start of a string belongs to one anchor, and to the same one whatever the window."""
    r = random.Random(4)
    data = bytes(r.choice(b"ab") for _ in range(700)) * 2

    def of_start(window):
        out = {}
        for key, place, lo, hi in suffixes.anchors(data, suffixes.Repeats(length=50, gram=12, window=window)):
            for k, p, a, b in zip(key.tolist(), place.tolist(), lo.tolist(), hi.tolist(), strict=True):
                for start in range(a, b + 1):
                    assert start not in out and start <= p <= start + 38
                    out[start] = (k, p)
        return out

    whole = of_start(1 << 20)
    assert sorted(whole) == list(range(len(data) - 49)) and all(of_start(w) == whole for w in (1, 97, 700))


def brute(texts, n):
    counts = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if counts[t[i : i + n]] > 1:
                gone[i : i + n] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("hot", "window"), [(4096, 1 << 20), (3, 1 << 20), (4096, 90)])
def test_against_brute_force(spark, hot, window):
    """With hot at 3, groups are split by where strings start, down to single strings; with small windows segments are cut."""
    compare(spark, hot, window)


def test_by_shuffles(spark, shuffles):
    compare(spark, 3, 1 << 20)


def compare(spark, hot, window):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdéfg ") for _ in range(r.randint(20, 160)))
    passage, other = word() + "x" * 70, word() + word()
    texts = [word() + passage + word() for _ in range(14)] + [word() + other + word() + other for _ in range(3)] + [other, other, "", "ab" * 100, word()]
    settings = suffixes.Repeats(length=60, gram=16, hot=hot, steps=(8, 1), batch=3000, window=window)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    found = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffixes.remove_repeats(df, settings).collect()}
    assert found == dict(enumerate(brute([t.encode() for t in texts], 60)))


def test_passages_of_the_query_s_length(spark):
    """400 bytes that two documents share go, 399 stay, whatever the number of words; n_bytes is the whole text's length in either case."""
    r = random.Random(12)
    words = lambda n: " ".join("".join(r.choice("abcdefghé") for _ in range(r.randint(3, 8))) for _ in range(n)).encode()

    def passage(n):
        text = words(80).decode().replace("é", "e").encode()[:n]
        assert len(text) == n and len(text.split()) > 50
        return text

    shared, short = passage(400), passage(399)
    texts = [words(60) + b"<" + shared + b">" + words(20), words(30) + b"(" + shared + b")", words(60) + b"<" + short + b">" + words(20), words(30) + b"(" + short + b")", words(90)]
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffixes.remove_repeats(df).collect()}
    assert found == dict(enumerate(brute(texts, 400)))
    assert [found[i][1] for i in range(5)] == [400, 400, 0, 0, 0] and all(found[i][0] == len(t) > len(t.decode()) for i, t in enumerate(texts))


def test_awkward_rows(awkward, no_documents):
    found = suffixes.remove_repeats(awkward).collect()
    assert len(found) == awkward.count()
    by = {}
    for x in found:
        by.setdefault(x["doc_id"], []).append(x)
    empty = hashlib.sha256(b"").hexdigest()
    assert [x["n_removed"] == x["n_bytes"] > 0 for x in by[6]] == [True, True] and by[1][0]["kept_sha256"] == empty
    assert (by[3][0]["n_bytes"], by[3][0]["n_spans"], by[3][0]["kept_sha256"]) == (0, 0, empty)
    assert sorted(x["n_removed"] > 0 for x in by[None]) == [False, True]
    assert suffixes.remove_repeats(no_documents).count() == 0
