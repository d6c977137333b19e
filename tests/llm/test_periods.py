import hashlib
import random
import zlib

import numpy as np
import pytest

from townkit.llm import periods, queries


def brute(words):
    """Every maximal stretch of every period, and of those the ones without a smaller period."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(12, 2 * q) and not any(all(words[i + k] == words[i + k + r] for k in range(length - r)) for r in range(1, q)):
                found.append((i, length, q))
            i = j
    return sorted(found)


@pytest.mark.parametrize("key", [64, 3])
@pytest.mark.parametrize("seed", range(60))
def test_runs_of_random_words(seed, key, monkeypatch):
    monkeypatch.setattr(periods, "KEY", key)
    r = random.Random(seed)
    words = [r.randrange(2 + seed % 4) for _ in range(r.randrange(5, 120))]
    for _ in range(r.randrange(4)):  # repeats of all lengths, some of them cut or broken
        a, p, k = r.randrange(len(words)), r.randrange(1, 40), r.randrange(2, 6)
        words[a:a] = ([r.randrange(50) for _ in range(p)] * k)[: p * k - r.randrange(p)]
    assert periods.runs_of(np.array(words)) == brute(words)


@pytest.mark.parametrize("seed", range(4))
def test_long_periods(seed):
    """Runs of long periods among repeats that are none, and runs within their periods."""
    r = random.Random(seed)
    words = [r.randrange(40) for _ in range(300)]
    for period in (150, 333, 260):
        root = [r.randrange(3) if k % 90 > 70 else 7 if k % 90 > 40 else r.randrange(60) for k in range(period)]
        words += (root * 4)[: 2 * period + r.randrange(-1, period)] + [r.randrange(5000) for _ in range(r.randrange(90))] + root[: r.randrange(20, period)]
    assert periods.runs_of(np.array(words)) == brute(words)


@pytest.mark.parametrize("period", [*range(1, 40), 61, 62, 63, 126, 127, 200])
@pytest.mark.parametrize("more", [0, 1])
def test_least_runs(period, more):
    """The shortest run of each period, at each alignment of the smaller ones, is found; one word less is none."""
    length = max(12, 2 * period)
    for shift in range(0, 17 if period < 40 else 3):
        words = [*range(1000, 1000 + shift), *(i % period for i in range(length - 1 + more)), *range(5000, 5003)]
        assert periods.runs_of(np.array(words)) == ([(shift, length, period)] if more else [])


def test_long_texts_stay_cheap():
    assert periods.runs_of(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    assert periods.runs_of(np.arange(300_000)) == []
    once = np.arange(100_000)
    assert periods.runs_of(np.concatenate([once, once])) == [(0, 200_000, 100_000)]


def planted(doc_id, text):
    words, h = periods.WORD.findall(text or ""), zlib.crc32(str(doc_id).encode())
    n, g = len(words), zlib.crc32(str(doc_id).encode()) // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = planted(doc_id, text)
    numbers = {}
    runs = brute([numbers.setdefault(w, len(numbers)) for w in words]) if len(words) < 700 else periods.runs_of(np.array([numbers.setdefault(w, len(numbers)) for w in words]))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    digest = hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
    kept = hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), digest, kept)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = sorted(tuple(r)[:8] for r in queries.QUERIES["op13_periodic_runs"](spark, sf).collect())
    assert found == sorted(expected(r["doc_id"], r["text"]) for r in docs.collect()) and any(r[1] for r in found)


def test_awkward_rows(spark, awkward, no_documents):
    found = periods.run_digests(periods.periodic_runs(periods.with_planted_runs(awkward))).collect()
    assert sorted(repr(tuple(r)[:8]) for r in found) == sorted(repr(expected(r["doc_id"], r["text"])) for r in awkward.collect())
    assert periods.run_digests(periods.periodic_runs(periods.with_planted_runs(no_documents))).count() == 0
    text = "start " + "a b c " * 5 + "end"
    row = periods.periodic_runs(spark.createDataFrame([(1, text, "x")], "doc_id long, text string, runs string")).collect()[0]
    assert [tuple(r) for r in row["runs"]] == [(1, 15, 3)] and row["collapsed"] == "start a b c end" and row["n_dropped"] == 12
