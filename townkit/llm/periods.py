"""Periodic runs of words: stretches that repeat themselves at a fixed distance, found whole and exactly.

Blocks of 2, 4, 8, ... words that begin at multiples of their length are the keys of an Aho-Corasick automaton over word numbers. Each
block length has its range of periods, chosen so that every run of such a period holds an aligned block that stands again one period
further on. The document is searched for all keys at once; an occurrence at a distance of the range seeds an exact extension to both sides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townkit.llm.shared import batch_of, id_and_text

WORD = re.compile("[^ \t-\r]+")
#: A run has at least so many words, and at least twice its period.
SHORTEST = 12
#: Words of a block that are its key: of a longer block the first ones. An automaton that meets a key at every place of a text looks through all
#: its words there, so that keys as long as the blocks would make a text of one word a square of work. The extension compares all words.
KEY = 64
#: Words that one step of an extension compares at most.
STRIDE = 65_536
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_dropped", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])
FOUND_SQL = "doc_id long, n_words long, n_dropped long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def scales(n: int) -> Iterator[tuple[int, int, int]]:
    """(block length, least and greatest period) for texts of n words.

    In a run of period q at least max(q, SHORTEST - q) neighbouring words stand again q words on, and 2 * B - 1 of them hold an aligned
    block of B. Blocks of 4 serve the periods up to 14 but for 6, whose 6 words are too few for them; blocks of 2 serve that.
    """
    yield 4, 1, 14
    yield 2, 6, 6
    block = 8
    while 2 * (2 * block - 1) <= n:
        yield block, 2 * block - 1, 4 * block - 2
        block *= 2


def next_gaps(ids: np.ndarray) -> np.ndarray:
    """How far on the same word stands next; the number of words where it stands nowhere."""
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    gaps = np.full(len(ids), len(ids), np.int64)
    gaps[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return gaps


def equal_after(ids: np.ndarray, sequence: tuple, i: int, j: int) -> int:
    """How many words from i on equal those from j on; i < j. Most stretches end soon: the first words are compared one by one."""
    n, step, count = len(ids), 16, 0
    while count < step and j + count < n:
        if sequence[i + count] != sequence[j + count]:
            return count
        count += 1
    while j + count < n:
        m = min(step, n - j - count)
        equal = ids[i + count : i + count + m] == ids[j + count : j + count + m]
        if not equal.all():
            return count + int(equal.argmin())
        count, step = count + m, min(2 * step, STRIDE)
    return count


def equal_before(ids: np.ndarray, sequence: tuple, i: int, j: int) -> int:
    """How many words before i equal those before j; i < j."""
    step, count = 16, 0
    while count < step and i > count:
        if sequence[i - count - 1] != sequence[j - count - 1]:
            return count
        count += 1
    while i > count:
        m = min(step, i - count)
        equal = ids[i - count - m : i - count] == ids[j - count - m : j - count]
        if not equal.all():
            return count + int(equal[::-1].argmin())
        count, step = count + m, min(2 * step, STRIDE)
    return count


def is_smallest(ids: np.ndarray, start: int, period: int) -> bool:
    """Whether the stretch from start, of at least two periods, has no smaller period. A smaller one would divide it."""
    rest, prime = period, 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime == 0:
            g = period // prime
            if np.array_equal(ids[start : start + period - g], ids[start + g : start + period]):
                return False
            while rest % prime == 0:
                rest //= prime
        prime += 1
    return True


def seeds(ids: np.ndarray, sequence: tuple, gaps: np.ndarray, block: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of aligned blocks that stand again at a distance of low to high."""
    import ahocorasick

    m = len(ids) // block
    # a block stands again at such a distance only if each of its words does, at that distance or before
    starts = np.flatnonzero((gaps[: m * block] <= high).reshape(m, block).all(axis=1)) * block
    nothing = np.empty(0, np.int64)
    if not len(starts):
        return nothing, nothing
    places: dict[tuple, list[int]] = {}
    key_length = min(block, KEY)
    for p in starts.tolist():
        places.setdefault(sequence[p : p + key_length], []).append(p)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, at in places.items():
        automaton.add_word(key, (at, []))
    automaton.make_automaton()
    met = []
    for end, value in automaton.iter(sequence):
        if not value[1]:
            met.append(value)
        value[1].append(end - key_length + 1)
    out_p, out_d = [nothing], [nothing]
    for at, seen in met:
        if len(seen) < 2:
            continue
        at, seen = np.array(at), np.array(seen)
        first, last = np.searchsorted(seen, at + low), np.searchsorted(seen, at + high, "right")
        n = last - first
        p = np.repeat(at, n)
        which = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        out_p.append(p)
        out_d.append(seen[which] - p)
    return np.concatenate(out_p), np.concatenate(out_d)


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the word numbers, by start, then period."""
    n = len(ids)
    if n < SHORTEST:
        return []
    gaps, sequence, found = next_gaps(ids), tuple(ids.tolist()), set()
    # of each word the end and the period of a run around it: inside a run, its period's multiples lead to nothing new
    until, period_at = np.zeros(n, np.int64), np.ones(n, np.int64)
    for block, low, high in scales(n):
        p, d = seeds(ids, sequence, gaps, block, low, high)
        met = min(block, KEY)
        fresh = (until[p] < p + d + met) | (d % period_at[p] != 0)
        order = np.lexsort((p[fresh], d[fresh]))
        distance, end = 0, 0
        for at, q in zip(p[fresh][order].tolist(), d[fresh][order].tolist(), strict=True):
            if q == distance and at + q + met <= end:
                continue  # in the stretch that was extended last
            start = at - equal_before(ids, sequence, at, at + q)
            distance, end = q, at + q + met + equal_after(ids, sequence, at + met, at + met + q)
            if end - start >= max(SHORTEST, 2 * q) and (start, end - start, q) not in found and is_smallest(ids, start, q):
                found.add((start, end - start, q))
                longer = until[start:end] < end
                until[start:end][longer], period_at[start:end][longer] = end, q
    return sorted((s, length, q) for s, length, q in found)


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.cumsum(change[:-1]) == 0
    return [w for w, k in zip(words, kept.tolist(), strict=True) if k]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_dropped, runs (start, length, period; by start, then period), collapsed: a row for each row of docs.

    Words are what stands between ASCII white space; a run is a stretch of at least 12 words and two periods that no neighbouring word
    prolongs, with its smallest period. `collapsed` joins by one space the words that no run holds after its first period.

    Null and empty texts have no words and collapse to an empty text; rows of one id (null too) are looked at one by one; further columns
    are left out; an empty table gives an empty result. Texts are taken whole: a task holds one text's words at a time and, for one block
    length after the other, an automaton of at most as many nodes as words. Nothing is shuffled.
    """

    def find(batches):
        for batch in batches:
            out = [[] for _ in FOUND]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, numbers = WORD.findall(text), {}
                ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
                runs = runs_of(ids)
                kept = collapsed(words, runs)
                row = (doc_id, len(words), len(words) - len(kept), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], " ".join(kept))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield batch_of(FOUND, out)

    return id_and_text(docs).mapInArrow(find, FOUND_SQL)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """docs with the text of about a tenth of the ids made periodic from some word on, by the checksum of the id; a null id stays."""
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    planted = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g"))
    planted = planted.select("doc_id", "text", "w", "g", F.when(F.size("w") > 0, F.col("g") % F.size("w")).cast("int").alias("a"))
    planted = planted.withColumn("p", (F.floor((F.size("w") - F.col("a")) / (F.col("g") % 8 + 3)) + 1).cast("int"))
    tail = F.transform(F.expr("sequence(a, size(w) - 1)"), lambda i: F.get("w", F.col("a") + (i - F.col("a")) % F.col("p")))
    text = F.when(F.col("a").isNull(), F.col("text")).otherwise(F.array_join(F.concat(F.slice("w", 1, F.col("a")), tail), " "))
    return planted.select("doc_id", text.alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """The longest run of each document (ties: least start, then period) and digests of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))

    def line(r: Column) -> Column:
        return F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))

    best = found.withColumn("best", longest)
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.length div -best.p").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
        "n_dropped",
    )
