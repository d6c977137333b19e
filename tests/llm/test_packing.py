import zlib
from collections import defaultdict

import numpy as np
import pytest

from townkit.llm import packing, tokens


def check(found, docs, capacity):
    tokenizer = tokens.tokenizer(tokens.vocabulary_path("byte_bpe_50k.json"))
    expected = []
    for r in docs.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        start = 0
        for k, length in enumerate(packing.cut_lengths(len(ids), capacity)):
            expected.append(repr((r["doc_id"], k, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()))))
            start += length
    assert sorted(repr((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in found) == sorted(expected)
    placed = defaultdict(list)
    for r in found:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(placed), sum(r["length"] for r in found)


@pytest.mark.parametrize("lot_size", [16_384, 40])
def test_placement(spark, lot_size):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = packing.pack(docs, lot_size=lot_size).collect()
    sequences, total = check(found, docs, 2048)
    assert sequences <= -(-total // 2048) + 2


@pytest.mark.parametrize(("lot_size", "more"), [(16_384, 1), (300, 4)])
def test_few_sequences(spark, lot_size, more):
    """Best fit over all pieces at once, longest first, is what lots are held against: here it leaves no room at all."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = packing.pack(docs, lot_size=lot_size).select("length", "sequence_id").collect()
    lengths = np.sort(np.array([r["length"] for r in found]))[::-1]
    whole = packing.best_fit(lengths, 2048)[0].max() + 1
    assert whole == -(-lengths.sum() // 2048) and len({r["sequence_id"] for r in found}) <= whole + more


def test_copies_are_spread_over_lots(spark):
    """Repeated rows and rows without an id are dealt to all lots."""
    docs = spark.createDataFrame([(None, "the same words in every row")] * 600, "doc_id long, text string").repartition(3)
    sizes = {r["lot"]: r["count"] for r in packing.pieces(docs, 64, "byte_bpe_50k.json", 0, 6).groupBy("lot").count().collect()}
    assert len(sizes) == 6 and max(sizes.values()) < 180
    check(packing.pack(docs, capacity=64, lot_size=100).collect(), docs, 64)


def test_awkward_rows(awkward, no_documents):
    check(packing.pack(awkward, capacity=64).collect(), awkward, 64)
    assert packing.pack(no_documents).count() == 0


@pytest.mark.parametrize("n", [1, 63, 64, 65, 128, 200])
def test_only_the_first_piece_is_shorter(n):
    lengths = packing.cut_lengths(n, 64)
    assert sum(lengths) == n and all(x == 64 for x in lengths[1:]) and 0 < lengths[0] <= 64


def test_rule_against_the_definition():
    """Each choice is one of those that leave the least sum of squares, counted anew."""
    r = np.random.Generator(np.random.PCG64(3))
    sizes = r.integers(1, 17, 300)
    bins, offsets = packing.sum_of_squares(sizes, 16)
    level: dict[int, int] = {}

    def total():
        gaps = [16 - v for v in level.values() if v < 16]
        return sum(c * c for c in np.bincount(gaps, minlength=17))

    for size, b, offset in zip(sizes.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        options = {}
        for other in [*level, max(level, default=-1) + 1]:
            held = level.get(other, 0)
            if held + size <= 16:
                level[other] = held + size
                options[other] = total()
                if held:
                    level[other] = held
                else:
                    del level[other]
        assert options[b] == min(options.values()) and level.get(b, 0) == offset
        level[b] = offset + size


def test_best_fit_against_the_definition():
    sizes = np.random.Generator(np.random.PCG64(5)).integers(1, 17, 200)
    level: dict[int, int] = {}
    for size, b, offset in zip(sizes.tolist(), *(x.tolist() for x in packing.best_fit(sizes, 16)), strict=True):
        fits = [v for v in level.values() if v + size <= 16]
        assert level.get(b, 0) == offset == max(fits, default=0)
        level[b] = offset + size


def test_perfect_fits_waste_nothing():
    sizes = np.sort(np.array([6, 10] * 50))[::-1]
    bins, _ = packing.sum_of_squares(sizes, 16)
    assert bins.max() + 1 == sizes.sum() // 16


def test_an_exact_fit_of_many_sizes():
    """190 mixed pieces that fill 80 bins exactly: the rule alone takes 86, the round over part-full bins 83."""
    sizes = np.sort(np.array([6, 10] * 50 + [4, 5, 7] * 30))[::-1]
    assert packing.sum_of_squares(sizes, 16)[0].max() + 1 == 86
    assert packing.again(sizes, 16)[0].max() + 1 <= 83
