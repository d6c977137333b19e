"""Best-fit packing of documents into fixed-length token sequences by the sum-of-squares rule."""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townkit.llm.shared import batch_of, id_and_text, written
from townkit.llm.tokens import chunk_ids

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("lot", pa.int64())])
PIECES_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, lot long"
PLACED = pa.schema([*[PIECES.field(i) for i in range(5)], ("sequence_id", pa.int64()), ("offset", pa.int64())])
OPEN = PLACED.append(pa.field("open", pa.bool_()))
PLACED_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Pieces that one packing task takes; what lots leave part full is packed again together.
LOT = 16_384


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Piece lengths of a document of n tokens: whole capacities, and before them the rest."""
    rest = n % capacity
    return [rest] * (rest > 0) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, capacity: int, vocabulary: str, end_id: int, lots: int) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32, and the lot that packs it."""

    def cut(batches):
        from pyspark import TaskContext

        encoder, end, part, row = chunk_ids(vocabulary), int(end_id).to_bytes(4, "little"), TaskContext.get().partitionId(), 0
        for batch in batches:
            out = [[] for _ in PIECES]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                start = 0
                for k, length in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    # dealt by the row's place in its task: copies, repeated rows and rows without an id are spread over all lots
                    lot, row = zlib.crc32(f"{part}:{row}".encode()) % lots, row + 1
                    for column, value in zip(out, (doc_id, k, start, length, crc, lot), strict=True):
                        column.append(value)
                    start += length
            yield batch_of(PIECES, out)

    return id_and_text(docs).mapInArrow(cut, PIECES_SQL)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, in the given order.

    A piece of size s goes into an open bin whose gap g makes the sum of the squared counts of open bins by gap least: the change
    is 2 * (count[g - s] - count[g] + 1), and for a new bin 2 * count[capacity - s] + 1. Closed (full) bins do not count, so that
    filling a bin exactly changes the sum by 1 - 2 * count[g]. Of equal changes the smallest gap wins.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, n_bins = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        gap, change = capacity, 2 * count[capacity - size] + 1 if size < capacity else 0
        if size < capacity:
            held, after = count[size:capacity], count[: capacity - size]
            changes = 2 * (after - held) + 2
            changes[0] = 1 - 2 * held[0]
            changes[held == 0] = np.iinfo(np.int64).max
            best = int(changes.argmin())
            if changes[best] <= change:
                gap = size + best
        if gap == capacity:
            b, n_bins = n_bins, n_bins + 1
        else:
            b = open_bins[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > size:
            open_bins[gap - size].append(b)
            count[gap - size] += 1
    return bins, offsets


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, in the given order: the fullest bin that still holds it."""
    gaps, bins, offsets, n_bins = [], np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        at = bisect_left(gaps, (size, -1))
        gap, b = gaps.pop(at) if at < len(gaps) else (capacity, n_bins)
        n_bins = max(n_bins, b + 1)
        bins[i], offsets[i] = b, capacity - gap
        if gap > size:
            insort(gaps, (gap - size, b))
    return bins, offsets


def again(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) by the rule, or by best fit where that leaves fewer bins."""
    by_rule, by_fit = sum_of_squares(lengths, capacity), best_fit(lengths, capacity)
    return by_fit if len(lengths) and by_fit[0].max() < by_rule[0].max() else by_rule


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, lot_size: int = LOT) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; sequences have at most `capacity` tokens.

    Null and empty texts are documents of one token (end_id). Only documents of more than `capacity` tokens are cut. Rows with equal
    or null ids are packed one by one like others; further columns are left out; an empty table gives an empty result.

    Texts are encoded where they are read. Only lengths are shuffled, to lots of about lot_size pieces by their row; the number of lots
    follows the number of pieces. In a lot the longest pieces come first (ties: checksum, doc_id), which makes the sum-of-squares rule
    an offline one. The pieces of sequences that a lot leaves part full are packed again, in ever fewer lots, until one lot holds them
    all or another round would not lessen them.
    """
    lots = max(1, math.ceil(docs.count() / lot_size))
    # written once: the lots' tasks must not encode the texts again after a lost executor
    cut = written(pieces(docs, capacity, vocabulary, end_id, lots), "pieces")
    done, round_ = None, 0
    while True:
        dealt = cut.repartition(lots, "lot").sortWithinPartitions("lot", F.col("length").desc(), "ids_crc32", "doc_id", "piece")
        placed = written(dealt.mapInArrow(place_lots(capacity, round_), f"{PLACED_SQL}, open boolean"), "placed")
        n_open = placed.where("open").count()
        fewer = math.ceil(n_open / lot_size)
        last = not n_open or (round_ and fewer >= lots) or round_ > 9
        full = placed.where("true" if last else "NOT open").drop("open")
        done = full if done is None else done.union(full)
        if last:
            return done
        lots, round_ = fewer, round_ + 1
        cut = placed.where("open").select(*PIECES.names[:5], F.pmod(F.xxhash64("sequence_id"), F.lit(lots)).alias("lot"))


def place_lots(capacity: int, round_: int):
    """Packs each lot; `open` tells pieces of sequences that are not full. Later rounds also try best fit."""

    def place(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            # a lot's rows stand together; one partition can hold several lots
            lots_here = batch.column(5).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(lots_here)) + 1).tolist(), len(lots_here)] if len(lots_here) else [0]
            for a, b in zip(edges, edges[1:], strict=False):
                part = batch.slice(a, b - a)
                if held and held[0].column(5)[0] != part.column(5)[0]:
                    yield placed(held)
                    held = []
                held.append(part)
        if held:
            yield placed(held)

    def placed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        lengths = table.column("length").to_numpy()
        bins, offsets = again(lengths, capacity) if round_ else sum_of_squares(lengths, capacity)
        filled = np.bincount(bins, lengths)
        ids = bins + (table.column("lot")[0].as_py() << 28) + (round_ << 59)
        return batch_of(OPEN, [*(table.column(i).combine_chunks() for i in range(5)), ids, offsets, filled[bins] < capacity])

    return place
