"""Suffix-array deduplication: removes every byte covered by a string of 400 bytes that also starts elsewhere in the corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townkit.llm.jaccard import groups_of
from townkit.llm.shared import batch_of, id_and_text, sized, written


@dataclass(frozen=True)
class Repeats:
    """length: of the repeated strings; gram: bytes of an anchor; hot: distinct segments of a group beyond which the group is split;
    steps: string starts that a segment of a split group holds, by round; batch: bytes in one suffix array; window: bytes of a text whose
    anchors are found at a time, 2^24 at most."""

    length: int = 400
    gram: int = 96
    hot: int = 4_096
    steps: tuple[int, ...] = (24, 1)
    batch: int = 2_000_000
    window: int = 1 << 20


#: Bits of a place in a window.
PLACES = np.uint64(24)


@lru_cache(1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(int(base), -1, 2**64))
    out = []
    for factor in (base, inverse):
        p = np.full(n, factor)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each run of `gram` bytes."""
    up, down = powers(1 << max(16, len(data).bit_length()))  # kept for the longest window
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[: len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * up[: len(data) - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def anchors(data: bytes, settings: Repeats) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash, place, first start, last start) of each anchor, by windows: every string of `length` bytes belongs to the least gram in it.

    Equal strings have the same anchor at the same place in them, as the choice depends on their bytes alone: 40 bits of the grams'
    hashes, of equal ones the leftmost. Windows bound the memory for a very long text. A segment that goes on over a window's end is
    two segments of one anchor, whose strings start at different places.
    """
    for begin in range(0, len(data) - settings.length + 1, settings.window):
        part = np.frombuffer(data, np.uint8)[begin : begin + settings.window + settings.length - 1]
        h = gram_hashes(part, settings.gram)
        least = ((h >> PLACES) << PLACES) | np.arange(len(h), dtype=np.uint64)
        done, span = 1, settings.length - settings.gram + 1
        while done < span:
            by = min(done, span - done)
            least = np.minimum(least[:-by], least[by:])
            done += by
        place = (least & ((np.uint64(1) << PLACES) - np.uint64(1))).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(place) - 1]])
        yield h[place[first]], place[first] + begin, first + begin, last + begin


def smaller_than_next(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each place whether its suffix is smaller than the one after it; a segment's last suffix is the larger (its end sorts first)."""
    change = np.zeros(len(text), np.int8)
    change[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    change[ends - 1] = -1
    # an equal byte has the type of the place after it: take the next change
    at = np.where(change != 0, np.arange(len(text)), len(text))
    return change[np.minimum.accumulate(at[::-1])[::-1]] > 0


def suffix_order(data: bytes, starts: np.ndarray, ends: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted places in the order of their suffixes (to `depth` bytes, and to their segment's end).

    Two stages. Suffixes smaller than their successors are sorted directly. The others are induced: buckets of the first byte are
    scanned upwards; a bucket holds first the suffixes larger than their successors, then those sorted directly, and each suffix in turn
    puts the one before it, if that is larger, at the end of the larger ones in its bucket. A bucket's suffixes are scanned together,
    as only runs of its own byte put suffixes into the same bucket: these are scanned level by level.
    """
    text = np.frombuffer(data, np.uint8)
    direct = smaller_than_next(text, ends)
    # beside the wanted places, those that they are induced from: on to the first one that is sorted directly, or to the segment's end
    end_of = np.repeat(ends, ends - starts)
    active = np.zeros(len(text), bool)
    active[wanted] = True
    front = wanted
    while len(front):
        front = front[~direct[front]] + 1
        front = front[front < len(text)]
        front = front[(front < end_of[front - 1]) & ~active[front]]
        active[front] = True
    induced = active & ~direct
    places = np.flatnonzero(active & direct).tolist()
    stop = np.minimum(end_of[places], np.array(places, np.int64) + depth).tolist()
    sorted_direct = np.array([p for _, p in sorted(zip([data[p:q] for p, q in zip(places, stop, strict=True)], places, strict=True))], np.int64)
    first_byte = text[sorted_direct]
    by_byte = np.searchsorted(first_byte, np.arange(257))
    larger: list[list[np.ndarray]] = [[] for _ in range(256)]

    def put(scanned: np.ndarray, above: int) -> None:
        before = scanned[scanned > 0] - 1
        before = before[induced[before] & (text[before] > above)]
        before = before[end_of[before] == end_of[np.minimum(before + 1, len(text) - 1)]]  # not across segments
        byte = text[before]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        for b in np.unique(byte).tolist():
            larger[b].append(before[byte == b])

    last = ends - 1  # a segment's end sorts before all bytes
    last = last[induced[last]]
    for b in np.unique(text[last]).tolist():
        larger[b].append(last[text[last] == b])
    out = []
    for byte in range(256):
        here = larger[byte]
        level = np.concatenate(here) if here else np.zeros(0, np.int64)
        levels = []
        while len(level):
            levels.append(level)
            before = level[level > 0] - 1
            before = before[induced[before] & (text[before] == byte)]
            level = before[end_of[before] == end_of[before + 1]]
        bucket = np.concatenate([*levels, sorted_direct[by_byte[byte] : by_byte[byte + 1]]])
        put(bucket, byte)
        out.append(bucket)
    order = np.concatenate(out)
    is_wanted = np.zeros(len(text), bool)
    is_wanted[wanted] = True
    return order[is_wanted[order]]


def adjacent_prefixes(data: bytes, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix lengths, `depth` at most, of each suffix in the order with the one before it (the first: 0); all have `depth` bytes."""
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), depth)
    out = np.zeros(len(order), np.int64)
    for k in range(1, len(order), 8192):
        rows = windows[order[k - 1 : k + 8192]]
        differ = rows[1:] != rows[:-1]
        out[k : k + len(differ)] = np.where(differ.any(1), differ.argmax(1), depth)
    return out


def repeated_starts(segments: list[bytes], depth: int) -> list[np.ndarray]:
    """For each segment whether the string of `depth` bytes at each start is also at another start of the segments."""
    sizes = np.array([len(s) for s in segments])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    data = b"".join(segments)
    counts = sizes - depth + 1
    wanted = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    order = suffix_order(data, starts, ends, wanted, depth)
    shared = adjacent_prefixes(data, order, depth) >= depth
    repeated = np.zeros(len(data), bool)
    repeated[order] = shared | np.concatenate([shared[1:], [False]])
    return [repeated[a : a + n] for a, n in zip(starts, counts, strict=True)]


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]


ROW = [("doc_id", pa.int64()), ("text_hash", pa.int64())]
ROW_SQL = "doc_id long, text_hash long"
SEGMENTS = pa.schema([*ROW, ("key", pa.int64()), ("whole", pa.int64()), ("place", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])
SEGMENTS_SQL = f"{ROW_SQL}, key long, whole long, place int, lo int, hi int"
BYTES = pa.schema([("key", pa.int64()), *ROW, ("lo", pa.int32()), ("alone", pa.bool_()), ("data", pa.binary())])
SPANS = pa.schema([*ROW, ("lo", pa.int32()), ("hi", pa.int32())])
CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def signed(hashes: list[int]) -> np.ndarray:
    return np.array(hashes, np.uint64).view(np.int64)


def anchor_segments(texts: DataFrame, settings: Repeats) -> DataFrame:
    """A row for each anchor of each text: its hash (key), the hash of its segment (whole), and its first and last string start."""

    def make(batches):
        import xxhash

        for batch in batches:
            for doc_id, text_hash, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode("utf-8", "replace")
                if len(data) < settings.length:
                    continue
                for key, place, lo, hi in anchors(data, settings):
                    whole = [xxhash.xxh3_64_intdigest(data[a : b + settings.length], p - a) for p, a, b in zip(place.tolist(), lo.tolist(), hi.tolist(), strict=True)]
                    n = len(key)
                    yield batch_of(SEGMENTS, [[doc_id] * n, [text_hash] * n, key.view(np.int64), signed(whole), place, lo, hi])

    return texts.select("doc_id", "text_hash", "text").mapInArrow(whole_batches(make), SEGMENTS_SQL)


def whole_batches(make, rows: int = 20_000):
    """Joins the small batches that `make` gives for each text to larger ones."""

    def joined(batches):
        held, n = [], 0
        for batch in make(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return joined


def with_texts(texts: DataFrame, rows: DataFrame, columns: str) -> DataFrame:
    """doc_id, text_hash, text and `wanted`, the rows' columns as an array: each text that has rows once."""
    wanted = written(rows.groupBy("doc_id", "text_hash").agg(F.collect_list(F.expr(f"struct({columns})")).alias("wanted")), "wanted")
    side = sized(wanted.withColumnsRenamed({"doc_id": "wanted_id", "text_hash": "wanted_hash"}))
    found = texts.join(side, texts["doc_id"].eqNullSafe(side["wanted_id"]) & (texts["text_hash"] == side["wanted_hash"]))
    return found.select("doc_id", "text_hash", "text", "wanted")


def split_segments(texts: DataFrame, hot: DataFrame, step: int, settings: Repeats) -> DataFrame:
    """Segments of groups with too many members, split by where strings start against the anchor.

    Strings that start in the same `step` places all hold the same core of length - step + 1 bytes: it becomes the key with them.
    """

    def make(batches):
        import xxhash

        length = settings.length
        for batch in batches:
            for doc_id, text_hash, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data, out = text.encode("utf-8", "replace"), [[] for _ in SEGMENTS]
                for w in wanted:
                    place = w["place"]
                    for group in range((place - w["hi"]) // step, (place - w["lo"]) // step + 1):
                        lo, hi = max(w["lo"], place - group * step - step + 1), min(w["hi"], place - group * step)
                        key = xxhash.xxh3_64_intdigest(data[place - group * step : place - group * step - step + 1 + length], group)
                        whole = xxhash.xxh3_64_intdigest(data[lo : hi + length], place - lo)
                        for column, value in zip(out, (doc_id, text_hash, key, whole, place, lo, hi), strict=True):
                            column.append(value)
                yield batch_of(SEGMENTS, [out[0], out[1], signed(out[2]), signed(out[3]), *out[4:]])

    return with_texts(texts, hot, "place, lo, hi").mapInArrow(whole_batches(make), SEGMENTS_SQL)


def segment_bytes(texts: DataFrame, rows: DataFrame, settings: Repeats) -> DataFrame:
    """key, doc_id, text_hash, lo, alone, data: the rows' segments with their bytes."""

    def make(batches):
        for batch in batches:
            for doc_id, text_hash, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data, n = text.encode("utf-8", "replace"), len(wanted)
                cut = [data[w["lo"] : w["hi"] + settings.length] for w in wanted]
                yield batch_of(BYTES, [[w["key"] for w in wanted], [doc_id] * n, [text_hash] * n, [w["lo"] for w in wanted], [w["alone"] for w in wanted], cut])

    return with_texts(texts, rows, "key, lo, hi, alone").mapInArrow(whole_batches(make, 2_000), f"key long, {ROW_SQL}, lo int, alone boolean, data binary")


def array_search(settings: Repeats):
    """Suffix arrays over whole groups of segments, some `batch` bytes at a time; gives the repeated starts of segments that are alone."""

    def search(batches):
        held: list[pa.Table] = []
        size = 0
        for table in groups_of(batches, 1):
            held.append(table)
            size += table.nbytes
            if size >= settings.batch:
                yield spans(held)
                held, size = [], 0
        if held:
            yield spans(held)

    def spans(tables: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(tables)
        doc_id, text_hash, lo, alone = (table.column(c).to_pylist() for c in ("doc_id", "text_hash", "lo", "alone"))
        out = [[] for _ in SPANS]
        for k, flags in enumerate(repeated_starts(table.column("data").to_pylist(), settings.length)):
            for a, b in runs_of(flags) if alone[k] else ():
                for column, value in zip(out, (doc_id[k], text_hash[k], lo[k] + a, lo[k] + b + settings.length), strict=True):
                    column.append(value)
        return batch_of(SPANS, out)

    return search


def repeated_spans(docs: DataFrame, settings: Repeats = Repeats()) -> DataFrame:
    """doc_id, text_hash, lo, hi: spans of bytes that repeated strings cover; they may overlap. text_hash is xxhash64 of the text.

    Every string of `length` bytes belongs to one anchor, the least gram in it, and equal strings to equal anchors. So only the segments
    around anchors that occur again can hold repeats, and each group of equal anchors can be searched by itself. Equal segments of a
    group are one: their strings repeat each other. Distinct segments go to suffix arrays, a group in one task. Groups of very many
    distinct segments are first split by where strings start (and by the bytes that all of these hold), so none is unbounded.
    """
    texts = id_and_text(docs).withColumn("text_hash", F.xxhash64("text"))
    rows, out = written(anchor_segments(texts, settings), "segments"), []
    for step in (*settings.steps, 0):
        equal = rows.groupBy("key", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_hash", "place", "lo", "hi")).alias("one"))
        groups = equal.groupBy("key").agg(F.count(F.lit(1)).alias("distinct"), F.min("n").alias("least"), F.sum("n").alias("total")).where("total > 1").drop("total")
        members = written(equal.join(groups, "key"), "members")
        copies = members.where("n > 1").select("key", "whole")
        out.append(rows.join(copies, ["key", "whole"], "left_semi").select("doc_id", "text_hash", "lo", (F.col("hi") + settings.length).alias("hi")))
        # groups with one segment that no other equals
        open_groups = members.where((F.col("distinct") > 1) & (F.col("least") == 1)).select("key", (F.col("n") == 1).alias("alone"), "distinct", "one.*")
        searched = segment_bytes(texts, open_groups.where(F.col("distinct") <= settings.hot), settings)
        out.append(searched.repartition("key").sortWithinPartitions("key", "data").mapInArrow(array_search(settings), f"{ROW_SQL}, lo int, hi int"))
        hot = open_groups.where(F.col("distinct") > settings.hot)
        if not step or hot.isEmpty():
            break
        # all segments of a hot group go on, copies too: they can repeat parts of others
        rows = written(split_segments(texts, hot, step, settings), "segments")
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found


def remove_repeats(docs: DataFrame, settings: Repeats = Repeats()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row: the bytes left when all repeated strings are taken out.

    A null text is empty; shorter texts than `length` bytes lose nothing. A null doc_id stays null. Rows with equal ids and texts, like
    equal texts of other ids, are copies of each other and lose all bytes. Further columns are left out.
    """
    texts = id_and_text(docs).withColumn("text_hash", F.xxhash64("text"))
    merged = "aggregate(array_sort(collect_list(struct(lo, hi))), cast(array() AS array<struct<lo:int,hi:int>>), (a, x) -> if(size(a) > 0 AND x.lo <= element_at(a, -1).hi, concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).lo AS lo, greatest(element_at(a, -1).hi, x.hi) AS hi))), concat(a, array(x))))"
    spans = written(repeated_spans(docs, settings).groupBy("doc_id", "text_hash").agg(F.expr(merged).alias("spans")), "spans")
    side = sized(spans.withColumnsRenamed({"doc_id": "span_id", "text_hash": "span_hash"}))
    joined = texts.join(side, texts["doc_id"].eqNullSafe(side["span_id"]) & (texts["text_hash"] == side["span_hash"]), "left").select("doc_id", "text", "spans")

    def cut(batches):
        for batch in batches:
            out = [[] for _ in CUT]
            for doc_id, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data, at, kept = text.encode("utf-8", "replace"), 0, hashlib.sha256()
                for s in spans or ():
                    kept.update(data[at : s["lo"]])
                    at = s["hi"]
                kept.update(data[at:])
                row = (doc_id, len(data), sum(s["hi"] - s["lo"] for s in spans or ()), len(spans or ()), kept.hexdigest())
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield batch_of(CUT, out)

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
