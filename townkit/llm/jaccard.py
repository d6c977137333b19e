"""N-gram Jaccard join by chosen paths: near copies found by recursive splits on sampled shared tokens, verified exactly."""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townkit.llm.shared import batch_of, components, id_and_text, sized, spread_join, text_groups, written

WORD = re.compile(r"[^\W_]+")
#: Word hashes that a Python worker remembers.
REMEMBERED = 60_000


@dataclass(frozen=True)
class Join:
    """threshold, n: the similarity of the join and the words of a shingle.

    recall: the chance that a pair at the threshold is found; runs of the chosen-path tree are repeated until it is reached. A pair of
    similarity s meets in a run's root bucket with probability s, and stays together through a split, which samples `splits` tokens, with
    1 - (1 - s)^splits; `levels` splits at most. At 0.8 a run finds a pair with 0.8 * 0.96^2 = 0.74 if all its buckets are split, so that
    10 runs are needed for 1 - 2e-6; pairs above the threshold, or in small buckets, are found more often.
    small: buckets of up to so many sets are compared pair by pair. coordinates: tokens that stand for a set (its MinHash values).
    maybe: estimated similarity from which a pair is verified; 0.2 below the threshold is over five deviations.
    block_sets, block_shingles: what one side of a verifying task holds.
    """

    threshold: float = 0.8
    n: int = 5
    recall: float = 1 - 2e-6
    splits: int = 2
    levels: int = 2
    small: int = 128
    coordinates: int = 128
    maybe: float = 0.6
    block_sets: int = 512
    block_shingles: int = 250_000

    @property
    def runs(self) -> int:
        found = self.threshold * (1 - (1 - self.threshold) ** self.splits) ** self.levels
        return max(1, math.ceil(math.log(1 - self.recall) / math.log(1 - found)))


class Shingler:
    """Hashes of the n-word shingles of texts; word hashes are remembered."""

    def __init__(self, n: int):
        self.n, self.known = n, {}
        random = np.random.Generator(np.random.PCG64(2024))
        self.factors = random.integers(1, 2**63, n, dtype=np.uint64) * 2 + 1

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The sorted distinct hashes of each text. A text of 1 to n - 1 words has one shingle, all of them; one without words none."""
        import xxhash

        for start, end in text_groups(texts):
            cut = [WORD.findall(t.lower()) for t in texts[start:end]]
            words = set(chain.from_iterable(cut))
            if len(self.known) > REMEMBERED:
                self.known.clear()
            for w in words.difference(self.known) if self.known else words:
                self.known[w] = xxhash.xxh3_64_intdigest(w)
            for found in cut:
                yield self.of(np.fromiter(map(self.known.__getitem__, found), np.uint64, len(found)))

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return hashes
        n = min(self.n, len(hashes))
        mixed = np.zeros(len(hashes) - n + 1, np.uint64)
        for i in range(n):
            mixed += (hashes[i : len(hashes) - n + 1 + i] ^ (hashes[i : len(hashes) - n + 1 + i] >> np.uint64(29))) * self.factors[i]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


@lru_cache(4)
def shingler(n: int) -> Shingler:
    return Shingler(n)


@lru_cache(4)
def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.Generator(np.random.PCG64(77))
    return random.integers(0, 2**32, (n, 1), dtype=np.uint32), random.integers(0, 2**31, (n, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minhash(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """The least 32-bit hash of the set in each of the random orders."""
    xor, factor = permutations(coordinates)
    low = (shingles >> np.uint64(16)).astype(np.uint32)
    least = np.full(coordinates, 2**32 - 1, np.uint32)
    for k in range(0, len(low), 4096):
        np.minimum(least, ((low[k : k + 4096] ^ xor) * factor).min(1), out=least)
    return least


def set_key(shingles: np.ndarray) -> str:
    """96 bits of a hash of the set, which name it."""
    return base64.b64encode(hashlib.md5(shingles.tobytes()).digest()[:12]).decode()


SETS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("node", pa.string()), ("shingles", pa.int64()), ("path", pa.list_(pa.int32())), ("sketch", pa.binary())])


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and text_hash, which tell rows apart."""
    return id_and_text(docs).withColumn("text_hash", F.xxhash64("text"))


def shingle_sets(docs: DataFrame, join: Join) -> DataFrame:
    """doc_id, text_hash, node (name of the set, null without words), shingles, path (the runs' sampled tokens), sketch (16 bits of each coordinate)."""
    used = join.runs * (1 + join.splits * join.levels)
    picked = np.resize(np.random.Generator(np.random.PCG64(5)).permutation(join.coordinates), used)

    def make(batches):
        cutter = shingler(join.n)
        for batch in batches:
            out = [[] for _ in SETS]
            for shingles in cutter(batch.column(1).to_pylist()):
                if len(shingles):
                    least = minhash(shingles, join.coordinates)
                    row = (set_key(shingles), len(shingles), least[picked].view(np.int32), least.astype("<u2").tobytes())
                else:
                    row = (None, 0, None, None)
                for column, value in zip(out[2:], row, strict=True):
                    column.append(value)
            yield batch_of(SETS, [batch.column(0), batch.column(2), *out[2:]])

    return rows_of(docs).mapInArrow(make, "doc_id long, text_hash long, node string, shingles long, path array<int>, sketch binary")


def union_find(size: int, pairs: np.ndarray) -> np.ndarray:
    """The least member of each member's group."""
    root = np.arange(size)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs.tolist():
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(size)], np.int64)


EDGES = pa.schema([("a", pa.string()), ("b", pa.string())])


def groups_of(batches, key_columns: int):
    """Record batches sorted by their first columns, as one table a key; a key may go on over batches."""
    held: list[pa.RecordBatch] = []

    def key(batch, row):
        return tuple(batch.column(c)[row].as_py() for c in range(key_columns))

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in range(key_columns)]
        changed = np.zeros(batch.num_rows, bool)
        for c in columns:
            changed[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if held and key(held[0], 0) != key(batch, a):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def candidate_links(nodes: DataFrame, join: Join) -> DataFrame:
    """(a, b): links whose components hold together every pair of nodes that the chosen paths find and whose sketches may be similar."""
    width = 1 + join.splits * join.levels
    run = "transform(sequence(0, {}), r -> struct(xxhash64(r, path[r * {}]) AS key, slice(path, r * {} + 2, {}) AS rest))".format(join.runs - 1, width, width, width - 1)
    rows = nodes.select("node", F.inline(F.expr(run)))
    edges = None
    for level in range(join.levels + 1):
        buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least"), F.sum(F.xxhash64("node") / 4294967296).cast("long").alias("content")).where("size > 1")
        buckets = written(buckets, "buckets")
        # runs often meet in the same bucket: one of equal buckets is enough
        leaves = buckets.where(F.col("size") <= join.small).groupBy("size", "least", "content").agg(F.min("key").alias("key")).select("key")
        compared = rows.join(leaves, "key").select("key", "node").join(nodes.select("node", "sketch"), "node").select("key", "node", "sketch")
        found = compared.repartition("key").sortWithinPartitions("key", "node").mapInArrow(compare_sketches(join), "a string, b string")
        edges = found if edges is None else edges.union(found)
        large = buckets.where(F.col("size") > join.small)
        if level == join.levels:
            # sets that stay together through all splits are most likely copies: linked without a comparison, the verifier looks at all
            edges = edges.union(spread_join(rows, large.select("key", "least", "size"), ["key"], "size").select(F.col("node").alias("a"), F.col("least").alias("b")))
        else:
            tokens = f"transform(sequence(0, {join.splits - 1}), j -> struct(xxhash64(key, j, rest[j + {level * join.splits}]) AS key, rest AS rest))"
            rows = written(spread_join(rows, large.select("key", "size"), ["key"], "size").select("node", F.inline(F.expr(tokens))), "split")
            if rows.isEmpty():
                break
    return edges


def compare_sketches(join: Join):
    """Links the members of each small bucket whose sketches agree enough."""

    def compare(batches):
        for table in groups_of(batches, 1):
            names = table.column("node").to_pylist()
            sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), "<u2").reshape(len(names), -1)
            pairs = []
            for i in range(len(names) - 1):
                close = np.flatnonzero((sketches[i + 1 :] == sketches[i]).mean(1) >= join.maybe)
                pairs += [(i, i + 1 + int(k)) for k in close]
            if pairs:
                root = union_find(len(names), np.array(pairs))
                linked = np.flatnonzero(root != np.arange(len(names)))
                yield batch_of(EDGES, [[names[i] for i in linked], [names[root[i]] for i in linked]])

    return compare


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Shared elements of each set on the left with each on the right (None: the left again)."""
    both = left if right is None else left + right
    elements, place, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    shared = count > 1
    column = np.cumsum(shared) - 1
    keep = shared[place]
    owner, place = owner[keep], column[place[keep]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    total = np.zeros((len(left), len(both) if right is None else len(right)))
    step = 4096
    for first in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(place, (first, first + step))
        x = np.zeros((len(both), min(step, int(shared.sum()) - first)), np.float32)
        x[owner[a:b], place[a:b] - first] = 1
        total += x @ x.T if right is None else x[: len(left)] @ x[len(left) :].T
    if right is None:  # elements that no other set has count only here
        np.fill_diagonal(total, [len(s) for s in left])
    return total


def reaching(shared: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sets of so many elements reach the similarity, in doubles; row by row, so that no other whole matrix is held."""
    out = np.empty(shared.shape, bool)
    for k, row in enumerate(shared):
        out[k] = row.astype(float) * (1 + threshold) >= threshold * (left[k] + right) - 1e-6
    return out


LINKED = pa.schema([("node", pa.string()), ("links", pa.int64()), ("other", pa.string())])


def verify(join: Join):
    """For each cell (a block with itself, or two blocks of one component): the weight that each node links to, and a forest of the links."""

    def check(batches):
        for table in groups_of(batches, 3):
            nodes: dict[str, tuple[int, int, np.ndarray]] = {}
            for node, block, weight, data in zip(*(table.column(c).to_pylist() for c in ("node", "block", "weight", "data")), strict=True):
                nodes[node] = (block, weight, np.frombuffer(data, np.uint64))  # repeated rows of one document are one
            i, j = table.column(1)[0].as_py(), table.column(2)[0].as_py()
            names = sorted(nodes, key=lambda x: (nodes[x][0] != i, x))
            first = sum(nodes[x][0] == i for x in names)
            sets = [nodes[x][2] for x in names]
            sizes, weights = np.array([len(s) for s in sets], float), np.array([nodes[x][1] for x in names])
            if not first or (i != j and first == len(names)) or len(names) < 2:
                continue
            a = np.arange(first)
            b = a if i == j else np.arange(first, len(names))
            shared = overlaps(sets[:first], None if i == j else sets[first:])
            similar = reaching(shared, sizes[a], sizes[b], join.threshold)
            if i == j:
                np.fill_diagonal(similar, False)
            links = np.zeros(len(names), np.int64)
            links[a] += similar @ weights[b]
            if i != j:
                links[b] += similar.T @ weights[a]
            root = spanning(similar, a, b, len(names))
            linked = np.flatnonzero(links)
            yield batch_of(LINKED, [[names[k] for k in linked], links[linked], [names[root[k]] for k in linked]])

    return check


def spanning(similar: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """The least member reachable for each member, by passing minima along the links until nothing changes."""
    label = np.arange(size)
    top = size + 1
    while True:
        before = label.copy()
        for x, y, links in ((a, b, similar), (b, a, similar.T)):
            least = np.array([label[y][row].min(initial=top) for row in links])
            label[x] = np.minimum(label[x], least)
        label = np.minimum(label, label[label])
        if (label == before).all():
            return label


def repeated_rows(sets: DataFrame) -> DataFrame:
    """doc_id and text_hash of rows that are there more than once."""
    return written(sets.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeated")


def row_classes(docs: DataFrame, sets: DataFrame, repeated: DataFrame, join: Join) -> DataFrame:
    """doc_id, text_hash, class_id, n_links and `kept` (the row of the class that has the smallest doc_id) for each row that has words."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    nodes = sets.where(F.col("node").isNotNull()).groupBy("node").agg(
        first, F.count(F.lit(1)).alias("weight"), F.max("shingles").alias("shingles"), F.max("path").alias("path"), F.max("sketch").alias("sketch")
    )
    nodes = written(nodes, "nodes")
    members = written(components(candidate_links(nodes, join)).withColumnRenamed("component", "group"), "groups")
    placed = written(members.join(nodes.select("node", "first", "weight", "shingles"), "node"), "candidates")
    blocks = placed.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.greatest(F.ceil(F.count(F.lit(1)) / join.block_sets), F.ceil(F.sum("shingles") / join.block_shingles)).alias("blocks"))
    placed = spread_join(placed, written(blocks, "blocks"), ["group"], "size").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    placed = written(placed.select("node", "group", "first", "weight", "blocks", "block"), "placed")
    links = written(cells(docs, repeated, placed, join), "verified")
    classes = components(links.select(F.col("node").alias("a"), F.col("other").alias("b")))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "first", "weight").join(classes, "node", "left").join(counted, "node", "left").withColumn("class", F.coalesce("component", "node"))
    named = written(named.select("node", "class", "first", "weight", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "named")
    # the first row of a class; minima are summed up before they are shuffled
    firsts = written(named.groupBy("class").agg(F.min("first").alias("kept"), F.count(F.lit(1)).alias("size")), "firsts")
    named = written(spread_join(named, firsts, ["class"], "size").select("node", "kept", "n_links", "weight"), "classes")
    known = spread_join(sets.select("doc_id", "text_hash", "node").where(F.col("node").isNotNull()), named, ["node"], "weight")
    return known.select("doc_id", "text_hash", F.col("kept.doc_id").alias("class_id"), "n_links", "kept")


def jaccard_classes(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """doc_id, class_id, n_links for every row: class_id is the smallest doc_id that links reach, n_links the rows linked directly.

    Rows link if the Jaccard similarity of their n-word shingle sets is at least the threshold. Words are runs of letters and digits,
    lower-cased; a text of fewer than n words has one shingle, all its words; a null text, or one without words, links with nothing.
    Repeated rows and ids are rows of their own, which link. A null doc_id takes part in links; a class of null ids alone has a null
    class_id. Very long texts count whole. Further columns are left out; an empty table gives an empty result.

    Equal sets are one node, and all work on pairs is on nodes. The chosen paths give candidate links; the components of these are
    verified exactly, large ones in cells of two blocks, so that no task holds a whole component and no row stands for a pair.
    """
    sets = written(shingle_sets(docs, join), "sets")
    found = row_classes(docs, sets, repeated_rows(sets), join).select("doc_id", "class_id", "n_links")
    return found.union(sets.where(F.col("node").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def one_of_each(rows: DataFrame, repeated: DataFrame, keys: list[str]) -> DataFrame:
    """rows, but only one of those that `repeated` holds; only these are shuffled, and summed up before that."""
    if repeated.isEmpty():
        return rows
    side = sized(repeated.withColumnsRenamed({"doc_id": "again_id", "text_hash": "again_hash"}))
    again = rows["doc_id"].eqNullSafe(side["again_id"]) & (rows["text_hash"] == side["again_hash"])
    return rows.join(side, again, "left_anti").unionByName(rows.join(side, again, "left_semi").dropDuplicates(keys))


def cells(docs: DataFrame, repeated: DataFrame, placed: DataFrame, join: Join) -> DataFrame:
    """node, links, other of the verified links; shingles are made again, from one row of each node that has candidates."""

    def make(batches):
        cutter = shingler(join.n)
        for batch in batches:
            for a, b in text_groups(batch.column("text").to_pylist()):
                part = batch.slice(a, b - a)
                data = [s.tobytes() for s in cutter(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("group", "node", "weight", "blocks", "block")), pa.array(data, pa.binary())], names=["group", "node", "weight", "blocks", "block", "data"])

    texts = rows_of(docs)
    chosen = sized(placed.select(F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"), "node", "group", "weight", "blocks", "block"))
    rows = texts.join(chosen, texts["doc_id"].eqNullSafe(chosen["first_id"]) & (texts["text_hash"] == chosen["first_hash"]))
    rows = one_of_each(rows, repeated, ["node"])
    made = rows.select("group", "node", "weight", "blocks", "block", "text").mapInArrow(make, "group string, node string, weight long, blocks long, block long, data binary")
    pairs = F.expr("transform(sequence(0, blocks - 1), k -> struct(least(block, k) AS i, greatest(block, k) AS j))")
    dealt = made.select("group", F.inline(pairs), "node", "block", "weight", "data")
    return dealt.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "node").mapInArrow(verify(join), "node string, links long, other string")


def keep_one(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """docs with one row of each class, that of the smallest doc_id (of equal ones the least hash of its text); all columns stay.

    Rows are told apart by doc_id (null too) and text, so a row stays although another of its id goes; of repeated rows one stays.
    Null texts and texts without words are no copies of anything: all of them stay. An empty table stays empty.
    """
    sets = written(shingle_sets(docs, join), "sets")
    repeated = repeated_rows(sets.where(F.col("node").isNotNull()))
    classes = row_classes(docs, sets, repeated, join)
    other = ~(F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("text_hash") == F.col("kept.text_hash")))
    gone = written(classes.where(other).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct(), "gone")
    gone = sized(gone.select(F.col("gone_id").alias("_gone_id"), F.col("gone_hash").alias("_gone_hash")))
    text_hash = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    stay = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_gone_id"]) & (text_hash == gone["_gone_hash"]), "left_anti")
    if repeated.isEmpty():
        return stay
    side = sized(repeated.select(F.col("doc_id").alias("_again_id"), F.col("text_hash").alias("_again_hash")))
    again = stay["doc_id"].cast("long").eqNullSafe(side["_again_id"]) & (F.xxhash64(F.coalesce(stay["text"], F.lit(""))) == side["_again_hash"])
    return stay.join(side, again, "left_anti").union(stay.join(side, again, "left_semi").dropDuplicates(["doc_id", "text"]))
