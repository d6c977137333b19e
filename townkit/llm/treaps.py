"""Ranked lexical search over inverted treaps.

Each term of the queries has a treap over the documents of a shard: document numbers are its search order and impacts (what the term adds
to a document's score) its heap order, so that the root of any subtree bounds what its documents can get from the term. All treaps of a
query are walked together over intervals of document numbers. An interval whose summed roots cannot enter the best k is left out whole;
else the document with the greatest impact is scored, and the interval is parted there.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from townkit.llm.shared import batch_of, small_batches, written
from townkit.operators.numbering import numbered

#: Distinct terms that the items of one block may have, and items of a block; the documents are searched once for each block.
BLOCK_TERMS, BLOCK_ITEMS = 200_000, 2_000
#: Postings that a task holds as treaps at a time.
SHARD_POSTINGS = 1_500_000
#: Intervals that one step of the walk takes together.
STEP = 512
#: Java's pattern of a term.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same over the bytes of a text: all bytes of other characters are 0x80 and more.
TERM_BYTES = rb"[0-9a-z\x80-\xff]+"
POSTINGS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])
POSTINGS_SQL = "doc_id long, n long, terms array<int>, tfs array<long>"
HITS = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64()), ("task", pa.int64())])
HITS_SQL = "item long, doc_id long, score long, task long"


@dataclass
class Treaps:
    """The treaps of all terms of a shard. Nodes are postings by term and document; the last node is no node and has impact 0."""

    doc: np.ndarray
    impact: np.ndarray
    left: np.ndarray
    right: np.ndarray
    root: np.ndarray
    #: postings by document, for the score of one document
    doc_start: np.ndarray
    doc_terms: np.ndarray
    doc_impacts: np.ndarray

    @property
    def none(self) -> int:
        return len(self.impact) - 1


def children(priority: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(root of each range, left child, right child) of the heap-ordered trees over neighbouring ranges, level by level; len(priority) is none."""
    n = len(priority)
    left, right = np.full(n + 1, n, np.int32), np.full(n + 1, n, np.int32)
    roots = np.full(len(starts), n, np.int32)
    low, high, slot = starts.astype(np.int64), ends.astype(np.int64), -np.arange(1, len(starts) + 1, dtype=np.int64)
    while True:
        some = high > low
        low, high, slot = low[some], high[some], slot[some]
        if not len(low):
            return roots, left, right
        # the ranges' rows only: earlier roots lie between them
        size = high - low
        first = np.cumsum(size) - size
        rows = np.arange(int(size.sum())) - np.repeat(first - low, size)
        here = priority[rows]
        top = np.maximum.reduceat(here, first)
        node = rows[np.flatnonzero(here == np.repeat(top, size))]  # priorities are distinct: one of each range
        is_root = slot < 0
        roots[-1 - slot[is_root]] = node[is_root]
        child, parent = ~is_root & (slot % 2 == 0), slot // 2
        left[parent[child]] = node[child]
        child = ~is_root & (slot % 2 == 1)
        right[parent[child]] = node[child]
        low, high, slot = np.concatenate([low, node + 1]), np.concatenate([node, high]), np.concatenate([2 * node, 2 * node + 1])


def build(doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int) -> Treaps:
    """Treaps from postings in document order. Equal impacts are ordered at random, which keeps the trees low."""
    n = len(doc)
    order = np.argsort(term, kind="stable")
    by_term = impact[order]
    rank = np.empty(n, np.int64)
    rank[np.lexsort((np.random.default_rng(1).permutation(n), by_term))] = np.arange(n)
    ends = np.cumsum(np.bincount(term, minlength=n_terms))
    root, left, right = children(rank, np.concatenate([[0], ends[:-1]]), ends)
    doc_start = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n_docs))])
    return Treaps(np.append(doc[order], 0), np.append(by_term, 0), left, right, root, doc_start, term, impact)


def descend(t: Treaps, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """From each node (a row for each interval, a column for each term) down to the root of what lies in low ... high."""
    node = node.copy()
    flat, low, high = node.reshape(-1), np.repeat(low, node.shape[1]), np.repeat(high, node.shape[1])
    at = np.arange(len(flat))
    while len(at):
        here = flat[at]
        doc = t.doc[here]
        over, under = doc > high[at], doc < low[at]
        out = (over | under) & (here != t.none)
        at, here, over = at[out], here[out], over[out]
        flat[at] = np.where(over, t.left[here], t.right[here])
    return node


def scores(t: Treaps, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The sums of the impacts of the wanted terms in each document."""
    start, size = t.doc_start[docs], t.doc_start[docs + 1] - t.doc_start[docs]
    first = np.cumsum(size) - size
    rows = np.arange(int(size.sum())) - np.repeat(first - start, size)
    return np.add.reduceat(np.where(wanted[t.doc_terms[rows]], t.doc_impacts[rows], 0), first)  # each document has a posting


@dataclass
class Best:
    """The best k (score, id) so far; of equal scores the smallest ids, null ones last. `least` is what a document must reach."""

    k: int
    score: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    doc_id: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    no_id: np.ndarray = field(default_factory=lambda: np.empty(0, bool))

    @property
    def least(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc_id: np.ndarray, no_id: np.ndarray) -> None:
        score, doc_id, no_id = np.concatenate([self.score, score]), np.concatenate([self.doc_id, doc_id]), np.concatenate([self.no_id, no_id])
        order = np.lexsort((doc_id, no_id, -score))[: self.k]
        self.score, self.doc_id, self.no_id = score[order], doc_id[order], no_id[order]


def walk(t: Treaps, terms: np.ndarray, ids: np.ndarray, no_id: np.ndarray, best: Best) -> int:
    """Walks the treaps of the terms together and adds what enters the best; returns how many documents were scored."""
    terms = terms[t.root[terms] != t.none]
    if not len(terms):
        return 0
    wanted = np.zeros(len(t.root), bool)
    wanted[terms] = True
    low, high, node = np.array([0]), np.array([len(ids) - 1]), t.root[terms][None, :]
    bound, scored = t.impact[node].sum(axis=1), 0
    while True:
        alive = bound >= best.least
        low, high, node, bound = low[alive], high[alive], node[alive], bound[alive]
        if not len(low):
            return scored
        # the intervals with the greatest bounds first: they raise the bar for the others
        if len(low) > STEP:
            split = np.argpartition(-bound, STEP)
            take, rest = split[:STEP], split[STEP:]
        else:
            take, rest = np.arange(len(low)), np.empty(0, np.int64)
        impacts = t.impact[node[take]]
        pivot = t.doc[node[take, impacts.argmax(axis=1)]]
        score = scores(t, pivot, wanted)
        enter = score >= best.least
        best.add(score[enter], ids[pivot[enter]], no_id[pivot[enter]])
        scored += len(take)
        lows, highs = np.concatenate([low[take], pivot + 1]), np.concatenate([pivot - 1, high[take]])
        nodes = np.concatenate([node[take], node[take]])
        some = lows <= highs
        lows, highs = lows[some], highs[some]
        nodes = descend(t, nodes[some], lows, highs)
        bounds = t.impact[nodes].sum(axis=1)
        keep = bounds >= best.least
        low, high, node, bound = (np.concatenate([old[rest], new[keep]]) for old, new in ((low, lows), (high, highs), (node, nodes), (bound, bounds)))


def item_terms(items: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id, terms (distinct), item (its number), block: items numbered by id and text, and blocked so that a block's terms are bounded.

    An item with more distinct terms than a block may hold is a block of its own.
    """
    lowered = F.translate(F.coalesce(F.col(text_column), F.lit("")), UPPER, LOWER)
    terms = F.array_distinct(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0)))
    rows = items.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), terms.alias("terms")).withColumn("n_terms", F.size("terms").cast("long"))
    counted = numbered(rows, [F.col("id").asc_nulls_last(), F.col("text").asc_nulls_last()], "n_terms")
    block = F.floor(F.col("sum_before") / BLOCK_TERMS) * 1_000_000 + F.floor(F.col("row_number") / BLOCK_ITEMS)
    return written(counted.select("id", "terms", F.col("row_number").alias("item"), block.alias("block")), "items")


def postings(docs: DataFrame, numbers, id_column: str, text_column: str) -> DataFrame:
    """doc_id, n (terms with repeats), terms, tfs: of each document with terms, those that the items have. numbers: a broadcast of term numbers."""

    def count(batches):
        import re

        pattern, known = re.compile(TERM_BYTES), numbers.value
        for batch in batches:
            out = [[] for _ in POSTINGS]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                # bytes are lower-cased in A-Z alone
                found = pattern.findall(text.as_py().lower())
                if not found:
                    continue
                held = Counter(map(known.get, found))
                held.pop(None, None)
                for column, value in zip(out, (doc_id, len(found), list(held), list(held.values())), strict=True):
                    column.append(value)
            yield batch_of(POSTINGS, out)

    texts = small_batches(docs).select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("binary").alias("text"))
    return texts.where("text IS NOT NULL").mapInArrow(count, POSTINGS_SQL)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def searched(held: DataFrame, queries, weights, n_docs: int, n_words: int, k: int) -> DataFrame:
    """item, doc_id, score, task: the best k of each task for each item. queries, weights: broadcasts."""

    def search(batches):
        from pyspark import TaskContext

        items, w, task = queries.value, weights.value, TaskContext.get().partitionId()
        best = [Best(k) for _ in items]
        for ids, no_id, n, size, terms, tfs in shards(batches):
            doc = np.repeat(np.arange(len(ids)), size)
            m = 50 + (50 * n * n_docs) // n_words
            impact = w[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[doc]))
            some = impact > 0
            if some.any():
                t = build(doc[some], terms[some], impact[some], len(ids), len(w))
                for (_, wanted), b in zip(items, best, strict=True):
                    walk(t, wanted, ids, no_id, b)
        for (item, _), b in zip(items, best, strict=True):
            if len(b.score):
                yield batch_of(HITS, [np.full(len(b.score), item), pa.array(b.doc_id, mask=b.no_id), b.score, np.full(len(b.score), task)])

    return held.where(F.size("terms") > 0).mapInArrow(search, HITS_SQL)


def shards(batches) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, whether null, n, number of postings, terms, tfs) of about SHARD_POSTINGS postings at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch.column("terms").flatten())
        if n >= SHARD_POSTINGS:
            yield shard(held)
            held, n = [], 0
    if held:
        yield shard(held)


def shard(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    table = pa.Table.from_batches(batches).combine_chunks()
    ids, lists = table.column("doc_id").combine_chunks(), table.column("terms").combine_chunks()
    size = np.array([len(x) for x in lists]) if lists.null_count else np.diff(lists.offsets.to_numpy())
    return ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), table.column("n").to_numpy(), size, lists.flatten().to_numpy(), table.column("tfs").combine_chunks().flatten().to_numpy()


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank (int), doc_id, score: for each item the k documents of the highest scores above 0; equal scores by ascending id, null last.

    Scores are whole numbers of 64 bits: a term's weight falls with the documents that hold it, its frequency saturates, and long documents
    count less. Null and empty texts have no terms: such documents are found by no item and count in no statistic, such items find nothing.
    Items of one id are searched one by one, repeated documents are ranked one by one. Texts are read whole; further columns are left out;
    empty tables give an empty result.

    The items' terms decide which postings are kept, so a block of items reads the texts once and writes the postings; counts over all
    documents come from these. Each task then builds treaps over its postings, a bounded number at a time, and hands on k rows an item; the
    rows of an item meet in two steps, so that no task gets those of all tasks at once. Documents are not shuffled.
    """
    spark = docs.sparkSession
    numbered_items = item_terms(items, item_id, text)
    blocks = sorted(r["block"] for r in numbered_items.where(F.size("terms") > 0).select("block").distinct().collect())
    out = None
    for block in blocks:
        queries = numbered_items.where((F.col("block") == block) & (F.size("terms") > 0)).select("item", "terms").collect()  # bounded by the block
        numbers = {term: i for i, term in enumerate(sorted({t for q in queries for t in q["terms"]}))}
        of_bytes = spark.sparkContext.broadcast({term.encode(): i for term, i in numbers.items()})
        held = written(postings(docs, of_bytes, doc_id, text), "postings")
        total = held.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).collect()[0]
        if not total["n"]:
            break
        df = {r["term"]: r["count"] for r in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
        weights = np.array([weight(total["n"], df.get(i, 0)) for i in range(len(numbers))], np.int64)
        plan = [(q["item"], np.array(sorted(numbers[t] for t in q["terms"]), np.int64)) for q in queries]
        hits = searched(held, spark.sparkContext.broadcast(plan), spark.sparkContext.broadcast(weights), total["n"], total["l"], k)
        hits = written(hits, "hits")
        out = hits if out is None else out.union(hits)
    if out is None:
        out = spark.createDataFrame([], HITS_SQL)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    groups = max(1, math.isqrt(out.agg(F.coalesce(F.max("task"), F.lit(0)).alias("n")).collect()[0]["n"]))
    first = out.withColumn("place", F.row_number().over(Window.partitionBy("item", F.pmod("task", F.lit(groups))).orderBy(*order))).where(F.col("place") <= k)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return last.join(numbered_items.select("item", F.col("id").alias("item_id")), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
