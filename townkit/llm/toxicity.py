"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, and distance-weighted votes."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townkit.llm.shared import batch_of, id_and_text, written

WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Settings:
    """examples, postings: the most labelled rows of each label that are used, and the most distinct words that these hold together (the
    documented bounds of the fit; rows are taken in the order of a hash); neighbours: votes for a score; block: examples in a block
    of the index; pull: weight of the prior against the votes; folds: one of so many is held out."""

    examples: int = 2_000
    postings: int = 600_000
    neighbours: int = 25
    block: int = 512
    pull: float = 0.25
    folds: int = 5


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def word_hashes(found) -> np.ndarray:
    """64-bit hashes, which stand for words: a worker holds no strings of the index."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64)


def known_terms(terms: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the rising terms, whether each hash is there)."""
    at = np.minimum(np.searchsorted(terms, hashes), max(0, len(terms) - 1))
    return at, terms[at] == hashes if len(terms) else np.zeros(len(hashes), bool)


def spans(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The whole numbers of all [start, stop), one after the other."""
    sizes = stops - starts
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def relevance(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """The squared deviations by which a term's odds differ between toxic and clean examples, given how many of each hold it.

    Log odds are smoothed by one document that is dealt to the labels by their sizes, so a term of no example has relevance 0.
    """
    n = max(1, n_toxic + n_clean)
    share1, share0 = n_toxic / n, n_clean / n
    a, b = toxic + share1, clean + share0
    with np.errstate(divide="ignore", invalid="ignore"):
        odds = np.log(a / (n_toxic - toxic + share1)) - np.log(b / (n_clean - clean + share0))
        z2 = odds * odds / (1 / a + 1 / b)
    return np.where(np.isfinite(z2), z2, 0.0)


@dataclass
class Index:
    """The examples as unit vectors over all their terms, in blocks.

    For each term there is an entry for each block that holds it: its greatest weight in the block, and its postings there (place in
    the block, weight). A term that many examples of a block hold has a row of weights there instead. Every Python worker holds an
    index of its own, so nothing in it is larger than the postings.
    """

    terms: np.ndarray  # the words' hashes, rising: a term is its place here
    weights: np.ndarray  # of the terms: idf times relevance
    example_ids: np.ndarray
    toxic: np.ndarray
    class_weight: np.ndarray
    settings: Settings
    counts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # (terms, counts) of the examples
    entry_of: np.ndarray = field(default=None)  # of each term: where its entries begin
    entry_block: np.ndarray = field(default=None)
    entry_most: np.ndarray = field(default=None)
    entry_row: np.ndarray = field(default=None)  # of each entry: its row in the block, -1 for postings
    posting_of: np.ndarray = field(default=None)  # of each entry: where its postings begin
    member: np.ndarray = field(default=None)
    posted: np.ndarray = field(default=None)
    place: np.ndarray = field(default=None)  # of each posting: its example
    rows: list[np.ndarray] = field(default_factory=list)  # of each block: rows x places
    room: np.ndarray = field(default=None)  # for a document's rows of a block
    steps: tuple[np.ndarray, np.ndarray] = field(default=None)

    @property
    def blocks(self) -> int:
        return max(1, math.ceil(len(self.example_ids) / self.settings.block))

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights) of length 1 from term counts: (1 + ln count) * idf * relevance. Words of no example have relevance 0."""
        w = (1 + np.log(counts)) * self.weights[terms]
        norm = math.sqrt(float(w @ w))
        return terms, w / norm if norm else w

    def fill(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Examples that share terms should share blocks: they are ordered by label and strongest term before they are cut into blocks."""
        vectors = [self.vector(*c) for c in counts]
        strongest = [int(t[w.argmax()]) if len(t) else -1 for t, w in vectors]
        order = sorted(range(len(vectors)), key=lambda i: (self.toxic[i], strongest[i], self.example_ids[i]))
        self.counts = [counts[i] for i in order]
        self.example_ids, self.toxic, self.class_weight = self.example_ids[order], self.toxic[order], self.class_weight[order]
        none = np.zeros(0, np.int64)
        term = np.concatenate([none, *(vectors[i][0] for i in order)])
        weight = np.concatenate([none.astype(float), *(vectors[i][1] for i in order)])
        place = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
        by_term = np.lexsort((place, term))
        term, place, posted = term[by_term], place[by_term], weight[by_term]
        size = self.settings.block
        block, member = place // size, place % size
        new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])[: len(term)])
        n = np.diff(np.append(new, len(term)))
        self.entry_of = np.searchsorted(term[new], np.arange(len(self.terms) + 1)).astype(np.int32)
        self.entry_block, self.entry_most = block[new].astype(np.int16), np.maximum.reduceat(posted, new) if len(new) else np.zeros(0)
        self.entry_row, self.rows = np.full(len(new), -1, np.int32), []
        for b in range(self.blocks):
            common = np.flatnonzero((self.entry_block == b) & (n * 12 > size))
            self.entry_row[common] = np.arange(len(common))
            at = spans(new[common], new[common] + n[common])
            self.rows.append(np.zeros((len(common), size)))
            self.rows[b][np.repeat(np.arange(len(common)), n[common]), member[at]] = posted[at]
        self.room = np.zeros((max(map(len, self.rows)), size))
        sparse = np.repeat(self.entry_row < 0, n)
        self.member, self.posted, self.place = member[sparse].astype(np.int32), posted[sparse], place[sparse].astype(np.int32)
        self.posting_of = np.concatenate([[0], np.cumsum(np.where(self.entry_row < 0, n, 0))]).astype(np.int32)

    def nearest(self, terms: np.ndarray, counts: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the nearest examples with a cosine above 0, best first, ties by place; exact.

        The block with the greatest upper bound is looked at first, then at once all whose bound is not below the last neighbour's cosine.
        """
        t, w = self.vector(terms, counts)
        size, most = self.settings.block, self.settings.neighbours
        places, cosines, last = np.zeros(0, np.int64), np.zeros(0), 0.0
        first, stop = self.entry_of[t], self.entry_of[t + 1]
        entries, weight = spans(first, stop), np.repeat(w, stop - first)
        block = self.entry_block[entries]
        bounds = np.bincount(block, weight * self.entry_most[entries], self.blocks)
        row = self.entry_row[entries]
        order = np.argsort(-bounds, kind="stable")
        for looked in (order[:1], order[1:]):
            looked = looked[(bounds[looked] > 0) & (bounds[looked] >= last - 1e-12)]
            if not len(looked):
                break
            chosen = np.zeros(self.blocks, bool)
            chosen[looked] = True
            sparse = np.flatnonzero(chosen[block] & (row < 0))
            begin, end = self.posting_of[entries[sparse]], self.posting_of[entries[sparse] + 1]
            at = spans(begin, end)
            cosine = np.bincount(self.place[at], np.repeat(weight[sparse], end - begin) * self.posted[at], self.blocks * size).astype(float, copy=False)
            for b in looked.tolist():
                common = np.flatnonzero((block == b) & (row >= 0))
                # into a block of memory that stays: fresh memory for each document takes longer than the rows
                held = self.rows[b].take(row[common], 0, out=self.room[: len(common)], mode="clip")
                cosine[b * size : (b + 1) * size] += weight[common] @ held
            place = np.flatnonzero((cosine > 0) & (cosine >= last - 1e-12))
            place = place[place != skip]
            places, cosines = np.concatenate([places, place]), np.concatenate([cosines, cosine[place]])
            if len(places) >= most:
                best = np.lexsort((places, -np.round(cosines, 12)))[:most]
                places, cosines = places[best], cosines[best]
                last = float(cosines[-1])
        best = np.lexsort((places, -np.round(cosines, 12)))
        return places[best], cosines[best]

    def vote(self, places: np.ndarray, cosines: np.ndarray, prior: float) -> float:
        """Share of toxic votes: each example weighs its cosine times its label's sampling weight, and the prior pulls."""
        w = cosines * self.class_weight[places]
        return float((w @ self.toxic[places] + self.settings.pull * prior) / (w.sum() + self.settings.pull))

    @property
    def prior(self) -> float:
        total = self.class_weight.sum()
        return float(self.class_weight @ self.toxic / total) if total else 0.0

    def calibrate(self) -> None:
        """Isotonic steps from the votes of each example by the others."""
        places = np.arange(len(self.example_ids))
        votes = np.array([self.vote(*self.nearest(*self.counts[i], i), self.prior) for i in places]) if len(places) else np.zeros(0)
        order = np.argsort(votes, kind="stable")
        pools: list[list[float]] = []  # vote, weight, toxic weight
        for i in order:
            pools.append([votes[i], self.class_weight[i], self.class_weight[i] * self.toxic[i]])
            while len(pools) > 1 and (pools[-2][0] == pools[-1][0] or pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]):
                _, weight, toxic = pools.pop()
                pools[-1][1] += weight
                pools[-1][2] += toxic
        self.steps = (np.array([p[0] for p in pools]), np.array([(p[2] + self.prior) / (p[1] + 1) for p in pools]))

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        places, cosines = self.nearest(terms, counts)
        vote = self.vote(places, cosines, self.prior)
        starts, rates = self.steps
        rate = rates[max(0, int(np.searchsorted(starts, vote, "right")) - 1)] if len(starts) else self.prior
        # a little of the vote itself keeps the order within a step
        return min(1.0, max(0.0, 0.99 * float(rate) + 0.01 * vote)), places, cosines


def training_rows(labels: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, toxic, total: at most settings.examples rows of each label, the least by a hash, outside the held-out fold; total counts all of the label."""
    fold = F.crc32(F.col("doc_id").cast("string")) % settings.folds
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold != 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    sizes = {row["toxic"]: row["n"] for row in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).where("toxic IN (0, 1)").collect()}
    picked = None
    for toxic in (0, 1):
        rows = usable.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(settings.examples)
        rows = rows.withColumn("total", F.lit(sizes.get(toxic, 0)).cast("long"))
        picked = rows if picked is None else picked.union(rows)
    return picked


EXAMPLES = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("total", pa.int64()), ("size", pa.int64()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
FREQUENCIES = pa.schema([("term", pa.int32()), ("n", pa.int64())])
SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("nearest", pa.list_(pa.int64())), ("cosines", pa.list_(pa.float64()))])
#: Term counts of documents whose score a worker remembers.
REMEMBERED = 2_000


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Index:
    """The index from labelled rows of docs: all terms of the chosen examples, with document frequencies over all documents.

    Of a doc_id with several texts the greatest text is the example. What comes to the driver is bounded by settings.examples and
    settings.postings: of each label the examples by their hash, as long as all distinct words together are within the bound.
    """
    texts = id_and_text(docs)
    rows = training_rows(labels, settings)
    examples = texts.join(F.broadcast(rows), "doc_id").groupBy("doc_id", "toxic", "total").agg(F.max("text").alias("text"))  # at most 2 * settings.examples ids

    def counted(batches):
        for batch in batches:
            for doc_id, toxic, total, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = Counter(words(text))
                yield batch_of(EXAMPLES, [[doc_id], [toxic], [total], [len(counts)], [list(counts)], [list(counts.values())]])

    counts = written(examples.mapInArrow(counted, "doc_id long, toxic int, total long, size long, words array<string>, counts array<long>"), "examples")
    sizes = counts.select("doc_id", "toxic", "total", "size").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").collect()  # at most 2 * settings.examples
    chosen, about = [], {}
    for toxic in (0, 1):
        held, own = 0, []
        for row in (r for r in sizes if r["toxic"] == toxic):
            held += row["size"]
            if held > settings.postings and own:
                break
            own.append(row)
        chosen += [row["doc_id"] for row in own if row["size"] <= settings.postings]
        about |= {row["doc_id"]: (toxic, row["total"] / len(own)) for row in own}
    wanted = counts.sparkSession.createDataFrame([(i,) for i in chosen], "doc_id long")
    picked = counts.join(F.broadcast(wanted), "doc_id").select("doc_id", "words", "counts").toArrow()  # at most 2 * settings.postings words
    held_words: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k in range(picked.num_rows):  # row by row: as Python strings they are many times larger
        doc_id, held, n = (picked.column(c)[k].as_py() for c in range(3))
        held_words[doc_id] = (word_hashes(held), np.array(n, float))
    del picked
    places = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in held_words.values())]))
    by_doc: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for doc_id, (hashes, n) in held_words.items():
        rising = np.argsort(hashes)
        by_doc[doc_id] = (np.searchsorted(places, hashes[rising]), n[rising])
    ids = sorted(by_doc)
    toxic = np.array([about[i][0] for i in ids], np.int64)

    def frequencies(batches):
        n, seen = 0, np.zeros(len(shared.value), np.int64)
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                at, known = known_terms(shared.value, word_hashes(set(words(text))))
                found.append(at[known])
            n += len(found)
            seen += np.bincount(np.concatenate([np.zeros(0, np.int64), *found]), minlength=len(seen))
        some = np.flatnonzero(seen)
        yield batch_of(FREQUENCIES, [np.append(some, -1), np.append(seen[some], n)])

    shared = docs.sparkSession.sparkContext.broadcast(places)  # bounded by settings.postings
    summed = texts.select("text").mapInArrow(frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    summed = summed.toArrow()  # a row a term
    shared.unpersist()
    df = np.zeros(len(places) + 1)
    df[summed.column("term").to_numpy()] = summed.column("n").to_numpy()  # the last is the number of documents
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    held = [np.bincount(np.concatenate([np.zeros(0, np.int64), *(by_doc[i][0] for i, y in zip(ids, toxic, strict=True) if y == label)]), minlength=len(places)).astype(float) for label in (1, 0)]
    weights = idf * relevance(*held, int(toxic.sum()), int((1 - toxic).sum()))
    index = Index(places, weights, np.array(ids, np.int64), toxic, np.array([about[i][1] for i in ids], float), settings)
    index.fill([by_doc[i] for i in ids])
    index.calibrate()
    index.counts = []  # only calibration needs them
    return index


class Scorer:
    def __init__(self, index: Index):
        self.index, self.known = index, {}

    def __call__(self, text: str) -> tuple[float, list[int], list[float]]:
        counted = Counter(words(text))
        at, known = known_terms(self.index.terms, word_hashes(counted))
        pairs = np.array([at[known], np.fromiter(counted.values(), np.int64, len(counted))[known]])
        pairs = pairs[:, np.argsort(pairs[0])]
        key = hashlib.blake2b(pairs.tobytes(), digest_size=16).digest()
        if key not in self.known:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            score, places, cosines = self.index.score(pairs[0], pairs[1].astype(float))
            self.known[key] = (score, self.index.example_ids[places[:3]].tolist(), np.round(cosines[:3], 6).tolist())
        return self.known[key]


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted, and as evidence the ids and cosines of the three nearest examples, for every whole text.

    The cosine is exact over the vectors of whole texts, (1 + ln count) * idf * relevance of every word; relevance is the weight of
    the labels' evidence on a word (see there), and 0 for words of no example. Null and empty texts, and those without a word of any
    example, get the score of no votes: the prior, calibrated. A null doc_id is scored and not held out. Repeated rows are all
    returned; further columns are left out. Without labels every score is 0. Very long texts are counted whole.
    Only texts enter a score; labels are learnt from the rows outside the held-out fold.
    """
    index = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, settings))  # bounded by examples and postings

    def score(batches):
        scorer = Scorer(index.value)
        for batch in batches:
            found = [scorer(t) for t in batch.column(1).to_pylist()]
            yield batch_of(SCORED, [batch.column(0), [f[0] for f in found], [int(f[0] >= 0.5) for f in found], [f[1] for f in found], [f[2] for f in found]])

    scored = id_and_text(docs).mapInArrow(score, "doc_id long, score double, predicted int, nearest array<long>, cosines array<double>")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % settings.folds == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "nearest", "cosines")


def without_toxic(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs without the rows that are predicted toxic; all columns and all other rows stay, repeated ones too.

    Null and empty texts are scored as `toxicity` says; an empty table stays empty.
    """
    index = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, settings))
    at = docs.columns.index("text")

    def keep(batches):
        scorer = Scorer(index.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer(t or "")[0] < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
