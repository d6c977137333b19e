"""Embedding near-duplicates by product quantisation: inverted lists, residual codes, table-lookup distances, exact cosine rerank."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townkit.llm.jaccard import groups_of, spanning
from townkit.llm.shared import batch_of, components, spread_join, written


@dataclass(frozen=True)
class Quantiser:
    """sample: most vectors that the centroids and codebooks are fitted on (the documented bound); lists: most inverted lists;
    parts: subspaces; codes: centroids of a subspace; rounds: of k-means; block: vectors on one side of a task.
    """

    threshold: float = 0.98
    sample: int = 20_000
    lists: int = 1_024
    a_list: int = 256
    parts: int = 8
    codes: int = 64
    rounds: int = 8
    block: int = 1_024

    @property
    def reach(self) -> float:
        """The distance of two unit vectors whose cosine is the threshold."""
        return float(np.sqrt(2 - 2 * self.threshold))

    @property
    def window(self) -> float:
        """How near the border of a list must be for a query to probe it. Two vectors on both sides of a border are at least as far apart
        as the sum of their distances to it, so of a pair within reach one has the other's list within half of it, and finds the pair."""
        return self.reach / 2


@dataclass
class Index:
    coarse: np.ndarray  # lists x dimensions
    books: list[np.ndarray]  # for each subspace: codes x its dimensions
    edges: list[int]  # where subspaces begin and end

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list of each vector, squared distances to all centroids)."""
        d = squared(x, self.coarse)
        return d.argmin(1), d

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, distance between each residual and its code word)."""
        codes, error = np.empty((len(residual), len(self.books)), np.uint8), np.zeros(len(residual))
        for s, book in enumerate(self.books):
            d = squared(residual[:, self.edges[s] : self.edges[s + 1]], book)
            codes[:, s] = d.argmin(1)
            error += d[np.arange(len(d)), codes[:, s]]
        return codes, np.sqrt(error)

    def probes(self, d: np.ndarray, reach: float) -> np.ndarray:
        """Which lists each vector probes: those whose border with the own list is within `reach`, and the own list.

        A vector y lies in list c only if it is nearer to c than to the own centroid o; the plane between them is
        (d(x, c)^2 - d(x, o)^2) / (2 |c - o|) away from x.
        """
        own = d.argmin(1)
        apart = np.sqrt(squared(self.coarse, self.coarse))[own]
        # 1e-12 is for the rounding between equal centroids
        near = d - d[np.arange(len(d)), own][:, None] <= 2 * apart * (reach + 1e-6) + 1e-12
        near[np.arange(len(d)), own] = True
        return near


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T)


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    random = np.random.Generator(np.random.PCG64(seed))
    centres = x[random.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = squared(x, centres).argmin(1)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def fit(sample: np.ndarray, lists: int, settings: Quantiser) -> Index:
    coarse = k_means(sample, lists, settings.rounds, 1)
    residual = sample - coarse[squared(sample, coarse).argmin(1)]
    edges = np.linspace(0, sample.shape[1], min(settings.parts, sample.shape[1]) + 1).astype(int).tolist()
    return Index(coarse, [k_means(residual[:, a:b], settings.codes, settings.rounds, 2 + i) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], edges)


def unusable() -> Column:
    """Whether a row cannot link: no id, label or embedding, a component that is null or not finite, or none but zeros."""
    finite = F.forall("embedding", lambda x: F.coalesce((F.abs(x) <= 1.7976931348623157e308) & ~F.isnan(x), F.lit(False)))
    some = F.exists("embedding", lambda x: x != 0)
    return ~F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & some, F.lit(False))


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, x (as doubles) and node (128 bits of a hash of label and x) of the rows that can link."""
    rows = vectors.where(~unusable()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.transform("embedding", lambda x: x.cast("double") + 0.0).alias("x")
    )
    return rows.withColumn("node", F.concat(F.hex(F.xxhash64("label", "x")), F.lit("-"), F.hex(F.xxhash64("x", "label"))))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """node, label, x, dims, weight, first_id: equal vectors of a label are one row."""
    return rows.groupBy("node").agg(F.max("label").alias("label"), F.max("x").alias("x"), F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("weight")).withColumn("dims", F.size("x"))


def matrix(column) -> np.ndarray:
    """The rows of a list column as unit vectors; scaled first, so that no square overflows or vanishes."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(1, keepdims=True))


LISTED = pa.schema([
    ("label", pa.string()), ("dims", pa.int64()), ("list", pa.int64()), ("own", pa.bool_()), ("node", pa.string()), ("weight", pa.int64()), ("x", pa.list_(pa.float64())), ("codes", pa.binary()), ("error", pa.float64()),
    ("home", pa.int64()), ("probed", pa.list_(pa.int64())),
])
LISTED_SQL = "label string, dims long, list long, own boolean, node string, weight long, x array<double>, codes binary, error double, home long, probed array<long>"
FOUND = pa.schema([("a", pa.string()), ("links", pa.int64()), ("b", pa.string())])


def near_duplicates(vectors: DataFrame, settings: Quantiser = Quantiser()) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label).

    Rows of equal, not null labels link if their cosine in double precision is at least the threshold. A null, empty or zero vector,
    one with null or non-finite components, or of another length than the others, links with nothing of other lengths; rows without
    links have 0 links and are their own component. A null vec_id is returned with a null component. Repeated vec_ids are rows that
    link like others. Further columns are left out; an empty table gives an empty result.

    Equal vectors of a label are one node with a weight. Coarse lists and codebooks are fitted on at most settings.sample vectors;
    every vector is indexed and is a query. A query probes its own list and those with a near border (see window), looks up code
    distances there, drops what is further than the threshold plus the code's own error (which loses nothing), and reranks the rest by
    exact cosine. Large lists are cut into blocks: a task sees two blocks at most, and returns sums and a spanning forest, not pairs.
    """
    spark = vectors.sparkSession
    rows = usable_vectors(vectors)
    nodes = written(distinct_vectors(rows), "vectors")
    n, reach = nodes.count(), settings.reach
    indexes: dict[int, Index] = {}
    lengths = [row["dims"] for row in nodes.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").limit(16).select("dims").collect()]
    for dims in lengths:
        sampled = nodes.where(F.col("dims") == dims).orderBy("node").limit(settings.sample).select("x").toArrow()  # nodes are hashes
        sample = matrix(sampled.column(0).combine_chunks())
        indexes[dims] = fit(sample, int(min(settings.lists, max(1, n // settings.a_list))), settings)
    shared = spark.sparkContext.broadcast(indexes)  # at most 16 * (lists + parts * codes) vectors

    def place(batches):
        for batch in batches:
            dims = np.asarray(batch.column("dims"))
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                x = matrix(part.column("x"))
                if d not in shared.value:  # rare lengths are one list each
                    home = at = np.zeros(len(x), int)
                    of, own = np.arange(len(x)), np.ones(len(x), bool)
                    codes, error = np.zeros((len(x), 1), np.uint8), np.full(len(x), 4.0)
                else:
                    index = shared.value[d]
                    home, distances = index.nearest(x)
                    of, at = np.nonzero(index.probes(distances, settings.window))
                    own = home[of] == at
                    codes, error = index.encode(x - index.coarse[home])
                coded = [codes[k].tobytes() for k in range(len(x))]
                probed = np.split(at, np.flatnonzero(np.diff(of)) + 1)
                take = pa.array(of)
                yield batch_of(LISTED, [part.column("label").take(take), part.column("dims").take(take).cast(pa.int64()), at, own, part.column("node").take(take), part.column("weight").take(take), part.column("x").take(take), [coded[k] for k in of], error[of], home[of], [probed[k] for k in of]])

    listed = written(nodes.select("node", "label", "dims", "x", "weight").mapInArrow(place, LISTED_SQL), "lists")
    sizes = listed.groupBy("label", "dims", "list").agg(F.ceil(F.sum(F.col("own").cast("long")) / settings.block).alias("blocks"), F.ceil(F.count(F.lit(1)) / settings.block).alias("sides"), F.count(F.lit(1)).alias("rows")).where("blocks > 0")
    dealt = spread_join(listed, written(sizes, "list-sizes"), ["label", "dims", "list"], "rows")
    # the stored side is cut into blocks, each of which meets every block of queries
    stored = dealt.where("own").select("*", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("i"), F.explode(F.expr("sequence(0L, sides - 1)")).alias("j"), F.lit(False).alias("query"))
    asked = dealt.select("*", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("i"), F.pmod(F.xxhash64("node"), F.col("sides")).alias("j"), F.lit(True).alias("query"))
    columns = ["label", "dims", "list", "i", "j", "query", "node", "weight", "x", "codes", "error", "home", "probed"]
    cells = stored.select(columns).union(asked.select(columns)).repartition("label", "dims", "list", "i", "j").sortWithinPartitions("label", "dims", "list", "i", "j", "node")

    def search(batches):
        for table in groups_of(batches, 5):
            table = table.combine_chunks()
            query = np.asarray(table.column("query"))
            y, q = table.filter(pa.array(~query)), table.filter(pa.array(query))
            if not y.num_rows or not q.num_rows:
                continue
            yx, qx = matrix(y.column("x").combine_chunks()), matrix(q.column("x").combine_chunks())
            near = np.ones((len(qx), len(yx)), bool)
            index = shared.value.get(table.column("dims")[0].as_py())
            if index is not None:
                # asymmetric distances: whole queries against coded vectors
                residual, codes = qx - index.coarse[table.column("list")[0].as_py()], np.frombuffer(b"".join(y.column("codes").to_pylist()), np.uint8).reshape(len(yx), -1)
                coded = np.zeros((len(qx), len(yx)))
                for s, book in enumerate(index.books):
                    coded += squared(residual[:, index.edges[s] : index.edges[s + 1]], book)[:, codes[:, s]]
                near = np.sqrt(coded) <= reach + np.asarray(y.column("error")) + 1e-6
            linked = np.zeros(near.shape, bool)
            for k in np.flatnonzero(near.any(1)):
                some = np.flatnonzero(near[k])
                linked[k, some] = (yx[some] * qx[k]).sum(1) >= settings.threshold
            qid, yid = np.array(q.column("node").to_pylist()), np.array(y.column("node").to_pylist())
            linked &= qid[:, None] != yid
            # a query counts its links; a stored vector counts them too where it does not itself probe the query's list
            links = linked @ np.asarray(y.column("weight"))
            home, probed = np.asarray(q.column("home")), y.column("probed").to_pylist()
            asks = np.zeros((len(yx), 1 + max(int(home.max()), *map(max, probed))), bool)
            asks[np.repeat(np.arange(len(yx)), [len(c) for c in probed]), np.concatenate(probed)] = True
            back = (linked & ~asks[:, home].T).T @ np.asarray(q.column("weight"))
            # members of both sides, one number each
            ids, place = np.unique(np.concatenate([qid, yid]), return_inverse=True)
            root = spanning(linked, place[: len(qid)], place[len(qid) :], len(ids))
            some = np.flatnonzero(links)
            yield batch_of(FOUND, [qid[some], links[some], ids[root[place[some]]]])
            some = np.flatnonzero(linked.any(0))
            yield batch_of(FOUND, [yid[some], back[some], ids[root[place[len(qid) + some]]]])

    # both sides' trees join the components
    found = written(cells.mapInArrow(search, "a string, links long, b string"), "vector-links")
    grouped = components(found.select("a", "b")).withColumnRenamed("component", "group")
    counted = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    named = nodes.select("node", "first_id", "weight").join(counted, "node", "left").join(grouped, "node", "left").withColumn("group", F.coalesce("group", "node"))
    named = written(named.select("node", "group", "first_id", "weight", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "vector-groups")
    least = written(named.groupBy("group").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("size")), "vector-firsts")
    named = written(spread_join(named, least, ["group"], "size").select("node", "component_id", "n_links", "weight"), "vector-nodes")
    # rows that cannot link have no node
    keyed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    keyed = spread_join(usable_vectors(keyed).select("vec_id", "node"), named, ["node"], "weight").select("vec_id", "n_links", "component_id")
    rest = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), unusable().alias("out")).where("out").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return keyed.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
