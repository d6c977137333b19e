import numpy as np
import pytest

from townkit.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, node string, x string"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, l, "n", "x") for i, e, l in rows], SCHEMA).repartition(3)


def brute(rows, threshold=0.98):
    def unit(e):
        if not e or any(v is None or not np.isfinite(v) for v in e) or not any(e):
            return None
        v = np.array(e, np.float32).astype(float)
        return v / np.sqrt(v @ v)

    units = [unit(e) if label is not None and i is not None else None for i, e, label in rows]
    n = len(rows)
    links = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and (rows[i][1] == rows[j][1] or units[i] @ units[j] >= threshold)] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(links[i]), min(ids) if ids else None))
    return sorted(map(repr, out))


def some_rows():
    r = np.random.Generator(np.random.PCG64(1))
    centres = r.normal(size=(12, 16))
    rows = [(1000 - i, (centres[i % 12] + r.normal(size=16) * (0.02 + 0.1 * (i % 3))).astype(np.float32).tolist(), int(i % 12) % 3) for i in range(260)]
    rows += [(2000 + i, rows[0][1], rows[0][2]) for i in range(20)] + [(2100 + i, rows[0][1], 2) for i in range(2)]
    return rows


@pytest.mark.parametrize("block", [1024, 7])
def test_against_brute_force(spark, block):
    rows = some_rows()
    settings = vectors.Quantiser(lists=16, a_list=10, parts=4, codes=8, block=block)
    found = vectors.near_duplicates(frame(spark, rows), settings).collect()
    assert sorted(repr((x["vec_id"], x["n_links"], x["component_id"])) for x in found) == brute(rows)
    assert all(x["kept"] == (x["vec_id"] == x["component_id"]) for x in found)


def test_by_shuffles(spark, shuffles):
    rows = some_rows()
    found = vectors.near_duplicates(frame(spark, rows), vectors.Quantiser(lists=16, a_list=10, parts=4, codes=8)).collect()
    assert sorted(repr((x["vec_id"], x["n_links"], x["component_id"])) for x in found) == brute(rows)


def test_awkward_vectors(spark):
    a, b = [1.0, 0.0, 0.5], [1.0, 0.01, 0.5]
    rows = [
        (1, a, 0), (2, b, 0), (3, a, 1), (4, None, 0), (5, [], 0), (6, [0.0, 0.0, 0.0], 0), (7, [1.0, None, 0.5], 0), (8, [float("nan"), 0.0, 1.0], 0), (9, [float("inf"), 0.0, 1.0], 0), (10, a, None),
        (11, [1.0, 0.0], 0), (12, [1.0, 0.0], 0), (13, [1e-30, 0.0, 5e-31], 0), (14, [1e30, 0.0, 5e29], 0), (15, [-0.0, 1.0, 0.0], 2), (16, [0.0, 1.0, 0.0], 2), (17, a, 0), (17, a, 0),
    ]
    found = vectors.near_duplicates(frame(spark, rows)).collect()
    assert sorted(repr((x["vec_id"], x["n_links"], x["component_id"])) for x in found) == brute(rows)
    found = vectors.near_duplicates(frame(spark, [(None, a, 0), (1, a, 0)])).collect()
    assert sorted(repr((x["vec_id"], x["n_links"], x["component_id"], x["kept"])) for x in found) == sorted(map(repr, [(None, 0, None, False), (1, 0, 1, True)]))
    assert vectors.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_probes_hold_every_near_vector():
    r = np.random.Generator(np.random.PCG64(2))
    x = r.normal(size=(400, 8))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    index = vectors.fit(x, 20, vectors.Quantiser(parts=4, codes=8))
    home, distances = index.nearest(x)
    probes = index.probes(distances, 0.5)
    near = np.sqrt(vectors.squared(x, x)) <= 0.5
    assert all(probes[i, home[j]] for i, j in zip(*np.nonzero(near), strict=True))
    codes, error = index.encode(x - index.coarse[home])
    words = np.concatenate([book[codes[:, s]] for s, book in enumerate(index.books)], 1)
    assert np.allclose(np.sqrt(((x - index.coarse[home] - words) ** 2).sum(1)), error)


@pytest.mark.parametrize(("dims", "rank"), [(768, 8), (64, 2)])
def test_low_rank_vectors_lose_no_pair(spark, dims, rank):
    """Differences that point in a few of many dimensions cross borders far off."""
    r = np.random.Generator(np.random.PCG64(3))
    plane = np.linalg.qr(r.normal(size=(dims, rank)))[0].T
    x = r.normal(size=(600, rank))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    side = r.normal(size=(600, rank))
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.sqrt((side * side).sum(1, keepdims=True))
    both = (np.concatenate([x, 0.983 * x + (1 - 0.983**2) ** 0.5 * side]) @ plane).astype(np.float32)
    unit = both.astype(float) / np.sqrt((both.astype(float) ** 2).sum(1, keepdims=True))
    expected = ((unit @ unit.T) >= 0.98).sum(1) - 1
    df = spark.createDataFrame([(i, e, 0, "n", "x") for i, e in enumerate(both.tolist())], SCHEMA).repartition(3)
    found = {row["vec_id"]: row["n_links"] for row in vectors.near_duplicates(df, vectors.Quantiser(a_list=15)).collect()}
    assert [found[i] for i in range(len(both))] == expected.tolist()
