"""Matches in blocks: what copies and hopeless pairs cost, and the results against all pairs."""

from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from townkit.operators import matching


@pytest.fixture
def measured(spark, monkeypatch):
    """How many pairs the ratio was asked for."""
    count = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def counting(a: pd.Series, b: pd.Series) -> pd.Series:
        count.add(len(a))
        return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    monkeypatch.setattr(matching, "ratio", counting)
    return count


def test_copies_of_names_are_measured_once_a_block(spark, measured):
    names = ["red ring", "red rings", "blue bolt", "green gear"]
    rows = spark.range(4_000).select("id", F.element_at(F.array(*map(F.lit, names)), (F.col("id") % 4 + 1).cast("int")).alias("n"), F.lit("b").alias("block"))
    asked, stored = rows.where("id % 8 < 4").selectExpr("id AS candidate", "n AS name", "block"), rows.where("id % 8 >= 4 AND n <> 'red ring'").selectExpr("id AS match", "n AS stored_name", "block")
    found = {r["candidate"]: (r["match"], round(r["score"], 3)) for r in matching.ratio_matches(asked, stored, "block", 0.55).collect()}
    assert len(found) == 2_000 and found[8] == (5, round(16 / 17, 3)) and found[9] == (5, 1.0) and found[10] == (6, 1.0)
    assert 0 < measured.value <= 16 * 3


def test_words_of_copies_are_compared_once_a_block(spark):
    rows = spark.range(40_000).select("id", F.element_at(F.array(*map(F.lit, ("red ring", "red bolt"))), (F.floor(F.col("id") / 2) % 2 + 1).cast("int")).alias("n"), F.lit("b").alias("block"))
    asked, stored = rows.where("id % 2 = 0").selectExpr("id AS candidate", "n AS name", "block"), rows.where("id % 2 = 1 AND n = 'red bolt'").selectExpr("id AS match", "n AS stored_name", "block")
    pairs = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(a, b):
        pairs.add(1)
        return 0.5

    found = {(r["match"], r["score"]) for r in matching.block_matches(asked, stored, "block", 0.3, counted("name", "stored_name")).collect()}
    assert found == {(3, 0.5), (3, 1.0)} and pairs.value <= 8  # a plan may ask twice


def similarity(a, b):
    return SequenceMatcher(None, a, b).ratio()


def rare_names(n, seed, letters="abc d", longest=9):
    """Names of few letters, so that they are alike in all degrees; some empty, some null."""
    import random

    draw = random.Random(seed)
    return [None if i % 17 == 16 else "".join(draw.choice(letters) for _ in range(draw.randint(0, longest))) for i in range(n)]


def test_addresses_against_all_pairs_and_their_cost(spark, measured):
    names, kept = rare_names(60, 1), rare_names(60, 2)
    codes = ["A", "B", "", None]
    plain = lambda x: " ".join(w for w in (x or "").split() if w != "a")
    expected = {}
    for i, name in enumerate(names):
        code = codes[i % 4]
        near = [(j, plain(k)) for j, k in enumerate(kept) if codes[j % 4] == code]
        exact = min((j for j, k in near if k == plain(name)), default=None)
        like = any(similarity(plain(name), k) >= 0.55 for _, k in near)
        expected[i] = (None, "none") if not code else (exact, "exact") if exact is not None else (None, "unsure" if like else "new")
    items, venues = spark.createDataFrame([(i, x, codes[i % 4]) for i, x in enumerate(names)], "item int, name string, postcode string"), spark.createDataFrame([(j, x, codes[j % 4]) for j, x in enumerate(kept)], "venue_id int, venue_name string, postcode string")
    assert {r["item"]: (r["venue_id"], r["outcome"]) for r in matching.resolve(items, venues).collect()} == expected
    before = measured.value
    many = spark.range(2_000)
    items, venues = many.selectExpr("id AS item", "concat('customer ', lpad(id, 9, '0'), ' annex') AS name", "'A' AS postcode"), many.selectExpr("id AS venue_id", "concat('customer ', lpad(id, 9, '0')) AS venue_name", "'A' AS postcode")
    assert {r["outcome"] for r in matching.resolve(items, venues).collect()} == {"unsure"}
    assert measured.value - before <= 4 * 2_000


def test_reference_matches_against_all_pairs(spark):
    names, kept = rare_names(80, 3, "bc", 12), rare_names(80, 4, "bc", 12)
    place = lambda i: (51.0 + i % 3 * 0.0006, -1.0 + i % 2 * 0.0008)
    codes = ["A", "B", None]
    asked = [(i, x, codes[i % 3], *place(i)) for i, x in enumerate(names)]
    stored = [(j, x, codes[j // 3 % 3], *place(j // 7)) for j, x in enumerate(kept)]
    a, b = spark.createDataFrame(asked, "candidate int, name string, postcode string, lat double, lng double"), spark.createDataFrame(stored, "match int, stored_name string, postcode string, lat double, lng double")
    from townkit.functions import geo

    metres = {(r["candidate"], r["match"]): r["m"] for r in a.crossJoin(b.select("match", F.col("lat").alias("y"), F.col("lng").alias("x"))).select("candidate", "match", geo.haversine(F.col("lat"), F.col("lng"), F.col("y"), F.col("x"), matching.METRES).alias("m")).collect()}
    expected = {}
    for i, name, code, *_ in asked:
        ranked = []
        for j, other, theirs, *_ in stored:
            if name is None or other is None:
                continue
            r, same = similarity(name, other), code is not None and code == theirs
            if same and name == other:
                ranked.append((0, -1.0, j, "exact"))
            elif same and r >= 0.86:
                ranked.append((1, -min(0.99, 0.78 + 0.2 * r), j, "postcode_fuzzy_name"))
            elif metres[i, j] <= 80 and r >= 0.75:
                ranked.append((1, -min(0.97, 0.72 + 0.2 * r), j, "near_name"))
        if ranked:
            _, c, j, method = min(ranked)
            expected[i] = (j, method, round(-c, 9))
    assert {r["candidate"]: (r["match"], r["method"], round(r["confidence"], 9)) for r in matching.reference_matches(a, b).collect()} == expected
    assert {m for _, m, _ in expected.values()} == {"exact", "near_name", "postcode_fuzzy_name"}


def test_reference_matches_measure_only_what_may_be_best(spark, measured):
    names = spark.range(1_000).selectExpr("id", "concat('customer ', lpad(id, 9, '0')) AS n", "51.0D AS lat", "-1.0D AS lng")
    a, b = names.selectExpr("id AS candidate", "if(id % 2 = 0, n, concat(n, ' annex')) AS name", "'A' AS postcode", "lat", "lng"), names.selectExpr("id AS match", "n AS stored_name", "'A' AS postcode", "lat", "lng")
    found = matching.reference_matches(a, b).collect()
    assert len(found) == 1_000 and all(r["candidate"] == r["match"] for r in found)
    assert measured.value <= 20_000


def test_discovered_spots_against_all_pairs(spark, measured):
    names, kept = rare_names(60, 5, "bc", 8), rare_names(60, 6, "bc", 8)
    place = lambda i: (51.0 + i % 5 * 0.0008, -1.0)
    rows = [(i, x, "A" if i % 9 == 0 else None, *place(i), *((51.0, 51.001, -1.1, -0.9) if i % 3 == 0 else (None,) * 4)) for i, x in enumerate(names)]
    a = spark.createDataFrame(rows, "candidate int, name string, postcode string, lat double, lng double, south double, north double, west double, east double")
    b = spark.createDataFrame([(j, x, "A", *place(j // 2)) for j, x in enumerate(kept)], "match int, stored_name string, postcode string, lat double, lng double")
    sure = {r["candidate"]: r["match"] for r in matching.reference_matches(a, b).collect()}
    expected = {}
    for i, name, _, lat, _, south, north, *_ in rows:
        found = []
        for j, other in enumerate(kept):
            if name is None or other is None:
                continue
            y, r = place(j // 2)[0], similarity(name, other)
            inside = south is not None and south <= y <= north
            if inside and r >= 0.75:
                found.append((-2, -r, j))
            elif (inside or abs(y - lat) * 111_195 <= 150) and r >= 0.55:
                found.append((-1, -r, j))
        rank, _, match = min(found, default=(0, 0, None))
        expected[i] = (sure.get(i, match), "existing" if i in sure or rank == -2 else "possible" if rank == -1 else "new")
    assert {r["candidate"]: (r["match"], r["outcome"]) for r in matching.discovery_matches(a, b).collect()} == expected
    assert {o for _, o in expected.values()} == {"existing", "possible", "new"}
    before = measured.value
    spots = spark.range(400).selectExpr("id AS candidate", "concat('customer ', lpad(id, 9, '0')) AS name", "'A' AS postcode", "51.0D AS lat", "-1.0D AS lng", "50.9D AS south", "51.1D AS north", "-1.1D AS west", "-0.9D AS east")
    assert matching.discovery_matches(spots, spots.selectExpr("candidate AS match", "name AS stored_name", "postcode", "lat", "lng")).where("candidate = match AND outcome = 'existing'").count() == 400
    assert measured.value == before


def test_greedy_pairs_of_names_are_those_of_rows(spark):
    from townkit.functions import text

    names = ["red ring", "red bolt", "blue bolt", "old blue ring", "gear", None]
    rows = [(f"b{i % 2}", i, names[i * i % 7 % 6]) for i in range(90)]
    a, b = spark.createDataFrame([r for r in rows if r[1] % 3], "block string, left int, name string"), spark.createDataFrame([r for r in rows if r[1] % 3 == 0], "block string, right int, stored_name string")
    score = text.jaccard(F.split("name", " "), F.split("stored_name", " "))
    expected = matching.greedy_pairs(a.join(b, "block").withColumn("score", score).where("score > 0"), "block")
    found = matching.greedy_named_pairs(a, b, "block", score)
    assert found.columns == expected.columns and sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_greedy_pairs_of_many_copies_make_no_row_a_pair(spark):
    a, b = spark.range(30_000).selectExpr("'b' AS block", "id * 2 AS left", "'red ring' AS name"), spark.range(30_000).selectExpr("'b' AS block", "id * 2 + 1 AS right", "'red ring' AS stored_name")
    assert matching.greedy_named_pairs(a, b, "block", F.lit(0.5)).where("right = left + 1").count() == 30_000


def test_identifiers_against_all_pairs(spark):
    from townkit.functions import geo

    kinds = [["a"], ["b"], ["a", "b"], None]
    rows = [(i, None if i % 11 == 10 else i % 4, None if i % 13 == 12 else 51 + i % 5 * 0.01, -1.0, kinds[i % 7 % 4]) for i in range(60)]
    a = spark.createDataFrame(rows, "candidate int, link int, lat double, lng double, types array<string>")
    b = spark.createDataFrame([(*r, r[0] % 3 == 0 if r[0] % 8 else None) for r in rows if r[0] % 5 == 1], "match int, link int, lat double, lng double, types array<string>, closed boolean")
    pairs = a.join(b.selectExpr("match", "link", "lat AS la", "lng AS lo", "types AS t", "closed"), "link")
    metres = geo.haversine(F.col("lat"), F.col("lng"), F.col("la"), F.col("lo"), matching.METRES)
    reason = F.when(F.col("closed"), "closed").when(~F.arrays_overlap("types", "t"), "type").when(metres > 1_500, "far")
    expected = {i: ("no_match", None, "") for i, *_ in rows}
    judged = {}
    for r in pairs.select("candidate", "match", reason.alias("reason")).collect():
        judged.setdefault(r["candidate"], []).append((r["match"], r["reason"]))
    for i, met in judged.items():
        good = [m for m, why in met if why is None]
        expected[i] = ("matched" if len(good) == 1 else "ambiguous" if good else "review", good[0] if len(good) == 1 else None, ",".join(sorted({why for _, why in met if why})))
    assert {r["candidate"]: (r["outcome"], r["match"], r["rejected"]) for r in matching.identifier_matches(a, b, 1_500.0).collect()} == expected
    assert {o for o, *_ in expected.values()} == {"no_match", "matched", "ambiguous", "review"}


def test_equal_places_of_an_identifier_are_asked_once(spark):
    a = spark.range(40_000).selectExpr("id AS candidate", "1 AS link", "51.0D + id % 2 AS lat", "-1.0D AS lng", "array('a') AS types")
    b = a.selectExpr("candidate AS match", "link", "lat", "lng", "types", "candidate % 5 = 0 AS closed")
    found = matching.identifier_matches(a, b).groupBy("outcome", "match", "rejected").count().collect()
    assert [tuple(r) for r in found] == [("ambiguous", None, "closed,far", 40_000)]


def test_different_names_meet_by_their_words_only(spark, monkeypatch):
    """Against all pairs; names of words that few share make few pairs, where all pairs of the block were compared."""
    import random

    draw = random.Random(8)
    deal = lambda n: [None if i % 19 == 18 else " ".join(draw.choice("abcdefgh") for _ in range(draw.randint(0, 6))) for i in range(n)]
    names, kept = deal(90), deal(90)
    alike = lambda x, y: len(set(x.split(" ")) & set(y.split(" "))) / len(set(x.split(" ")) | set(y.split(" ")))
    for least in (0.3, 0.5, 1.0):
        expected = {}
        for i, name in enumerate(names):
            found = [(-alike(name, other), j) for j, other in enumerate(kept) if name is not None and other is not None and j % 3 == i % 3 and alike(name, other) >= least]
            if found:
                expected[i] = (min(found)[1], -min(found)[0])
        a, b = spark.createDataFrame([(i, x, i % 3) for i, x in enumerate(names)], "candidate int, name string, block int"), spark.createDataFrame([(j, x, j % 3) for j, x in enumerate(kept)], "match int, stored_name string, block int")
        assert {r["candidate"]: (r["match"], r["score"]) for r in matching.token_matches(a, b, "block", least).collect()} == expected
    pairs, plain = spark.sparkContext.accumulator(0), matching.text.jaccard

    @F.udf("array<string>", useArrow=False)
    def counted(words):
        pairs.add(1)
        return words

    monkeypatch.setattr(matching.text, "jaccard", lambda x, y: plain(counted(x), y))
    rows = spark.range(2_000)
    a, b = rows.selectExpr("id AS candidate", "concat('w', id DIV 2, ' of left ', id) AS name", "'b' AS block"), rows.selectExpr("id AS match", "concat('w', id DIV 2, ' of right ', id) AS stored_name", "'b' AS block")
    found = {r["candidate"]: r["match"] for r in matching.token_matches(a, b, "block", 0.5).collect()}
    assert len(found) == 2_000 and found[7] == 7 and pairs.value <= 40_000  # all pairs are 4,000,000


def test_only_places_close_by_are_measured_in_metres(spark, monkeypatch):
    """Places of one cell of the grid that lie apart: before, each met all others of the cell."""
    pairs, plain = spark.sparkContext.accumulator(0), matching.metres_apart

    @F.udf("double", useArrow=False)
    def counted(metres):
        pairs.add(1)
        return metres

    monkeypatch.setattr(matching, "metres_apart", lambda: counted(plain()))
    rows = spark.range(225).selectExpr("id", "concat('place ', id) AS n", "51.0D + id DIV 15 * 0.0025D AS lat", "-1.0D + id % 15 * 0.004D AS lng")
    a, b = rows.selectExpr("id AS candidate", "n AS name", "'A' AS postcode", "lat", "lng"), rows.selectExpr("id AS match", "n AS stored_name", "'B' AS postcode", "lat", "lng")
    found = matching.reference_matches(a, b).collect()
    assert len(found) == 225 and all(r["candidate"] == r["match"] and r["method"] == "near_name" for r in found)
    assert pairs.value <= 225 * 8
