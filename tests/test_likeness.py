import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from townkit.operators import joins, likeness

WORDS = ["story", "time", "the hall", "park", "fun", "ab", "castle", "oak", "st", "art club", "x", "music day", "aa", "aaa"]


def names(n, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        s = " ".join(r.choice(WORDS) for _ in range(r.randint(1, 5)))
        for _ in range(r.choice([0, 0, 1, 2])):
            i = r.randrange(len(s) + 1)
            s = s[:i] + r.choice("aeot ") + s[i + r.randint(0, 1) :]
        out.append(s.strip() or None)
    return [*out, "", None]


@pytest.mark.parametrize(("threshold", "small"), [(0.85, True), (0.8, False)])
def test_as_all_pairs(spark, threshold, small, monkeypatch):
    if not small:
        monkeypatch.setattr(joins, "BROADCAST_BYTES", -1)
    a, b = list(enumerate(names(120, 1))), list(enumerate(names(120, 2)))
    expected = set()
    for i, x in a:
        for j, y in b:
            if x and y:
                contained = len(min(x, y, key=len)) >= 6 and (x in y or y in x)
                if x == y or contained or SequenceMatcher(None, x, y).ratio() >= threshold:
                    expected.add((i, j, "equal" if x == y else "within" if contained else "alike"))
    frame = lambda rows: spark.createDataFrame(rows, "id int, name string").repartition(3)
    found = likeness.same_names(frame(a), frame(b), threshold)
    assert {(r["left"], r["right"], r["kind"]) for r in found.collect()} == expected and {k for *_, k in expected} == {"equal", "within", "alike"}
    assert found.count() == len(expected)
    plan = found._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert likeness.same_names(frame(a).limit(0), frame(b)).count() == 0


@pytest.mark.parametrize(
    ("key", "expected", "row", "ok"),
    [
        ("start_date", "2024-05-01", {"start_date": "2024-05-01T10:00"}, True), ("start_date", None, {"start_date": None}, True), ("start_date", None, {"start_date": "2024-05-01"}, False),
        ("postcode", "ab1 2cd", {"postcode": None, "location": "Hall, AB12CD"}, True), ("postcode", "AB1 2CD", {"postcode": "AB1 2CE"}, False),
        ("title", "Story time at the park", {"title": "Story Time"}, True), ("title", "Story time", {"title": "Story tome"}, True), ("title", "Story", {"title": "History park"}, False),
        ("venue_name", "Town Hall", {"venue_name": None, "location": "The Town Hall, High St"}, True), ("age_range", "4 years to 12 years", {"age_range": "4-12"}, True), ("age_range", "all", {"age_range": "all"}, False),
        ("event_url", "https://A.org/x/?p=1", {"event_url": "https://a.org/x#top"}, True), ("event_url", "https://a.org/x", {"event_url": "https://a.org/y"}, False),
        ("cost_text", "Free!", {"cost_text": "free"}, True), ("cost_text", "Free", {}, False),
    ],
)
def test_fields(spark, key, expected, row, ok):
    columns = {k: F.lit(v).cast("string") for k, v in row.items()}
    assert spark.range(1).select(likeness.field_agrees(key, F.lit(expected).cast("string"), columns).alias("v")).collect()[0]["v"] is ok


def test_long_names_do_not_stand_beside_each_of_their_pieces(spark, monkeypatch):
    held, plain = [], likeness.written

    def counting(df, name):
        out = plain(df, name)
        held.append(out.agg(F.sum(sum((F.octet_length(c) for c, kind in out.dtypes if kind == "string"), F.lit(0)))).collect()[0][0] or 0)
        return out

    monkeypatch.setattr(likeness, "written", counting)
    letters = "".join(chr(97 + k * k % 23 % 17) + chr(97 + k * 7 % 26) for k in range(1_500))
    short = spark.createDataFrame([(letters[k : k + 40],) for k in range(0, 2_000, 200)], "name string").distinct()
    long = spark.createDataFrame([(f"{k} {letters}",) for k in range(20)], "name string")
    names = {r["name"] for r in short.collect()}
    assert likeness.within(short, long).count() == 20 * len(names) and likeness.within(long, short).count() == 0
    assert sum(held) < 2_000_000  # 20 names of 3,000 letters beside each piece are 180 MB
