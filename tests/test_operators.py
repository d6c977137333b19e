"""Operators on small fixtures: order independence, one-field changes, borders, and failure states."""

import random
import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from townkit.operators import eligibility, feeds, graph, identity, matching, merge, paging, ranking, schedule, views


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


# paging


@pytest.mark.parametrize(("radius", "scope", "lat", "lng"), [(0, "local", 1, 1), (float("nan"), "local", 1, 1), (101, "local", 1, 1), (5, "all", 1, 1), (5, "local", 1, None), (5, "unknown", None, None), (5, "local", 91, 0)])
def test_scope_is_checked(radius, scope, lat, lng):
    with pytest.raises(ValueError):
        paging.check_scope(radius, scope, lat, lng)


def test_radius_border_and_unknown(spark):
    km = 6371.0
    degrees = lambda d: d / km * 180 / 3.141592653589793
    rows = spark.createDataFrame([(1, "a", degrees(9.999), 0.0), (2, "b", degrees(10.001), 0.0), (3, "c", 200.0, 0.0), (4, "d", None, None)], "id int, name string, lat double, lng double")
    assert rows_of(paging.within_scope(rows, 10, "local", 0.0, 0.0), "id") == [(1,)]
    assert rows_of(paging.within_scope(rows, 10, "unknown", 0.0, 0.0), "id") == [(3,), (4,)]
    assert paging.within_scope(rows, 10, "local", None, None).count() == 4


def test_nearest_pruned_is_nearest(spark):
    rows = spark.range(300).selectExpr("id", "concat('n', id) AS name", "50 + (id * 37 % 100) / 10D AS lat", "-5 + (id * 53 % 100) / 10D AS lng")
    assert paging.nearest_pruned(rows, 53.0, -1.0, 7).collect() == paging.nearest(rows, 53.0, -1.0, 7).collect()


def test_page_is_clamped(spark):
    rows = spark.range(100).withColumn("name", F.lit("x"))
    assert [r["id"] for r in paging.page(rows, [F.col("id")], -5, 500).collect()] == list(range(48))
    assert paging.has_more(rows, [F.col("id")], 99)[1] and not paging.has_more(rows, [F.col("id")], 100)[1]


# identity and deduplication


def listing(spark, **change):
    row = {"kind": "event", "title": "The Fair", "url": "https://a.org/x/", "start": date(2024, 5, 1), "venue_id": 4, "postcode": None, "venue_name": None} | change
    df = spark.createDataFrame([tuple(row.values())], "kind string, title string, url string, start date, venue_id long, postcode string, venue_name string")
    return df.select(identity.identity_key(*map(F.col, row)).alias("k")).collect()[0]["k"]


def test_identity_changes_with_one_field(spark):
    base = listing(spark)
    assert listing(spark, title="Other") == base  # an event with a url is told by that
    assert listing(spark, url="HTTPS://A.org/x#top") == base
    for change in ({"url": "https://a.org/y"}, {"start": date(2024, 5, 2)}, {"venue_id": 5}, {"kind": "activity"}):
        assert listing(spark, **change) != base
    activity = listing(spark, kind="activity")
    assert listing(spark, kind="activity", start=date(2030, 1, 1), url=None) == activity
    assert listing(spark, kind="activity", title="the FAIR!") == activity
    assert listing(spark, url="", title="A") != listing(spark, url="", title="B")


def test_keep_first_fill(spark):
    rows = spark.createDataFrame([("a", 2, "late", None, 5), ("a", 1, None, "p", 3), ("a", 3, "last", "q", 9), ("b", 4, None, None, 1)], "key string, seq int, x string, y string, seen int")
    found = identity.keep_first_fill(rows, ["key"], "seq", ("seen",))
    assert rows_of(found, "key", "seq", "x", "y", "seen") == [("a", 1, "late", "p", 9), ("b", 4, None, None, 1)]


def test_near_titles_finds_all_pairs(spark):
    import random

    random.seed(5)
    words = [f"w{i}" for i in range(25)]
    data = [(i, sorted(random.sample(words, random.randint(3, 8)))) for i in range(120)]
    found = rows_of(identity.near_titles(spark.createDataFrame(data, "id long, words array<string>"), 0.5), "first_id", "id")
    brute = [(i, j) for i, a in data for j, b in data if i < j and len(a) >= 4 and len(b) >= 4 and len({*a} & {*b}) / len({*a} | {*b}) >= 0.5]
    assert found == sorted(brute)


COHORT = [
    (1, "Summer Science Fair for Kids", "Town Hall", "2024-05-01"),
    (2, "Summer Science Fair for the Kids", "The Town Hall", "2024-05-01"),
    (3, "Summer Science Fair for Kids", "Town Hall", "2024-05-02"),
    (4, "Winter Science Fair for Kids", "Castle", "2024-05-01"),
]


def test_fuzzy_fold(spark):
    def fold(rows):
        df = spark.createDataFrame(rows, "id long, title string, venue_name string, start string")
        return rows_of(identity.fuzzy_fold(df, ["start"], ["id"]), "id", "merged")

    expected = [(2, [1]), (3, []), (4, [])]
    assert fold(COHORT) == fold(COHORT[::-1]) == expected


def folded_by_hand(rows):
    """From the rule on raw strings: (id, merged) of the survivors of rows (id, title, venue, start, url, venue_id, camp, programme)."""

    def plain(s):
        s = re.sub(r"[^a-z0-9]+", " ", (s or "").lower().replace("&", " and "))
        return " ".join(w for w in s.split() if w not in ("a", "an", "the"))

    def share(a, b):
        return len(a & b) / len(a | b) if a and b else 0

    def same(r, o):
        if not r[3] or r[3] != o[3] or (r[5] and o[5] and r[5] != o[5]):
            return False
        if r[8:] != o[8:]:
            return False
        if r[7] and r[7] == o[7] and r[8] and r[9]:
            return True
        v, w = plain(r[2]), plain(o[2])
        near = v and w and (v == w or v in w or w in v or share(set(v.split()), set(w.split())) >= 0.75)
        if r[4] and r[4] == o[4] and plain(r[1]) == plain(o[1]) and near:
            return True
        if r[6] or o[6] or any(re.search(r"(?i)\b(weekly|every\s+(?:mon|tue|wed|thu|fri|sat|sun)|term[- ]?time|class|lesson|session|club|course)\b", x[1]) for x in (r, o)):
            return False
        stop = {"the", "and", "for", "with", "at", "in", "of", "to", "a", "an"}
        a, b = ({w for w in plain(x[1]).split() if len(w) > 1 and w not in stop} for x in (r, o))
        return bool(near) and (plain(r[1]) == plain(o[1]) or (len(a) >= 3 and len(b) >= 3 and share(a, b) >= 0.8))

    kept = []
    for row in rows:
        for k, (other, merged) in enumerate(kept):
            if same(row, other):
                first = row if (len(row[1]), -row[0]) > (len(other[1]), -other[0]) else other
                kept[k] = (first, [*merged, (other if first is row else row)[0]])
                break
        else:
            kept.append((row, []))
    return sorted((r[0], merged) for r, merged in kept)


FOLD_SCHEMA = "id long, title string, venue_name string, start string, event_url string, venue_id string, is_holiday_camp boolean, programme string, end string, time string"


def test_fold_against_the_rule(spark):
    r = random.Random(5)
    words, venues = ["Story", "Time", "the", "Castle", "&", "Kids", "Fun", "on", "Weekly", "x"], [None, "", "Town Hall", "The Town Hall", "Old Town Hall Main Room", "Castle & Keep", "Castle and Keep Grounds East"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 5))), r.choice(venues), r.choice(["2024-05-01", "2024-05-02", None]), r.choice([None, "u1", "u2"]), r.choice([None, None, "v1", "v2"]), r.random() < 0.2, r.choice([None] * 5 + ["p"]), r.choice(["e", "e", None]), r.choice(["t", "t", None])) for i in range(400)]
    found = identity.fuzzy_fold(spark.createDataFrame(rows, FOLD_SCHEMA).repartition(3), ["start", "end", "time"], ["id"])
    assert sorted((x["id"], x["merged"]) for x in found.collect()) == folded_by_hand(rows)


def test_fold_keeps_what_is_not_known_apart(spark):
    """Rows without a venue, camps and recurring listings do not fold on alike titles."""

    def fold(*rows):
        timed = [(i, *row[:7], *(row[7:] or (day, "10:00"))) for i, row in enumerate(rows)]
        return identity.fuzzy_fold(spark.createDataFrame(timed, FOLD_SCHEMA), ["start"], ["id"]).count()

    day, hall = "2024-05-01", "Town Hall"
    assert fold(("Story time", None, day, None, None, False, None), ("Story time", None, day, None, None, False, None)) == 2
    assert fold(("Story time", hall, day, None, None, False, None), ("The story time", hall, day, None, None, False, None)) == 1
    assert fold(("Story time", hall, day, None, None, True, None), ("Story time", hall, day, None, None, True, None)) == 2
    assert fold(("Story time", hall, day, "u", None, True, None), ("Story time", hall, day, "u", None, True, None)) == 1
    assert fold(("Chess club", hall, day, None, None, False, None), ("Chess club", hall, day, None, None, False, None)) == 2
    assert fold(("One", None, day, None, None, True, "p"), ("Two", "Castle", day, None, None, True, "p")) == 1
    assert fold(("One", None, day, None, None, True, "p", day, None), ("Two", "Castle", day, None, None, True, "p", day, None)) == 2
    assert fold(("Story time", hall, day, None, "a", False, None), ("Story time", hall, day, None, "b", False, None)) == 2
    assert fold(("Story time", hall, None, None, None, False, None), ("Story time", hall, None, None, None, False, None)) == 2


def test_the_whole_fuzzy_dedupe_query(spark):
    from townkit.plans import listings as plans
    from townkit.sources.tables import listings

    rows = listings(spark, "/root/testdata/sf0.001").select("id", "title", F.concat(F.lit("Venue "), F.col("venue_id") % 20).alias("v"), "start", "end", "status").orderBy("start", "id").collect()
    expected = folded_by_hand([(r["id"], r["title"], r["v"], (r["start"], r["end"], r["status"]), None, None, False, None) for r in rows])
    assert sorted((x["id"], x["merged"]) for x in plans.fuzzy_dedupe(spark, "/root/testdata/sf0.001").collect()) == expected


def test_votes_near_the_pole_and_at_the_distance(spark):
    """Against all pairs; nearer than km counts, km itself does not."""
    import math

    def km(a, b):
        la, lo, lb, lp = map(math.radians, (a[3], a[4], b[3], b[4]))
        return 12742 * math.asin(min(1.0, math.sqrt(math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2)))

    r = random.Random(3)
    rows = [("s", i // 2, i % 2, base + r.uniform(-1, 1), r.uniform(-3, 3)) for i, base in enumerate([0.0, 52.0, 66.0, 78.0] * 40)]
    found = {(x["entry"], x["option"], x["votes"]) for x in ranking.neighbour_votes(spark.createDataFrame(rows, "source string, entry int, option int, lat double, lng double"), strict=False).collect()}
    votes = {(a[1], a[2]): len({b[1] for b in rows if b[1] != a[1] and km(a, b) < 40}) for a in rows}
    assert found == {(e, *max(((o, votes[e, o]) for o in (0, 1)), key=lambda x: (x[1], -x[0]))) for e in {row[1] for row in rows}}


def test_best_per_key_breaks_ties_by_id(spark):
    rows = spark.createDataFrame([("k", 2, 5.0), ("k", 1, 5.0), ("k", 3, 4.0)], "key string, id int, score double")
    assert rows_of(identity.best_per_key(rows, "key", "score"), "key", "id") == [("k", 1)]


# ranking


def test_round_robin_order(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("a", 4), ("c", 5)], "bucket string, id int")
    found = ranking.round_robin(rows, "bucket", [F.col("id")]).orderBy("round", "bucket_place")
    assert [r["id"] for r in found.collect()] == [1, 2, 5, 3, 4]


def given_by_hand(sizes, total, least):
    """Of all ways to give whole parts: by the rule's own words, unit by unit, over a small table."""
    n = sum(sizes.values())
    if n <= total:
        return dict(sizes)
    low = {g: min(least, size) for g, size in sizes.items()}
    parts = {g: max(low[g], total * size // n) for g, size in sizes.items()}
    missing = total - sum(parts.values())
    if missing >= 0:
        first = sorted((g for g in sizes if parts[g] < sizes[g]), key=lambda g: (parts[g] * n - total * sizes[g], g))[:missing]
        return {g: p + (g in first) for g, p in parts.items()}
    units = sorted(((-u, g) for g, p in parts.items() for u in range(low[g] + 1, p + 1)))[:-missing]
    return {g: p - sum(h == g for _, h in units) for g, p in parts.items()}


@pytest.mark.parametrize(("sizes", "total", "least"), [({"a": 3, "b": 2}, 10, 1), ({"a": 90, "b": 9, "c": 1}, 10, 1), ({"a": 50, "b": 20, "c": 3}, 2, 1), ({"a": 50, "b": 50, "c": 3, "d": 2, "e": 2}, 11, 3), ({"a": 7, "b": 7, "c": 7}, 10, 0), ({"x": 1}, 1, 5)])
def test_allocation(spark, sizes, total, least):
    rows = spark.createDataFrame([(g, i) for g, n in sizes.items() for i in range(n)], "g string, i int")
    found = {r["g"]: r["quota"] for r in ranking.allocation(rows, "g", total, least).collect()}
    assert found == given_by_hand(sizes, total, least)
    low = sum(min(least, n) for n in sizes.values())
    assert sum(found.values()) == min(sum(sizes.values()), max(total, low)) and all(min(least, sizes[g]) <= found[g] <= sizes[g] for g in sizes)
    drawn = ranking.stratified(rows, "g", "i", total, least)
    assert {r["g"]: r["count"] for r in drawn.groupBy("g").count().collect()} == {g: n for g, n in found.items() if n}


def test_greedy_diversity(spark):
    rows = spark.createDataFrame([("1", 50.0, "m", "g", "l1"), ("2", 49.0, "m", "h", "l2"), ("3", 40.0, "n", "g", "l3"), ("4", 48.0, "M", "k", "l1")], "id string, score double, merchant string, grp string, link string")
    found = {r["place"]: (r["id"], r["adjusted"]) for r in ranking.greedy_diverse(rows, 3).collect()}
    assert found == {1: ("1", 50.0), 2: ("2", 37.0), 3: ("3", 34.0)}  # 4 has a link that is taken


def greedy_uncapped(rows, count):
    left, merchants, groups, links, out = list(rows), {}, {}, set(), []
    while left and len(out) < count:
        value = lambda r: r[1] - 12 * merchants.get(r[2].lower(), 0) - 6 * groups.get(r[3], 0)
        best = min(left, key=lambda r: (-value(r), r[0]))
        left.remove(best)
        if best[4] not in links:
            out.append((len(out) + 1, best[0], value(best)))
            links.add(best[4])
            merchants[best[2].lower()] = merchants.get(best[2].lower(), 0) + 1
            groups[best[3]] = groups.get(best[3], 0) + 1
    return out


def test_greedy_diversity_looks_at_all_rows(spark):
    """A merchant, or copies of one link, that hold the best thousand rows do not hide the rest."""
    hot = [(f"h{i:04}", 90.0 - i % 7, "Hot" if i % 2 else "hot", f"g{i % 3}", f"l{i}") for i in range(1_500)]
    copies = [(f"c{i:04}", 95.0, "copy", "g0", "same") for i in range(1_500)]
    rest = [(f"r{i:03}", 70.0 - i % 11, f"m{i % 9}", f"g{i % 5}", f"k{i % 50}") for i in range(120)]
    for rows, count in ((copies + rest, 20), (hot + copies + rest, 20), (hot + rest, 5)):
        df = spark.createDataFrame(rows, "id string, score double, merchant string, grp string, link string").repartition(3)
        found = sorted((r["place"], r["id"], r["adjusted"]) for r in ranking.greedy_diverse(df, count, 1_000).collect())
        assert found == greedy_uncapped(rows, count)
        assert sorted((r["place"], r["id"], r["adjusted"]) for r in ranking.greedy_diverse(df, count, 7).collect()) == found


def test_votes_drop_ties(spark):
    rows = [("s", 1, 0, 50.0, 0.0), ("s", 1, 1, 55.0, 0.0), ("s", 2, 0, 50.1, 0.0), ("s", 3, 0, 58.0, 0.0), ("s", 3, 1, 40.0, 0.0)]
    df = spark.createDataFrame(rows, "source string, entry int, option int, lat double, lng double")
    assert rows_of(ranking.neighbour_votes(df), "entry", "option") == [(1, 0), (2, 0)]
    assert rows_of(ranking.neighbour_votes(df, strict=False), "entry", "option") == [(1, 0), (2, 0), (3, 0)]


# schedules


def test_ledger_states(spark):
    day = lambda h, m=0: datetime(2024, 1, 1, h, m)
    slots = spark.createDataFrame([("w", day(7)), ("w", day(9)), ("w", day(11)), ("w", day(13)), ("w", day(15))], "workflow string, slot timestamp_ntz")
    runs = spark.createDataFrame([("w", 1, day(7, 5), True), ("w", 2, day(8), True), ("w", 3, day(10, 30), True), ("w", 4, day(12, 30), False)], "workflow string, run_id long, created timestamp_ntz, ok boolean")
    found = schedule.slot_ledger(slots, runs, F.lit("2024-01-01 15:30:00").cast("timestamp_ntz"))
    assert rows_of(found, "slot", "run_id", "state") == [(day(7), 1, "OK"), (day(9), 3, "LATE"), (day(11), 4, "FAILED"), (day(13), None, "MISSING"), (day(15), None, "PENDING")]


def test_streaks(spark):
    rows = spark.createDataFrame([("a", i, f) for i, f in enumerate([True, True, True, False, True])] + [("b", 1, False)], "key string, n int, failed boolean")
    assert rows_of(schedule.streaks(rows, "key", "n", "failed"), "key", "streak", "total", "deactivated") == [("a", 1, 4, True), ("b", 0, 0, False)]


def test_schedule_text(spark):
    slots = spark.createDataFrame([("v", d, "10:00") for d in (1, 2, 3, 5)] + [("v", 0, "11:00"), ("v", 6, "11:00")], "key string, day int, time string")
    assert rows_of(schedule.schedule_text(slots, "key"), "schedule") == [("Mon–Wed, Fri 10:00; Sat, Sun 11:00",)]


def test_next_date(spark):
    dates = F.array(*(F.lit(d).cast("date") for d in ("2024-01-01", "2024-03-01", "2024-02-01")))
    assert spark.range(1).select(schedule.next_date(dates, F.lit("2024-01-02").cast("date")).alias("d")).collect()[0]["d"] == date(2024, 2, 1)


def test_budget(spark):
    rows = spark.createDataFrame([("g", 1, 4.0), ("g", 2, 5.0), ("g", 3, 2.0)], "g string, n int, cost double")
    assert rows_of(schedule.within_budget(rows, "g", [F.col("n")], "cost", 10.0), "n", "taken") == [(1, True), (2, True), (3, False)]


# eligibility


def test_first_rule_wins_and_null_is_no_reason(spark):
    rows = spark.createDataFrame([(5,), (None,), (50,)], "v int")
    reason = eligibility.first_reason(("small", F.col("v") < 10), ("odd", F.col("v") % 2 == 1))
    assert [r["r"] for r in rows.select(reason.alias("r")).collect()] == ["small", None, None]


@pytest.mark.parametrize(("saving", "pct", "ok"), [(10.0, 10.0, True), (9.99, 10.0, False), (1.0, 20.0, True), (0.99, 90.0, False), (1.0, 19.9, False)])
def test_worth_having(spark, saving, pct, ok):
    assert spark.range(1).select(eligibility.worth_having(F.lit(saving), F.lit(pct)).alias("v")).collect()[0]["v"] is ok


# merges


def test_merge_rules(spark):
    old = spark.createDataFrame([(1, "a", "x", None), (2, "b", "y", "s"), (3, "c", "z", "")], "id int, name string, keep string, fill string")
    new = spark.createDataFrame([(1, "A", None, "f"), (3, "C", "Z", "g"), (4, "D", "W", "h")], "id int, name string, keep string, fill string")
    found = merge.merge(old, new, ["id"], {"keep": "keep", "fill": "fill"}, F.col("id") == 3, ("name",))
    assert rows_of(found, "id", "name", "keep", "fill") == [(1, "A", "x", "f"), (2, "b", "y", "s"), (3, "c", "Z", "g"), (4, "D", "W", "h")]


def test_failed_check_refreshes_nothing(spark):
    acts = spark.createDataFrame([(1, "s", date(2024, 1, 1))], "id int, source string, last_seen date")
    for ok, h, old, error, day in ((True, "h", "h", None, 5), (False, "h", "h", None, 1), (True, "h", "g", None, 1), (True, "h", "h", "e", 1), (True, None, None, None, 1)):
        checks = spark.createDataFrame([("s", date(2024, 1, 5), ok, h, old, error)], "source string, checked date, ok boolean, hash string, old_hash string, error string")
        assert rows_of(merge.refresh_seen(acts, checks), "last_seen") == [(date(2024, 1, day),)]


def test_guards(spark):
    with pytest.raises(ValueError):
        merge.assert_count(spark.range(3), 4)
    a, b = spark.createDataFrame([(1, "x", 1), (2, "y", 2)], "id int, p string, q int"), spark.createDataFrame([(2, "z", 2), (3, "w", 3)], "id int, p string, q int")
    assert rows_of(merge.difference(a, b, ["id"], ["p", "q"]), "id", "change", "fields") == [(1, "missing", []), (2, "changed", ["p"]), (3, "added", [])]
    assert merge.difference(a, a, ["id"], ["p", "q"]).count() == 0


def test_fingerprint_depends_on_all_rows(spark):
    rows = spark.range(3000).withColumn("v", F.col("id") * 3)
    one = merge.fingerprint(rows, "id", "id", "v").collect()
    assert one == merge.fingerprint(rows.repartition(7), "id", "id", "v").collect()
    assert one != merge.fingerprint(rows.withColumn("v", F.when(F.col("id") == 2999, 0).otherwise(F.col("v"))), "id", "id", "v").collect()


# graphs and feeds


def test_ancestors_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "child string, parent string")
    assert rows_of(graph.ancestors(edges), "child", "ancestor", "depth") == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]
    with pytest.raises(ValueError):
        graph.ancestors(spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string"))


def test_chains(spark):
    def ends(rows):
        return {r["id"]: (r["canonical"], r["hops"]) for r in graph.canonical(spark.createDataFrame(rows, "id long, merged_into long"), "id", "merged_into").collect()}

    chain = lambda n: [(100 + i, 101 + i if i < n else None) for i in range(n + 1)]
    found = ends([(1, 2), (2, 3), (3, None), (6, 99), *chain(20)])
    assert found[1] == (3, 2) and found[3] == (3, 0) and found[6] == (99, 1) and found[100] == (120, 20)
    for bad in ([(4, 5), (5, 4)], [(7, 7)], chain(21)):
        with pytest.raises(ValueError):
            ends(bad)


def test_series_lives_while_an_item_maps_to_it(spark):
    rows = [(1, "i", "A", "update"), (2, "j", "A", "update"), (3, "j", "B", "update"), (4, "k", "C", "update"), (5, "k", "C", "delete")]
    df = spark.createDataFrame(rows, "seq int, item string, series string, kind string")
    found = feeds.series_state(df, "item", "series", "seq", F.col("kind") == "delete")
    assert rows_of(found, "series", "items", "last_seq", "last_item") == [("A", 1, 2, "j"), ("B", 1, 3, "j")]


@pytest.mark.parametrize("n", [1, 20, 21])
def test_nearest_rank(spark, n):
    import math

    found = feeds.nearest_rank(spark.range(n).selectExpr("'g' AS g", "id AS v"), "g", "v").collect()[0]
    assert (found["at"], found["most"], found["n"]) == (math.ceil(n * 0.95) - 1, n - 1, n)


# matching


def test_reference_match_prefers_the_exact_name(spark):
    stored = spark.createDataFrame([(1, "park street library", "M1 1AE", 53.0, -2.0), (2, "park street librery", "M1 1AE", 53.0, -2.0), (3, "oak hall", "M2 2AA", 53.5, -2.5)], "match long, stored_name string, postcode string, lat double, lng double")
    asked = spark.createDataFrame([(10, "park street library", "M1 1AE", 0.0, 0.0), (11, "park street libraries", "M1 1AE", 0.0, 0.0), (12, "oak halls", "X1 1XX", 53.5004, -2.5), (13, "oak halls", "X1 1XX", 53.5009, -2.5)], "candidate long, name string, postcode string, lat double, lng double")
    found = {r["candidate"]: (r["match"], r["method"], round(r["confidence"], 3)) for r in matching.reference_matches(asked, stored).collect()}
    assert found[10] == (1, "exact", 1.0) and found[11][1] == "postcode_fuzzy_name" and found[12][:2] == (3, "near_name") and 13 not in found


def test_greedy_pairs_are_one_to_one(spark):
    rows = spark.createDataFrame([("k", 1, 1, 0.9), ("k", 1, 2, 0.8), ("k", 2, 1, 0.85), ("k", 2, 2, 0.1)], "block string, left long, right long, score double")
    assert rows_of(matching.greedy_pairs(rows, "block"), "left", "right") == [(1, 1), (2, 2)]


def test_views_take_a_clock(spark):
    rows = spark.createDataFrame([(1, "event", date(2024, 5, 1), None), (2, "event", date(2024, 4, 1), date(2024, 5, 2)), (3, "event", None, date(2024, 9, 1)), (4, "activity", date(2024, 9, 1), None)], "id int, kind string, start date, end date")
    assert rows_of(views.upcoming_events(rows, "2024-05-02"), "id") == [(2,)]
    assert rows_of(views.upcoming_events(rows, "2024-05-01"), "id") == [(1,), (2,)]


def test_near_classes_do_not_expand_copies(spark):
    import random

    draw = random.Random(6)
    kinds = [sorted(draw.sample([f"w{i}" for i in range(14)], draw.randint(3, 7))) for _ in range(40)]
    data = [(i, draw.sample(w := kinds[draw.randrange(40)], len(w))) for i in range(300)]
    found = rows_of(identity.near_classes(spark.createDataFrame(data, "id long, words array<string>"), 0.5), "first_id", "id")
    first = {}
    for i, words in data:
        first.setdefault(frozenset(words), i)
    expected = [(first[frozenset(w)], i) for i, w in data if len(w) >= 4 and first[frozenset(w)] != i]
    expected += [(i, j) for a, i in first.items() for b, j in first.items() if i < j and len(a) >= 4 and len(b) >= 4 and len(a & b) / len(a | b) >= 0.5]
    assert found == sorted(expected)


def test_votes_of_entries_at_the_same_points(spark, monkeypatch):
    """Against all pairs, with entries and options that share points or have several; copies of a point are measured once."""
    from townkit.functions import geo

    draw = random.Random(4)
    rows = [("s" if i % 5 else None, draw.randrange(25), draw.randrange(2), 52.0 + draw.randrange(8) * 0.17 if i % 11 else None, draw.randrange(6) * 0.2) for i in range(150)]
    df = spark.createDataFrame(rows, "source string, entry int, option int, lat double, lng double")
    both = df.alias("a").crossJoin(df.alias("b")).where("a.source = b.source AND a.entry <> b.entry")
    near = both.where(geo.haversine(F.col("a.lat"), F.col("a.lng"), F.col("b.lat"), F.col("b.lng")) < 40).groupBy("a.entry", "a.option").agg(F.count_distinct("b.entry").alias("n"))
    votes = {(r["entry"], r["option"]): r["n"] for r in near.collect()}
    found = {(r["entry"], r["option"]): r["votes"] for r in ranking.neighbour_votes(df.where("source IS NOT NULL"), strict=False).collect()}
    assert len({r[1] for r in rows if r[0]}) == len(found) and all(votes.get(k, 0) == n for k, n in found.items())
    pairs, plain = spark.sparkContext.accumulator(0), geo.haversine

    @F.udf("double", useArrow=False)
    def counted(km):
        pairs.add(1)
        return km

    monkeypatch.setattr(geo, "haversine", lambda *points: counted(plain(*points)))
    many = spark.range(3_000).selectExpr("'s' AS source", "id AS entry", "0 AS option", "52.0D + id % 3 * 0.1D AS lat", "0.0D AS lng")
    assert {r["votes"] for r in ranking.neighbour_votes(many, strict=False).collect()} == {2_999}
    assert pairs.value <= 100


def test_fuzzy_fold_of_a_large_block(spark):
    """20,000 listings of one block, none of which mean the same: before, each was compared with all before it (200 million comparisons)."""
    import time

    rows = spark.range(20_000).selectExpr("id", "concat('Session ', id % 5000) AS title", "concat('Venue ', id % 20) AS venue_name", "'2024-01-01' AS start").repartition(1)
    begin = time.monotonic()
    assert identity.fuzzy_fold(rows, ["start"], ["id"]).where("size(merged) = 0").count() == 20_000
    assert time.monotonic() - begin < 30


def test_the_fuzzy_dedupe_query_folds(spark, tmp_path):
    """Before, all titles were of sessions, which recur, and no links were given: no listing could be folded into another."""
    from datetime import datetime

    from townkit.plans import listings as plans

    orders = [(1, 10, "5-LOW"), (6, 610, "5-LOW"), (11, 110, "5-LOW"), (16, 10, "2-HIGH"), (31, 110, "2-HIGH"), (36, 111, "2-HIGH")]
    rows = [(key, customer, "O", 1.0, datetime(1998, 2, 6), priority) for key, customer, priority in orders]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    found = {r["id"]: (r["title"], r["merged"]) for r in plans.fuzzy_dedupe(spark, str(tmp_path)).collect()}
    assert found == {1: ("The 5-LOW Session 10", [6]), 11: ("The 5-LOW Session 10", []), 31: ("The 2-HIGH Show at 10", [16]), 36: ("The 2-HIGH Show 11", [])}
