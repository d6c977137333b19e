from townkit.operators import geography


def test_answers_meet_their_items_once(spark):
    items = spark.createDataFrame([(b, i, f"t{b}{i}") for b in (1, 2, 3) for i in range(2)], "batch int, index int, title string")
    answers = spark.createDataFrame([(1, 0, "0", "a"), (1, 1, "1", "b"), (2, 0, "1", "c"), (2, 1, " 1", "d"), (2, 2, "7", "e"), (2, 3, "x", "f"), (2, 4, None, "g"), (4, 0, "0", "h")], "batch int, place int, i string, answer string")
    met, warned = geography.attached(answers, items)
    assert sorted((r["batch"], r["index"], r["title"], r["answer"]) for r in met.collect()) == [(1, 0, "t10", "a"), (1, 1, "t11", "b"), (2, 1, "t21", "c")]
    assert {r["batch"]: r["warning"] for r in warned.collect()} == {1: None, 2: geography.MISSING, 3: geography.MISSING}


def test_geography_of_answers(spark):
    districts = spark.createDataFrame([("leeds", None, "england"), ("cherwell", "oxfordshire", "england"), ("cardiff", None, "wales"), ("glasgow_city", None, "scotland")], "district string, county string, nation string")
    aliases = spark.createDataFrame([("glasgow", "glasgow_city")], "alias string, name string")
    regions = spark.createDataFrame([("north_east", "north_east"), ("north_east", "the_north_east")], "region string, name string")
    cases = [
        ("News", "", "Paper", "uk", "nationwide", "", "", "", None, ("nationwide", None, None, None)),
        ("News", None, None, "france", "nationwide", "", "", "", "missing/invalid nation", None),
        ("News", None, None, "wales", "everywhere", "", "", "", "missing/invalid geo_scope", None),
        ("News", None, None, "uk", "local", "", "", "Leeds", "UK-wide nation conflicts with narrow scope", None),
        ("Across the North East", None, None, "england", "regional", "North East", "", "", None, ("regional", "north_east", None, None)),
        ("Elsewhere", None, None, "england", "regional", "North East", "", "", "regional scope without named region evidence", None),
        ("South Wales", None, None, "wales", "regional", "South Wales", "", "", "unsupported/missing sub-national region", None),
        ("Fun in Cherwell", None, None, "england", "local", "", "", "Cherwell District Council", None, ("local", None, "oxfordshire", "cherwell")),
        ("Fun", "in Glasgow today", None, "scotland", "county", None, None, "Glasgow City", None, ("local", None, None, "glasgow_city")),
        ("Fun", None, "Leeds City Council", "england", "local", "", "", "Leeds", None, ("local", None, None, "leeds")),
        ("Fun", None, "Leeds Post", "england", "local", "", "", "Leeds", "local scope without named council/county evidence", None),
        ("Leeds", None, None, "wales", "local", "", "", "Leeds", "local scope without a recognised council/county in this nation", None),
        (None, None, None, None, None, None, None, None, "missing/invalid nation", None),
    ]
    rows = spark.createDataFrame([(n, *c[:8]) for n, c in enumerate(cases)], "id int, title string, snippet string, source string, region string, geo_scope string, geo_region string, admin_area string, locality string")
    found = {r["id"]: (r["problem"], (r["geo_scope"], r["geo_region"], r["admin_area"], r["locality"])) for r in geography.checked(rows, districts, aliases, regions).collect()}
    assert found == {n: (c[8], c[9] or (None,) * 4) for n, c in enumerate(cases)}
