import math
import random

import pytest

from townkit.operators import joins, nearest


def km(a, b):
    la, lo, lb, lp = (math.radians(v) for v in (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return round(12742.0 * math.asin(math.sqrt(min(1.0, h))), 6)


def run(spark, points, targets):
    a = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "point long, lat double, lng double")
    b = spark.createDataFrame([(i, *t) for i, t in enumerate(targets)], "target long, lat double, lng double")
    return {r["point"]: (r["target"], r["km"]) for r in nearest.nearest_join(a, b).collect()}


def check(found, points, targets):
    for i, p in enumerate(points):
        d, t = min((km(p, t), j) for j, t in enumerate(targets))
        assert found[i][1] == pytest.approx(d, abs=2e-6) and (found[i][0] == t or abs(km(p, targets[found[i][0]]) - d) < 2e-6)


@pytest.mark.parametrize("small", [True, False])
def test_dense_and_empty_regions(spark, small, monkeypatch):
    """Towns far apart, points between them, at the poles and on both sides of the date line."""
    if not small:
        monkeypatch.setattr(joins, "BROADCAST_BYTES", -1)
    r = random.Random(2)
    towns = [(51.5, -0.1), (53.5, -2.2), (-16.8, 179.99), (-16.8, -179.99), (89.9, 20.0)]
    targets = [(min(90.0, la + r.gauss(0, 0.03)), lo + r.gauss(0, 0.005)) for la, lo in towns for _ in range(150)]
    targets = [(la, lo) for la, lo in targets if abs(lo) <= 180]
    points = [(la + r.gauss(0, 0.05), lo) for la, lo in towns[:3] for _ in range(30)] + [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(40)] + [(90.0, 0.0), (-90.0, 0.0), (0.0, 180.0), (0.0, -180.0)]
    points = [(min(90.0, la), lo) for la, lo in points]
    check(run(spark, points, targets), points, targets)


def test_a_third_of_all_rows_at_one_place(spark):
    targets = [(50.0, 1.0)] * 400 + [(50.0 + i * 1e-6, 1.0) for i in range(1, 400)]
    points = [(50.0, 1.0)] * 300 + [(50.0002, 1.0)] * 3
    found = run(spark, points, targets)
    assert all(found[i] == (0, 0.0) for i in range(300))
    check(found, points, targets)


def test_nulls_and_empty(spark):
    points = [(None, 1.0), (91.0, 0.0), (1.0, 1.0)]
    assert set(run(spark, points, [(2.0, 2.0), (None, None)])) == {2}
    a = spark.createDataFrame([(1, 2.0, 3.0)], "point long, lat double, lng double")
    b = spark.createDataFrame([], "target string, lat double, lng double")
    assert nearest.nearest_join(a, b).count() == 0 and nearest.nearest_join(a.limit(0), a.withColumnRenamed("point", "target")).count() == 0


def test_the_plan_has_no_product(spark):
    a = spark.range(50).selectExpr("id AS point", "id * 0.1D AS lat", "id * 0.1D AS lng")
    plan = nearest.nearest_join(a.limit(9), a.limit(9).withColumnRenamed("point", "target"))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
