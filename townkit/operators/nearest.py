"""The nearest row of one large relation for each row of another: exact, on the sphere, without a product of the two."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townkit.functions import geo
from townkit.operators.joins import look_up
from townkit.operators.stages import written

#: A tree of cubes around the unit sphere: LEVELS times, a cube is parted in 2 ** BITS along each axis. The smallest are some 6 m wide.
LEVELS, BITS = 7, 3
#: A cube of at most so many different points is not parted further.
LEAF = 32
#: Room for rounding in comparisons of distances (in radii of the earth: some 6 mm).
SLACK = 1e-9
#: Masks that spread the bits of a number to every third bit, with the shift before each.
SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def on_sphere(lat: Column, lng: Column) -> list[Column]:
    a, b = F.radians(lat), F.radians(lng)
    return [(F.cos(a) * F.cos(b)).alias("x"), (F.cos(a) * F.sin(b)).alias("y"), F.sin(a).alias("z")]


def cube(x: Column, y: Column, z: Column) -> Column:
    """The smallest cube of a point; shifted right by 3 * BITS, a cube's number is that of the cube around it."""

    def spread(axis: Column) -> Column:
        side = 1 << (LEVELS * BITS)
        v = F.least(F.floor((axis + 1) / 2 * side), F.lit(side - 1)).cast("long")
        return reduce(lambda v, s: v.bitwiseOR(F.shiftleft(v, s[0])).bitwiseAND(F.lit(s[1])), SPREAD, v)

    return F.shiftleft(spread(x), 2).bitwiseOR(F.shiftleft(spread(y), 1)).bitwiseOR(spread(z))


def box_bounds(c: Column) -> tuple[Column, Column]:
    """The least and greatest distance (along the chord) from the point x, y, z to what is in the box c."""

    def square(outward) -> Column:
        return sum((F.pow(outward(F.col(a), c[f"{a}0"], c[f"{a}1"]), 2) for a in "xyz"), F.lit(0.0))

    near = square(lambda v, low, high: F.greatest(low - v, v - high, F.lit(0.0)))
    far = square(lambda v, low, high: F.greatest(F.abs(v - low), F.abs(v - high)))
    return F.sqrt(near), F.sqrt(far)


def tree(targets: DataFrame) -> list[DataFrame]:
    """The cubes of each level, from the one around all down to the smallest.

    code, n (different points), box, members (of small cubes, else null), inner (the cubes inside of large ones: code, n, box; else null).
    """
    member = F.struct("target", "lat", "lng")
    finest = targets.groupBy("lat", "lng").agg(F.min("target").alias("target"))
    finest = finest.select("target", "lat", "lng", *on_sphere(F.col("lat"), F.col("lng")))
    sides = [f(a).alias(f"{a}{i}") for a in "xyz" for i, f in enumerate((F.min, F.max))]
    cubes = finest.groupBy(cube(F.col("x"), F.col("y"), F.col("z")).alias("code")).agg(F.count(F.lit(1)).alias("n"), *sides, F.collect_list(member).alias("members"))
    box = F.struct(*(f"{a}{i}" for a in "xyz" for i in (0, 1))).alias("box")
    one = F.struct("code", "n", "box")
    levels = [written(cubes.select("code", "n", box, "members"), "cubes")]
    merged = [f(f"box.{a}{i}").alias(f"{a}{i}") for a in "xyz" for i, f in enumerate((F.min, F.max))]
    for _ in range(LEVELS):
        # lists stop growing at LEAF: a cube of more points has none
        members = F.when(F.sum("n") <= LEAF, F.flatten(F.collect_list(F.when(F.col("n") <= LEAF, F.col("members")))))
        up = levels[0].groupBy(F.shiftright("code", 3 * BITS).alias("code")).agg(F.sum("n").alias("n"), *merged, members.alias("members"), F.when(F.sum("n") > LEAF, F.collect_list(one)).alias("inner"))
        levels.insert(0, written(up.select("code", "n", box, "members", "inner"), "cubes"))
    return levels


def nearest_join(points: DataFrame, targets: DataFrame) -> DataFrame:
    """point, target, km: the nearest target of each point, ties (to a millimetre) by the least target.

    points: point (unique), lat, lng; targets: target, lat, lng. Rows with a null coordinate, or one that is not on the earth, take no part;
    points have no row if no target is left. Targets at one place are one place.

    Targets become a tree of cubes, dense cubes parted further. Points walk it level by level: of its cubes a point keeps those that may
    hold something nearer than the farthest corner of its best cube, which proves what is left out, so that only a handful is kept. A level
    is a join with one row for each cube, and one shuffle of the points that still have a dense cube.
    """
    usable = geo.valid_point(F.col("lat"), F.col("lng"))
    levels = tree(targets.where(usable).select("target", F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng")))
    at = points.where(usable).select("point", F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"))
    root = levels[0].collect()  # one row, or none
    km = geo.haversine(F.col("lat"), F.col("lng"), F.col("m.lat"), F.col("m.lng"))
    if not root:
        return at.select("point", F.lit(None).cast(targets.schema["target"].dataType).alias("target"), F.lit(0.0).alias("km")).limit(0)
    first = F.array(F.struct(F.lit(0).alias("level"), F.lit(root[0]["code"]).alias("code"), F.lit(root[0]["n"]).alias("n"), F.lit(0.0).alias("near")))
    walking, done = at.select("point", "lat", "lng", *on_sphere(F.col("lat"), F.col("lng")), F.lit(4.0).alias("most"), first.alias("cubes")), None
    for level in range(1, LEVELS + 1):
        is_open = F.exists("cubes", lambda c: (c["n"] > LEAF) & (c["level"] == level - 1))
        settled = walking.where(~is_open).select("point", "lat", "lng", "cubes")
        done = settled if done is None else done.unionByName(settled)
        each = walking.where(is_open).select("point", "lat", "lng", "x", "y", "z", "most", F.explode("cubes").alias("c"))
        parted = (F.col("c.n") > LEAF) & (F.col("c.level") == level - 1)
        small = each.where(~parted)
        inner = levels[level - 1].where(F.col("n") > LEAF).select("code", "inner")
        big = look_up(each.where(parted).withColumn("code", F.col("c.code")), inner, ["code"]).select(*each.columns[:-1], F.explode("inner").alias("i"))
        near, far = box_bounds(F.col("i.box"))
        big = big.select(*each.columns[:-2], F.least("most", far + SLACK).alias("most"), F.struct(F.lit(level).alias("level"), F.col("i.code").alias("code"), F.col("i.n").alias("n"), near.alias("near")).alias("c"))
        grouped = small.unionByName(big).where(F.col("c.near") <= F.col("most") + SLACK).groupBy("point", "lat", "lng", "x", "y", "z").agg(F.min("most").alias("most"), F.collect_list("c").alias("cubes"))
        walking = written(grouped.withColumn("cubes", F.filter("cubes", lambda c: c["near"] <= F.col("most") + SLACK)), "walking")
        if walking.isEmpty():
            break
    else:
        done = done.unionByName(walking.select("point", "lat", "lng", "cubes"))  # what is dense at the last level keeps its members
    wanted = written(done.select("point", "lat", "lng", F.explode("cubes").alias("c")).select("point", "lat", "lng", F.col("c.level").alias("level"), F.col("c.code").alias("code")), "leaves")
    leaves = reduce(DataFrame.unionByName, (c.select(F.lit(n).alias("level"), "code", "members") for n, c in enumerate(levels)))
    met = look_up(wanted, leaves.where(F.col("members").isNotNull()), ["level", "code"]).select("point", "lat", "lng", F.explode("members").alias("m"))
    best = met.groupBy("point").agg(F.min(F.struct(F.round(km, 6).alias("km"), F.col("m.target").alias("target"))).alias("b"))
    return best.select("point", "b.target", "b.km")
