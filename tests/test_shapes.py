"""Shapes against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from lotwise.functions import shapes
from lotwise.operators import parcels, structures, zonal

SHAPE = "array<array<struct<x:double,y:double>>>"


def box(x0, y0, x1, y1):
    return [(float(x0), float(y0)), (float(x1), float(y0)), (float(x1), float(y1)), (float(x0), float(y1))]


def floats(rings):
    return None if rings is None else [[(float(x), float(y)) for x, y in ring] for ring in rings]


def clip(subject, convex):
    """Convex clipping (Sutherland and Hodgman), counterclockwise."""
    out = subject
    for (ax, ay), (bx, by) in zip(convex, convex[1:] + convex[:1]):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: B023, E731
        new = []
        for p, q in zip(out[-1:] + out[:-1], out):
            sp, sq = side(p), side(q)
            if (sp >= 0) != (sq >= 0):
                t = sp / (sp - sq)
                new.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
            if sq >= 0:
                new.append(q)
        out = new
    return out


def area(ring):
    return abs(sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]))) / 2 if len(ring) > 2 else 0.0


def hull(points):
    points = sorted(set(points))

    def half(some):
        out = []
        for p in some:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


CASES = [
    ("same", [box(0, 0, 2, 2)], [box(0, 0, 2, 2)], 4, True),
    ("side", [box(0, 0, 1, 1)], [box(1, 0, 2, 1)], 0, True),
    ("corner", [box(0, 0, 1, 1)], [box(1, 1, 2, 2)], 0, True),
    ("apart", [box(0, 0, 1, 1)], [box(3, 0, 4, 1)], 0, False),
    ("hole", [box(0, 0, 4, 4), box(1, 1, 3, 3)], [box(0, 0, 4, 4)], 12, True),
    ("in hole", [box(0, 0, 4, 4), box(1, 1, 3, 3)], [box(1.5, 1.5, 2, 2)], 0, False),
    ("slanted", [[(0, 0), (4, 0), (0, 4)]], [[(0, 0), (4, 4), (0, 4)]], 4, True),
    ("closed", [[(0, 0), (4, 0), (0, 4), (0, 0)]], [box(0, 0, 2, 2)], 4, True),
    ("bow tie", [[(0, 0), (2, 2), (2, 0), (0, 2)]], [box(-1, -1, 3, 3)], 2, True),
    ("parts", [box(0, 0, 1, 1), box(2, 0, 3, 1)], [box(0.5, 0, 2.5, 1)], 1, True),
    ("inside", [box(0, 0, 9, 9)], [box(1, 1, 2, 2)], 1, True),
    ("null", None, [box(0, 0, 1, 1)], 0, False),
    ("empty", [], [box(0, 0, 1, 1)], 0, False),
]


def test_shared_area_and_meeting(spark):
    df = spark.createDataFrame([(n, floats(a), floats(b), float(s), m) for n, a, b, s, m in CASES], f"n string, a {SHAPE}, b {SHAPE}, s double, m boolean")
    a, b = F.col("a"), F.col("b")
    for r in df.select("*", shapes.shared_area(a, b).alias("ab"), shapes.shared_area(b, a).alias("ba"), shapes.meet(a, b).alias("met"), shapes.meet(b, a).alias("back")).collect():
        assert abs(r["ab"] - r["s"]) < 1e-9 and abs(r["ba"] - r["s"]) < 1e-9 and r["met"] == r["back"] == r["m"], r["n"]


def test_random_convex_shapes_equal_clipping(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(150):
        one, two = (hull([(rng.uniform(0, 3) - 79, rng.uniform(0, 3) + 35) for _ in range(7)]) for _ in range(2))
        rows.append((floats([one]), floats([two]), area([(x + 79, y - 35) for x, y in clip(one, two)])))
    df = spark.createDataFrame(rows, f"a {SHAPE}, b {SHAPE}, s double")
    assert df.where(F.abs(shapes.shared_area(F.col("a"), F.col("b")) - F.col("s")) > 1e-9).count() == 0
    assert df.where(shapes.meet(F.col("a"), F.col("b")) != (F.col("s") > 0)).count() == 0


def test_interior_points_lie_inside(spark):
    arch = [(0, 0), (3, 0), (3, 3), (2, 3), (2, 1), (1, 1), (1, 3), (0, 3)]
    for rings in ([arch], [box(0, 0, 4, 4), box(1, 1, 3, 3)], [[(0, 0), (5, 1), (0, 2), (1, 1)]], [box(0, 0, 1, 1), box(5, 5, 6, 9)]):
        df = spark.createDataFrame([(floats(rings),)], f"s {SHAPE}").withColumn("p", shapes.interior_point(F.col("s")))
        r = df.select("p", shapes.inside(F.col("p.x"), F.col("p.y"), F.col("s")).alias("in"), shapes.distance2(F.col("p.x"), F.col("p.y"), shapes.edges(F.col("s"))).alias("d")).first()
        assert r["in"] and r["d"] > 0.01


def test_a_sliver_of_a_lot_in_the_area_counts(spark):
    """A tenth of a lot lies in the area, its centre does not; another lot touches it only, a third holds it, a fourth lies in its hole."""
    lots = [(1, 0.0, 0.0, 1.0, 1.0), (2, 0.9, -1.0, 1.9, 0.0), (3, 3.0, 0.0, 5.0, 9.0), (4, 1.2, 0.4, 1.3, 0.6), (5, 7.0, 7.0, 8.0, 8.0)]
    df = spark.createDataFrame(lots, "id long, minx double, miny double, maxx double, maxy double")
    got = parcels.in_area(df, [box(0.9, 0, 4, 1), box(1.1, 0.3, 1.5, 0.7)]).collect()
    assert [r["id"] for r in got] == [1, 2, 3] and abs(got[0]["shared"] - 0.1) < 1e-9 and got[1]["shared"] == 0 and abs(got[2]["shared"] - 1) < 1e-9
    assert [r["id"] for r in parcels.in_ring(df, box(0.9, 0, 4, 1)).collect()] == [1, 2, 3, 4]


def inside(x, y, rings):
    n = 0
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
            n += (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0
    return n % 2 == 1


@pytest.mark.parametrize("inset", [None, 2.5])
def test_lines_equal_a_test_of_every_pixel(spark, inset):
    rng = random.Random(7)
    zones = []
    for k in range(12):
        rings = [[(rng.uniform(-20, 150), rng.uniform(-90, 150)) for _ in range(rng.randrange(3, 7))] for _ in range(rng.randrange(1, 4))]
        zones.append((k + 1, k, rings))
    df = spark.createDataFrame([(z, o, floats(r)) for z, o, r in zones], f"zone int, ord int, shape {SHAPE}")
    got = {(r["zone"], r["row"], c) for r in zonal.shape_lines(df, inset=inset).collect() for c in (r["cols"] if inset is None else r["deep"])}

    def far(x, y, rings):
        for ring in rings:
            for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
                t = max(0, min(1, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2)))
                if (x - x0 - t * (x1 - x0)) ** 2 + (y - y0 - t * (y1 - y0)) ** 2 < inset**2:
                    return False
        return True

    want = {(z, y, x) for z, _, rings in zones for y in range(-92, 152) for x in range(-22, 152) if inside(x + 0.5, y + 0.5, rings) and (inset is None or far(x + 0.5, y + 0.5, rings))}
    assert got == want


def test_core_of_a_narrow_lot_is_all_of_it(spark):
    df = spark.createDataFrame([(1, 0, floats([box(0, 0, 4, 30)]), 50.0), (2, 0, floats([box(0, 0, 20, 20), box(8, 8, 12, 12)]), 50.0)], f"zone int, ord int, shape {SHAPE}, built_m2 double")
    got = structures.core_pixels(df, 1.0).groupBy("zone").count().collect()
    cells = {(x, y) for x in range(20) for y in range(20) if 3 <= x + 0.5 <= 17 and 3 <= y + 0.5 <= 17}
    near_hole = {(x, y) for x, y in cells if max(8 - x - 0.5, x + 0.5 - 12, 0) ** 2 + max(8 - y - 0.5, y + 0.5 - 12, 0) ** 2 < 9}
    assert {r["zone"]: r["count"] for r in got} == {1: 120, 2: len(cells - near_hole)}


def test_cores_are_worked_out_in_one_pass(spark, tmp_path):
    """Lots are read and labelled once, dealt to all tasks before; a lot of 3000 pixels a row has few runs; lots without a shape or a zone have no core."""
    import __spark_entry__

    spark.range(200).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    plan = __spark_entry__.queries()["developed_core_shapes"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "MapInArrow" in plan
    df = spark.createDataFrame([(1, 0, floats([box(0, 0, 3000, 200)]), 50.0), (2, 0, None, 1.0), (3, 0, [], 1.0), (None, 0, floats([box(0, 0, 9, 9)]), 1.0)], f"zone int, ord int, shape {SHAPE}, built_m2 double")
    near = {(x, y) for x in range(1400, 1600) for y in range(200) if (x + 0.5 - 1500) ** 2 + (y + 0.5 - 100) ** 2 < 16**2}
    assert {(r["zone"], r["col"], r["row"]) for r in structures.core_pixels(df, 1.0).collect()} == {(1, x, y) for x, y in near}
