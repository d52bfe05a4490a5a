"""Simplified and repaired rings."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.functions import geo, shapes
from lotwise.operators import rings

SHAPE = "array<array<struct<x:double,y:double>>>"


def ring(*points):
    return np.array(points, float)


def far(points, out):
    """The largest distance of points from the line of a ring."""
    worst = 0.0
    for p in points:
        best = np.inf
        for a, b in zip(out, np.roll(out, -1, 0)):
            d = b - a
            t = np.clip((p - a) @ d / max(d @ d, 1e-300), 0, 1)
            best = min(best, np.hypot(*(p - a - t * d)))
        worst = max(worst, best)
    return worst


def test_simplified_rings_stay_near_and_simple():
    rng = np.random.default_rng(4)
    for _ in range(60):
        angles = np.sort(rng.random(80)) * 2 * np.pi
        star = np.stack([np.cos(angles), np.sin(angles)], 1) * (1 + 0.3 * rng.random(80))[:, None]
        hole = star[::-4] * 0.5
        out = rings.simplify([star, hole], 0.08)
        assert len(out[0]) < 80 and far(star, out[0]) <= 0.08 and far(hole, out[1]) <= 0.08
        assert not any(len(rings.crossings(a, b)) for i, a in enumerate(out) for b in out[i:])
    square = ring((0, 0), (1, 0), (2, 0), (2, 2), (0, 2), (0, 1), (0, 0))
    assert len(rings.simplify([square], 1e-9)[0]) == 4
    # a narrow inlet whose walls would cross when straightened stays open
    inlet = ring((0, 0), (10, 0), (10, 10), (5.2, 10), (5.1, 1), (5.0, 10), (0, 10))
    assert not len(rings.crossings(*[rings.simplify([inlet], 3.0)[0]] * 2))


def evenodd(x, y, some):
    return sum(int(((a[1] > y) != (b[1] > y)) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0]) for r in some for a, b in zip(r, np.roll(r, -1, 0))) % 2


def area(r):
    return abs(np.sum(r[:, 0] * np.roll(r[:, 1], -1) - np.roll(r[:, 0], -1) * r[:, 1])) / 2


@pytest.mark.parametrize("name, given, parts, total", [
    ("bow tie", [ring((0, 0), (2, 2), (2, 0), (0, 2))], 2, 2.0),
    ("spike", [ring((0, 0), (4, 0), (4, 2), (7, 2), (4, 2), (4, 4), (0, 4))], 1, 16.0),
    ("figure of eight at a point", [ring((0, 0), (2, 0), (1, 1), (2, 2), (0, 2), (1, 1))], 2, 2.0),
    ("two squares over each other", [ring((0, 0), (2, 0), (2, 2), (0, 2)), ring((1, 1), (3, 1), (3, 3), (1, 3))], 2, 6.0),
    ("common edge", [ring((0, 0), (1, 0), (1, 1), (0, 1)), ring((1, 0), (2, 0), (2, 1), (1, 1))], 1, 2.0),
    ("no area", [ring((0, 0), (1, 1), (0, 0))], 0, 0.0),
    ("right already", [ring((0, 0), (3, 0), (0, 3))], 1, 4.5),
])
def test_repairs(name, given, parts, total):
    out = rings.repair(given)
    assert len(out) == parts and abs(sum(map(area, out)) - total) < 1e-9


def test_random_tangles_keep_their_area():
    rng = random.Random(3)
    for _ in range(40):
        tangle = [ring(*[(rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(rng.randrange(4, 9))]) for _ in range(rng.randrange(1, 3))]
        out = rings.repair(tangle)
        assert not any(len(rings.crossings(a, b)) for i, a in enumerate(out) for b in out[i:])
        for _ in range(150):
            x, y = rng.uniform(-1, 10), rng.uniform(-1, 10)
            assert evenodd(x, y, out) == evenodd(x, y, tangle)


def test_columns(spark):
    rows = [(1, [[(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0)]]), (2, None), (3, []), (4, [[(0.0, 0.0), (1.0, 0.0)]]), (5, [[(0.0, 0.0), (1.0, 1e-7), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]])]
    df = spark.createDataFrame([(i, s, "kept") for i, s in rows], f"id int, shape {SHAPE}, note string")
    mended = {r["id"]: r for r in rings.repaired(df).withColumn("area", shapes.area(F.col("shape"))).collect()}
    assert mended[1]["area"] == 2.0 and len(mended[1]["shape"]) == 2 and mended[2]["shape"] is None and mended[3]["shape"] == [] == mended[4]["shape"] and mended[1]["note"] == "kept"
    slim = {r["id"]: r["shape"] for r in rings.simplified(df).collect()}
    assert len(slim[5][0]) == 4 and slim[2] is None


def test_conic_projection(spark):
    """A published example on another ellipsoid, and the way back to within 1e-9 degrees."""
    snyder = geo.Conic(33.0, 45.0, 23.0, -96.0, axis=6378206.4, flattening=1 / 294.9786982)
    one = spark.range(1)
    x, y = (round(one.select(c).first()[0], 1) for c in snyder.xy(F.lit(-75.0), F.lit(35.0)))
    assert (x, y) == (1894410.9, 1564649.5)
    degrees = spark.range(200).select((-84 + F.col("id") * 0.05).alias("lon"), (33 + F.col("id") % 50 * 0.09).alias("lat"))
    for conic in (snyder, geo.NORTH_CAROLINA_FEET, geo.Conic(-30.0, -40.0, -35.0, -80.0)):
        x, y = conic.xy(F.col("lon"), F.col("lat"))
        lon, lat = conic.lonlat(F.col("x"), F.col("y"))
        back = degrees.select("lon", "lat", x.alias("x"), y.alias("y")).select(F.greatest(F.abs(lon - F.col("lon")), F.abs(lat - F.col("lat"))).alias("off"))
        assert back.agg(F.max("off")).first()[0] < 1e-9


def test_a_layer_in_feet_is_ingested(spark, tmp_path):
    from lotwise.operators import parcels
    from lotwise.plans import reports

    x, y = geo.NORTH_CAROLINA_FEET.xy(F.lit(-79.2), F.lit(35.5))
    at = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    box = [(at["x"], at["y"]), (at["x"] + 300, at["y"]), (at["x"] + 300, at["y"] + 300), (at["x"], at["y"] + 300)]
    tie = [box[0], box[2], box[1], box[3]]
    layer = spark.createDataFrame([(0, [tuple(p) for p in box], "P1"), (1, [tuple(p) for p in tie], "P2")], "seq long, ring array<struct<x:double,y:double>>, PARID string")
    meta = {r["key"]: r["value"] for r in reports.ingest(layer, str(tmp_path), "lots.shp", "lots", geo.NORTH_CAROLINA_FEET).collect()}
    rows = spark.read.parquet(f"{tmp_path}/parcels").orderBy("id").collect()
    feet = (300 * 1200 / 3937) ** 2
    assert meta["feature_count"] == "2" and abs(rows[0]["area_m2"] / feet - 1) < 2e-3 and len(rows[1]["shape"]) == 2
    assert abs(rows[0]["minx"] + 79.2) < 1e-5 and abs(rows[0]["miny"] - 35.5) < 1e-5
    stored = spark.read.parquet(f"{tmp_path}/parcels")
    assert parcels.in_box(stored, (-79.3, 35.4, -79.1, 35.6)).count() == 2
