"""Registered queries over polygons of any form: overlap, areas, labelling with holes, cores of lots."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.functions import geo, shapes
from lotwise.operators import parcels, rings, structures, zonal
from lotwise.plans.queries import query
from lotwise.sources import testviews as V

#: An area with a bay and a hole, and the boxes that it is made of.
AREA = [
    [(-79.1790, 35.4785), (-79.1600, 35.4785), (-79.1600, 35.4900), (-79.1660, 35.4900), (-79.1660, 35.4827), (-79.1731, 35.4827), (-79.1731, 35.4900), (-79.1790, 35.4900)],
    [(-79.1774, 35.4793), (-79.1774, 35.4817), (-79.1701, 35.4817), (-79.1701, 35.4793)],
]
_AREA_BOXES = (
    (-79.1790, 35.4785, -79.1600, 35.4793), (-79.1790, 35.4793, -79.1774, 35.4817), (-79.1701, 35.4793, -79.1600, 35.4817), (-79.1790, 35.4817, -79.1600, 35.4827),
    (-79.1790, 35.4827, -79.1731, 35.4900), (-79.1660, 35.4827, -79.1600, 35.4900),
)
_SHARED = "greatest(0e0, least({0}.x1, {1}.x1) - greatest({0}.x0, {1}.x0)) * greatest(0e0, least({0}.y1, {1}.y1) - greatest({0}.y0, {1}.y0))"


@query(
    "parcels_meeting_area",
    f"""WITH a AS (SELECT * FROM (VALUES {", ".join("(" + ", ".join(f"{v}e0" for v in b) + ")" for b in _AREA_BOXES)}) AS v(x0, y0, x1, y1))
    SELECT l.id, round_even(sum({_SHARED.format("l", "a")}) * 1e9, 4) AS shared FROM lots l, a
    GROUP BY l.id HAVING bool_or(l.x1 >= a.x0 AND l.x0 <= a.x1 AND l.y1 >= a.y0 AND l.y0 <= a.y1)""",
    ("parcels", "lots"),
)
def parcels_meeting_area(spark, d):
    """Six-cornered lots and what they share with an area that has a bay and a hole."""
    return parcels.in_area(V.lots(spark, d), AREA).select("id", F.bround(F.col("shared") * 1e9, 4).alias("shared"))


_F_BOXES = """fb AS (SELECT fid, x0, y0, x0 + 2 * w AS x1, y0 + w AS y1, w FROM footprints UNION ALL SELECT fid, x0, y0 + w, x0 + w, y0 + 3 * w, w FROM footprints)"""


@query(
    "footprint_polygon_overlap",
    f"""WITH {_F_BOXES}, ov AS (SELECT f.fid, l.id, sum({_SHARED.format("f", "l")}) AS a, any_value(w) AS w FROM fb f JOIN lots l ON f.x1 > l.x0 AND f.x0 < l.x1 AND f.y1 > l.y0 AND f.y0 < l.y1 GROUP BY f.fid, l.id),
    b AS (SELECT fid, arg_max(id, (round_even(a / (6 * w * w), 9), -id)) AS parcel_id, max(a) AS overlap FROM ov WHERE a > 0 GROUP BY fid)
    SELECT fid, parcel_id, round_even(overlap * 1e9, 4) AS overlap FROM footprints LEFT JOIN b USING (fid)""",
    ("parcels", "lots", "footprints"),
)
def footprint_polygon_overlap(spark, d):
    """Six-cornered footprints with the six-cornered lot that they share most with."""
    own = V.footprints(spark, d).select("fid", "x0", "y0", (F.col("x0") + 2 * F.col("w")).alias("x1"), (F.col("y0") + 3 * F.col("w")).alias("y1"), V.notched("x0", "y0", "x0 + 2 * w", "y0 + 3 * w", "x0 + w", "y0 + w").alias("shape"))
    return structures.overlapping(own, V.lots(spark, d), 0.002).select("fid", "parcel_id", F.bround(F.col("overlap") * 1e9, 4).alias("overlap"))


@query(
    "box_of_shapes",
    f"""SELECT id, round_even(sum(greatest(0e0, least(x1, -79.1701e0) - greatest(x0, -79.1752e0)) * greatest(0e0, least(y1, 35.4822e0) - greatest(y0, 35.4790e0))) * 1e9, 4) AS shared
    FROM lots GROUP BY id HAVING shared > 0""",
    ("parcels", "lots"),
)
def box_of_shapes(spark, d):
    """Six-cornered lots in a box, with the area that lies in it."""
    return parcels.in_box(V.lots(spark, d), (-79.1752, 35.4790, -79.1701, 35.4822)).select("id", F.bround(F.col("shared") * 1e9, 4).alias("shared"))


@query(
    "label_shapes",
    """WITH z AS (SELECT id AS zone, lot_col * 10e0 AS x, lot_row * 10e0 AS y FROM parcels)
    SELECT "row", col, max(zone) AS zone FROM z, unnest(range(CAST(y AS BIGINT), CAST(y AS BIGINT) + 14)) AS r("row"), unnest(range(CAST(x AS BIGINT), CAST(x AS BIGINT) + 10)) AS c(col)
    WHERE (col + 0.5e0 >= x AND col + 0.5e0 < x + 9 AND "row" + 0.5e0 >= y AND "row" + 0.5e0 < y + 8.2e0 AND NOT (col + 0.5e0 >= x + 2.2e0 AND col + 0.5e0 < x + 5.7e0 AND "row" + 0.5e0 >= y + 3.1e0 AND "row" + 0.5e0 < y + 7.6e0))
       OR (col + 0.5e0 >= x + 3 AND col + 0.5e0 < x + 4.5e0 AND "row" + 0.5e0 >= y + 4 AND "row" + 0.5e0 < y + 6) OR (col + 0.5e0 >= x AND col + 0.5e0 < x + 3 AND "row" + 0.5e0 >= y + 10 AND "row" + 0.5e0 < y + 13) GROUP BY "row", col""",
    ("parcels",),
)
def label_shapes(spark, d):
    """Lots with a hole, an island in it and a second part that reaches into the next row of lots; the later lot wins."""
    at = lambda x0, y0, x1, y1: shapes.box(F.col("x") + x0, F.col("y") + y0, F.col("x") + x1, F.col("y") + y1)
    zones = V.parcels(spark, d).select(F.col("id").alias("zone"), F.col("id").alias("ord"), (F.col("lot_col") * 10.0).alias("x"), (F.col("lot_row") * 10.0).alias("y"))
    zones = zones.withColumn("shape", F.concat(at(0.0, 0.0, 9.0, 8.2), at(2.2, 3.1, 5.7, 7.6), at(3.0, 4.0, 4.5, 6.0), at(0.0, 10.0, 3.0, 13.0))).drop("x", "y")
    return zonal.label_rings(zones)


_SEG = "greatest({x0} - px, px - {x1}, 0e0) * greatest({x0} - px, px - {x1}, 0e0) + greatest({y0} - py, py - {y1}, 0e0) * greatest({y0} - py, py - {y1}, 0e0)"
_SIDES = [("0e0", "0e0", "w", "0e0"), ("w", "0e0", "w", "ym"), ("xm", "ym", "w", "ym"), ("xm", "ym", "xm", "h"), ("0e0", "h", "xm", "h"), ("0e0", "0e0", "0e0", "h")]


@query(
    "developed_core_shapes",
    f"""WITH l AS (SELECT c_custkey + 1 AS zone, 5e0 + 13e0 * (c_custkey % 5) AS w, 7e0 + 11e0 * (c_custkey % 4) AS h, 50e0 * (c_custkey % 9) AS b FROM customer),
    m AS (SELECT *, w * 0.55e0 AS xm, h * 0.3e0 + 0.2e0 * h * (zone % 3) AS ym FROM l),
    a AS (SELECT *, (w * ym + xm * (h - ym)) * 4 AS m2, CASE WHEN ym <= h / 2 THEN (ym + h) / 2 ELSE ym / 2 END AS cy, CASE WHEN ym <= h / 2 THEN xm / 2 ELSE w / 2 END AS cx, greatest(16e0, sqrt(greatest(b, 40e0) * 3.2e0)) / 2 AS radius FROM m),
    p AS (SELECT *, col + 0.5e0 AS px, "row" + 0.5e0 AS py FROM a, unnest(range(0, CAST(ceil(h) AS BIGINT))) AS r("row"), unnest(range(0, CAST(ceil(w) AS BIGINT))) AS c(col)),
    i AS (SELECT zone, "row", col, m2, least({", ".join(_SEG.format(x0=s[0], y0=s[1], x1=s[2], y1=s[3]) for s in _SIDES)}) >= 2.25e0 AS deep,
            m2 <= 4000 OR (px - cx) * (px - cx) + (py - cy) * (py - cy) < radius * radius AS near FROM p WHERE py < ym AND px < w AND py < h OR py >= ym AND py < h AND px < xm),
    z AS (SELECT zone, count(*) FILTER (deep) * 4 < 0.15e0 * max(m2) AS whole, count(*) FILTER (near) AS nn, count(*) FILTER (deep AND near) AS dn FROM i GROUP BY zone)
    SELECT zone, count(*) AS pixels, sum("row") AS rows, sum(col) AS cols FROM i JOIN z USING (zone) WHERE (whole OR deep) AND (CASE WHEN whole THEN nn ELSE dn END = 0 OR near) GROUP BY zone""",
)
def developed_core_shapes(spark, d):
    """The cores of six-cornered lots at two metres a pixel: how many pixels, and where."""
    k = F.col("c_custkey")
    lots = V.table(spark, d, "customer").select((k + 1).alias("zone"), k.alias("ord"), (5.0 + 13.0 * (k % 5)).alias("w"), (7.0 + 11.0 * (k % 4)).alias("h"), (50.0 * (k % 9)).alias("built_m2"))
    lots = lots.withColumns({"xm": F.col("w") * 0.55, "ym": F.col("h") * 0.3 + 0.2 * F.col("h") * (F.col("zone") % 3)})
    lots = lots.withColumn("shape", V.notched("0", "0", "w", "h", "xm", "ym")).select("zone", "ord", "shape", "built_m2")
    return structures.core_pixels(lots, 2.0).groupBy("zone").agg(F.count("*").alias("pixels"), F.sum("row").alias("rows"), F.sum("col").alias("cols"))


# -- layers of parcels -------------------------------------------------------------------------------------------------

_NC = "6378137e0 AS a, sqrt((2e0 - 1e0 / 298.257222101e0) / 298.257222101e0) AS e, radians(34e0 + 20e0 / 60e0) AS p1, radians(36e0 + 10e0 / 60e0) AS p2, radians(33.75e0) AS p0"
_M = "cos({0}) / sqrt(1 - pow(e * sin({0}), 2))"
_T = "tan(pi() / 4 - {0} / 2) / pow((1 - e * sin({0})) / (1 + e * sin({0})), e / 2)"


@query(
    "state_plane",
    f"""WITH k AS (SELECT {_NC}), n AS (SELECT *, (ln({_M.format("p1")}) - ln({_M.format("p2")})) / (ln({_T.format("p1")}) - ln({_T.format("p2")})) AS n FROM k),
    s AS (SELECT *, {_M.format("p1")} / (n * pow({_T.format("p1")}, n)) AS f FROM n), o AS (SELECT *, a * f * pow({_T.format("p0")}, n) AS rho0 FROM s),
    p AS (SELECT id, minx, miny, a * f * pow({_T.format("radians(miny)")}, n) AS rho, n * radians(minx + 79) AS th, rho0 FROM parcels, o)
    SELECT id, round_even((609601.2192024384e0 + rho * sin(th)) * 3937 / 1200, 4) AS x, round_even((rho0 - rho * cos(th)) * 3937 / 1200, 4) AS y, round_even(minx, 9) AS lon, round_even(miny, 9) AS lat FROM p""",
    ("parcels",),
)
def state_plane(spark, d):
    """Corners of parcels in survey feet of a conic projection, and back."""
    conic = geo.NORTH_CAROLINA_FEET
    x, y = conic.xy(F.col("minx"), F.col("miny"))
    there = V.parcels(spark, d).select("id", x.alias("x"), y.alias("y"))
    lon, lat = conic.lonlat(F.col("x"), F.col("y"))
    return there.select("id", F.bround("x", 4).alias("x"), F.bround("y", 4).alias("y"), F.bround(lon, 9).alias("lon"), F.bround(lat, 9).alias("lat"))


@query(
    "simplified_rings",
    """SELECT id, CAST(4 + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS points, round_even(((maxx - minx) * (maxy - miny) + CASE WHEN id % 3 = 0 THEN (maxx - minx) * 5e-5 / 2 ELSE 0 END) * 1e10, 2) AS area FROM parcels""",
    ("parcels",),
)
def simplified_rings(spark, d):
    """Boxes with two points of little weight on each of three sides, and one that matters on the fourth of every third."""
    p = lambda x, y: f"named_struct('x', {x}, 'y', {y})"
    x, y = "minx + (maxx - minx) * {0}e0", "miny + (maxy - miny) * {0}e0"
    line = [p("minx", "miny"), p(x.format(0.3), "miny + 4e-6"), p(x.format(0.6), "miny - 3e-6"), p("maxx", "miny"), p("maxx - 2e-6", y.format(0.5)), p("maxx", "maxy")]
    line += [p(x.format(0.5), "maxy + CASE WHEN id % 3 = 0 THEN 5e-5 ELSE 3e-6 END"), p("minx", "maxy"), p("minx + 5e-6", y.format(0.4)), p("minx", y.format(0.2)), p("minx", "miny")]
    lots = V.parcels(spark, d).select("id", F.expr(f"array(array({', '.join(line)}))").alias("shape"))
    out = rings.simplified(lots)
    return out.select("id", F.size(F.get("shape", F.lit(0))).cast("bigint").alias("points"), F.bround(shapes.area(F.col("shape")) * 1e10, 2).alias("area"))


@query(
    "repaired_rings",
    """SELECT id, CAST(CASE id % 3 WHEN 0 THEN 2 ELSE 1 END AS BIGINT) AS rings, round_even((maxx - minx) * (maxy - miny) * CASE id % 3 WHEN 0 THEN 0.5e0 ELSE 1e0 END * 1e10, 2) AS area FROM parcels""",
    ("parcels",),
)
def repaired_rings(spark, d):
    """Bow ties, boxes with a spike, and boxes that are right."""
    p = lambda x, y: f"named_struct('x', {x}, 'y', {y})"
    a, b, c, e = p("minx", "miny"), p("maxx", "miny"), p("maxx", "maxy"), p("minx", "maxy")
    spike = f"array({a}, {b}, {c}, {p('maxx + 0.001e0', 'maxy')}, {c}, {e})"
    lots = V.parcels(spark, d).select("id", F.expr(f"array(CASE id % 3 WHEN 0 THEN array({a}, {c}, {b}, {e}) WHEN 1 THEN {spike} ELSE array({a}, {b}, {c}, {e}) END)").alias("shape"))
    out = rings.repaired(lots)
    return out.select("id", F.size("shape").cast("bigint").alias("rings"), F.bround(F.aggregate(F.transform("shape", geo.ring_area), F.lit(0.0), lambda s, v: s + v) * 1e10, 2).alias("area"))
