"""The registered queries: each operator on the views of the test tables, with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.functions import geo
from lotwise.functions import measures as M
from lotwise.operators import accuracy, change, neighbourhood, parcels, render, rollup, scenes, simulate, structures, zonal
from lotwise.params import BANDS, CLASSES, NOT_STRUCTURES, STOREY_FACTOR
from lotwise.plans.assessment import assess
from lotwise.sources import files
from lotwise.sources import testviews as V
from lotwise.sources.tables import stored

BOX = (-79.1752, 35.4790, -79.1701, 35.4822)
GSD = 2.0

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Registers a query; ``views`` are put before the SQL as WITH entries."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            head = ", ".join(V.SQL_VIEWS[v] for v in views)
            text = sql.strip()
            if head and text.upper().startswith("WITH "):
                text = f"WITH {head}, {text[5:]}"
            elif head:
                text = f"WITH {head} {text}"
            ORACLE_SQL[name] = text
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.bround(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# -- parcels -----------------------------------------------------------------------------------------------------------

_P = "id, pin, parid, owner, address"


@query("parcel_lookup", f"SELECT {_P} FROM parcels WHERE id = 77", ("parcels",))
def parcel_lookup(spark, d):
    return parcels.by_id(V.parcels(spark, d), 77).select(*_P.split(", "))


@query("find_by_pin", f"SELECT {_P} FROM parcels WHERE pin = 'P12' OR parid = 'P12'", ("parcels",))
def find_by_pin(spark, d):
    return parcels.by_pin(V.parcels(spark, d), "P12").select(*_P.split(", "))


@query("get_many_ordered", "SELECT id, pos, pin FROM parcels JOIN (SELECT id, CAST(max(pos) AS INTEGER) AS pos FROM (VALUES (9, 0), (3, 1), (140, 2), (3, 3), (999999999, 4)) AS v(id, pos) GROUP BY id) USING (id)", ("parcels",))
def get_many_ordered(spark, d):
    return parcels.many(V.parcels(spark, d), [9, 3, 140, 3, 999999999]).select("id", "pos", "pin")


@query("text_search", "SELECT id, address, owner FROM parcels WHERE upper(address) LIKE '%MACH%' OR upper(owner) LIKE '%MACH%' OR upper(pin) LIKE '%MACH%' OR upper(parid) LIKE '%MACH%' ORDER BY id LIMIT 25", ("parcels",))
def text_search(spark, d):
    return parcels.search(V.parcels(spark, d), " mach ").select("id", "address", "owner")


@query("bbox_candidates", f"SELECT id, minx, miny FROM parcels WHERE maxx >= {BOX[0]}e0 AND minx <= {BOX[2]}e0 AND maxy >= {BOX[1]}e0 AND miny <= {BOX[3]}e0", ("parcels",))
def bbox_candidates(spark, d):
    return parcels.candidates(V.parcels(spark, d), BOX).select("id", "minx", "miny")


@query(
    "bbox_precise_box",
    f"""SELECT id, round_even(s * 1e9, 4) AS shared FROM (SELECT id, greatest(0e0, least(maxx, {BOX[2]}e0) - greatest(minx, {BOX[0]}e0)) * greatest(0e0, least(maxy, {BOX[3]}e0) - greatest(miny, {BOX[1]}e0)) AS s FROM parcels)
    WHERE s > 0 ORDER BY id LIMIT 40""",
    ("parcels",),
)
def bbox_precise_box(spark, d):
    return parcels.in_box(V.parcels(spark, d), BOX, 40).select("id", F.bround(F.col("shared") * 1e9, 4).alias("shared"))


RING = [(-79.1790, 35.4785), (-79.1600, 35.4790), (-79.1650, 35.4900), (-79.1780, 35.4880)]


@query(
    "parcels_in_ring",
    f"""WITH e AS (SELECT * FROM (VALUES {", ".join(f"({RING[i][0]}e0, {RING[i][1]}e0, {RING[(i + 1) % 4][0]}e0, {RING[(i + 1) % 4][1]}e0)" for i in range(4))}) AS v(ax, ay, qx, qy)),
    c AS (SELECT id, unnest([minx, maxx, maxx, minx]) AS x, unnest([miny, miny, maxy, maxy]) AS y FROM parcels),
    apart AS (SELECT id FROM c, e GROUP BY id, ax, ay HAVING max((qx - ax) * (y - ay) - (qy - ay) * (x - ax)) < 0)
    SELECT id FROM parcels WHERE id NOT IN (SELECT id FROM apart) AND maxx >= {min(p[0] for p in RING)}e0 AND minx <= {max(p[0] for p in RING)}e0 AND maxy >= {min(p[1] for p in RING)}e0 AND miny <= {max(p[1] for p in RING)}e0""",
    ("parcels",),
)
def parcels_in_ring(spark, d):
    return parcels.in_ring(V.parcels(spark, d), RING).select("id")


@query("extent", "SELECT min(minx) AS west, min(miny) AS south, max(maxx) AS east, max(maxy) AS north, count(*) AS n FROM parcels", ("parcels",))
def extent(spark, d):
    return parcels.extent(V.parcels(spark, d))


@query("parcel_label", "SELECT id, coalesce(nullif(address, ''), nullif(pin, ''), nullif(parid, ''), concat('parcel ', CAST(id AS VARCHAR))) AS label FROM parcels", ("parcels",))
def parcel_label(spark, d):
    return V.parcels(spark, d).select("id", M.label(F.col("address"), F.col("pin"), F.col("parid"), F.col("id")).alias("label"))


@query(
    "coerce_fields",
    """SELECT event_id, nullif(trim(event_type), '') AS kind, nullif(CAST(trunc(TRY_CAST(nullif(CASE WHEN event_id % 7 = 0 THEN 'x' ELSE CAST(event_id % 50 / 10e0 AS VARCHAR) END, '') AS DOUBLE)) AS INTEGER), 0) AS whole,
       TRY_CAST(CASE WHEN event_id % 7 = 0 THEN '' ELSE CAST(event_id % 5 AS VARCHAR) END AS DOUBLE) AS real FROM events""",
)
def coerce_fields(spark, d):
    raw = V.table(spark, d, "events")
    odd = F.col("event_id") % 7 == 0
    return raw.select(
        "event_id",
        files.coerced(F.col("event_type"), "text").alias("kind"),
        files.coerced(F.when(odd, "x").otherwise((F.col("event_id") % 50 / 10.0).cast("string")), "int").alias("whole"),
        files.coerced(F.when(odd, "").otherwise((F.col("event_id") % 5).cast("string")), "real").alias("real"),
    )


@query(
    "upsert_replace",
    """WITH new AS (SELECT o_custkey + 1 AS id, concat('NEW ', CAST(arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS VARCHAR)) AS owner FROM orders GROUP BY o_custkey)
    SELECT id, owner FROM new UNION ALL SELECT id, owner FROM parcels WHERE id NOT IN (SELECT id FROM new)""",
    ("parcels",),
)
def upsert_replace(spark, d):
    new = V.table(spark, d, "orders").select((F.col("o_custkey") + 1).alias("id"), F.concat(F.lit("NEW "), F.col("o_orderkey").cast("string")).alias("owner"), F.struct("o_orderdate", "o_orderkey").alias("ord"))
    return parcels.upsert(V.parcels(spark, d).select("id", "owner"), new)


@query("parcels_by_subdivision", "SELECT subdivision, count(*) AS parcels, round_even(sum(apr_bldg), 2) AS value, round_even(count(*) / sum(count(*)) OVER (), 6) AS share FROM parcels GROUP BY subdivision", ("parcels",))
def parcels_by_subdivision(spark, d):
    g = V.parcels(spark, d).groupBy("subdivision").agg(F.count("*").alias("parcels"), F.sum("apr_bldg").alias("value"))
    total = g.agg(F.sum("parcels").alias("n"))
    return g.crossJoin(F.broadcast(total)).select("subdivision", "parcels", F.bround("value", 2).alias("value"), F.bround(F.col("parcels") / F.col("n"), 6).alias("share"))


# -- geometry ----------------------------------------------------------------------------------------------------------

_CENTRE = "c AS (SELECT id, (minx + maxx) / 2e0 AS lon, (miny + maxy) / 2e0 AS lat FROM parcels)"


def _centres(spark, d):
    return V.parcels(spark, d).select("id", ((F.col("minx") + F.col("maxx")) / 2).alias("lon"), ((F.col("miny") + F.col("maxy")) / 2).alias("lat"))


_E, _R0 = geo._ECC, geo.K0 * geo._RADIUS
_UTM = f"""WITH {_CENTRE},
  a AS (SELECT id, radians(lat) AS phi, radians(lon + 81e0) AS lam FROM c),
  t AS (SELECT id, lam, sinh(atanh(sin(phi)) - {_E!r}e0 * atanh({_E!r}e0 * sin(phi))) AS t FROM a),
  x AS (SELECT id, atan2(t, cos(lam)) AS xi, asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam))) AS eta FROM t)
  SELECT id, round_even(500000e0 + {_R0!r}e0 * (eta {"".join(f" + ({a!r}) * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(geo._FORWARD, 1))}), 4) AS x,
    round_even({_R0!r}e0 * (xi {"".join(f" + ({a!r}) * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(geo._FORWARD, 1))}), 4) AS y FROM x"""


@query("utm_forward", _UTM.replace(f"({geo._FORWARD[2]!r})", f"({geo._FORWARD[2]!r})"), ("parcels",))
def utm_forward(spark, d):
    x, y = geo.utm_xy(F.col("lon"), F.col("lat"), F.lit(17))
    return rounded(_centres(spark, d).select("id", x.alias("x"), y.alias("y")), 4)


@query("utm_round_trip", f"WITH {_CENTRE} SELECT id, round_even(lon, 10) AS lon, round_even(lat, 10) AS lat FROM c", ("parcels",))
def utm_round_trip(spark, d):
    """Forward and back gives the start."""
    x, y = geo.utm_xy(F.col("lon"), F.col("lat"), F.lit(17))
    out = _centres(spark, d).select("id", x.alias("x"), y.alias("y"))
    lon, lat = geo.utm_lonlat(F.col("x"), F.col("y"), F.lit(17))
    return rounded(out.select("id", lon.alias("lon"), lat.alias("lat")), 10)


@query("utm_zone", "SELECT id, zone, CASE WHEN lat >= 0 THEN 32600 + zone ELSE 32700 + zone END AS epsg FROM (SELECT c_custkey AS id, CAST((floor(((c_custkey * 37 % 360) - 180e0 + 180e0) / 6e0) % 60) + 1 AS INTEGER) AS zone, (c_custkey * 13 % 160) - 80e0 AS lat FROM customer)")
def utm_zone(spark, d):
    lon, lat = F.col("c_custkey") * 37 % 360 - 180.0, F.col("c_custkey") * 13 % 160 - 80.0
    return V.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), geo.utm_zone(lon).alias("zone"), geo.utm_epsg(lon, lat).alias("epsg"))


@query("bbox_area", "SELECT id, round_even(abs(111.320e0 * cos(radians((miny + maxy) / 2e0)) * (maxx - minx) * 110.574e0 * (maxy - miny)), 9) AS km2 FROM parcels", ("parcels",))
def bbox_area(spark, d):
    return rounded(V.parcels(spark, d).select("id", geo.bbox_km2(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy")).alias("km2")), 9)


@query(
    "buffer_bbox",
    "SELECT id, round_even(minx - dx, 9) AS w, round_even(miny - dy, 9) AS s, round_even(maxx + dx, 9) AS e, round_even(maxy + dy, 9) AS n FROM (SELECT *, 40e0 / 111320e0 AS dy, 40e0 / greatest(1e0, 111320e0 * cos(radians((miny + maxy) / 2e0))) AS dx FROM parcels)",
    ("parcels",),
)
def buffer_bbox(spark, d):
    w, s, e, n = geo.buffered(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"), 40.0)
    return rounded(V.parcels(spark, d).select("id", w.alias("w"), s.alias("s"), e.alias("e"), n.alias("n")), 9)


@query("ring_area_shoelace", "SELECT id, round_even((maxx - minx) * (maxy - miny) * 1e9, 3) AS area FROM parcels", ("parcels",))
def ring_area_shoelace(spark, d):
    ring = geo.box_ring(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"))
    return V.parcels(spark, d).select("id", F.bround(geo.ring_area(ring) * 1e9, 3).alias("area"))


@query("unit_hash", "SELECT c_custkey AS id, round_even(CAST(('0x' || substr(sha256(concat('event|', CAST(c_custkey AS VARCHAR))), 1, 16))::UBIGINT % 1000003 AS DOUBLE) / 1000003e0, 9) AS h FROM customer")
def unit_hash(spark, d):
    return rounded(V.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), M.unit_hash(F.lit("event"), F.col("c_custkey").cast("string")).alias("h")), 9)


@query(
    "stable_jitter",
    "SELECT id, round_even(((h & 255) / 255e0 - 0.5e0) * 14e0, 9) AS dx, round_even((((h >> 8) & 255) / 255e0 - 0.5e0) * 14e0, 9) AS dy, round_even(((h >> 16) & 255) / 255e0 * 180e0, 9) AS angle FROM (SELECT id, (id * 7 * 2654435761) % 4294967296 AS h FROM parcels)",
    ("parcels",),
)
def stable_jitter(spark, d):
    dx, dy, angle = M.jitter(F.col("id") * 7, 7.0)
    return rounded(V.parcels(spark, d).select("id", dx.alias("dx"), dy.alias("dy"), angle.alias("angle")), 9)


# -- structures --------------------------------------------------------------------------------------------------------

_NOT = " OR ".join(f"contains(upper(ob_desc), '{w}')" for w in NOT_STRUCTURES)
_IS = f"coalesce(ob_desc, '') <> '' AND NOT ({_NOT})"
_FACTOR = "CASE upper(trim(coalesce(dwel_desc, ''))) " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in STOREY_FACTOR.items()) + " ELSE 1.2e0 END"
_ROOFM2 = f"greatest(20e0, dwel_sfla * 0.09290304e0 / ({_FACTOR}))"


@query("building_filter", f"SELECT id, ob_desc, coalesce({_IS}, false) AS is_structure FROM parcels", ("parcels",))
def building_filter(spark, d):
    return V.parcels(spark, d).select("id", "ob_desc", M.is_structure(F.col("ob_desc")).alias("is_structure"))


@query("storey_footprint", f"SELECT id, CASE WHEN dwel_sfla IS NOT NULL THEN round_even({_ROOFM2}, 6) END AS m2 FROM parcels", ("parcels",))
def storey_footprint(spark, d):
    return rounded(V.parcels(spark, d).select("id", F.when(F.col("dwel_sfla").isNotNull(), M.roof_m2(F.col("dwel_sfla"), F.col("dwel_desc"))).alias("m2")))


_STRUCTURES = f"""h AS (SELECT id AS parcel_id, 'dwelling' AS kind, least({_ROOFM2}, greatest(20e0, area_m2 * 0.6e0)) AS area_m2, dwel_desc AS description FROM parcels WHERE coalesce(dwel_sfla, 0) > 0),
  o AS (SELECT id AS parcel_id, 'outbuilding' AS kind, least(greatest(10e0, ob_area * 0.09290304e0), greatest(20e0, area_m2 * 0.6e0)) AS area_m2, ob_desc AS description FROM parcels WHERE coalesce(ob_area, 0) > 0 AND {_IS}),
  u AS (SELECT * FROM h UNION ALL SELECT * FROM o),
  structures AS (SELECT *, CAST(row_number() OVER (PARTITION BY parcel_id ORDER BY kind) - 1 AS INTEGER) AS ord FROM u)"""


@query("taxroll_structures", f"WITH {_STRUCTURES} SELECT parcel_id, ord, kind, round_even(area_m2, 6) AS area_m2, concat('p', CAST(parcel_id AS VARCHAR), '-', substr(kind, 1, 3), CAST(ord AS VARCHAR)) AS id, round_even(sqrt(area_m2 * 1.35e0), 6) AS width FROM structures", ("parcels",))
def taxroll_structures(spark, d):
    return rounded(structures.from_tax_roll(V.parcels(spark, d)).select("parcel_id", "ord", "kind", "area_m2", "id", "width"))


_FP = "f AS (SELECT fid, kind, x0, y0, x0 + w AS x1, y0 + w AS y1 FROM footprints)"


def _footprints(spark, d):
    return V.footprints(spark, d).select("fid", "kind", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("w")).alias("y1"))


@query(
    "footprint_overlap_join",
    f"""WITH {_FP}, o AS (SELECT fid, id, (least(x1, maxx) - greatest(x0, minx)) * (least(y1, maxy) - greatest(y0, miny)) AS a FROM f JOIN parcels ON x1 > minx AND x0 < maxx AND y1 > miny AND y0 < maxy),
    b AS (SELECT fid, arg_max(id, (a, -id)) AS parcel_id, max(a) AS a FROM o WHERE a > 0 GROUP BY fid)
    SELECT fid, kind, parcel_id, round_even(a * 1e10, 2) AS overlap FROM f LEFT JOIN b USING (fid)""",
    ("parcels", "footprints"),
)
def footprint_overlap_join(spark, d):
    out = structures.overlapping(_footprints(spark, d), V.parcels(spark, d), 0.002)
    return out.select("fid", "kind", "parcel_id", F.bround(F.col("overlap") * 1e10, 2).alias("overlap"))


@query("source_fallback_ratio", "SELECT (SELECT count(*) FROM part) AS mapped, (SELECT count(*) FROM customer) AS parcels, CASE WHEN 100e0 * (SELECT count(*) FROM part) / (SELECT count(*) FROM customer) >= 25 THEN 'mapped' ELSE 'tax-roll' END AS source")
def source_fallback_ratio(spark, d):
    mapped, lots = V.footprints(spark, d).count(), V.parcels(spark, d).count()
    return spark.createDataFrame([(mapped, lots, structures.choose_source(mapped, lots, False))], "mapped long, parcels long, source string")


# -- zones -------------------------------------------------------------------------------------------------------------

_PX = "px AS (SELECT *, pre_valid AND post_valid AS valid FROM pixels)"
_USED = f"{_PX}, used AS (SELECT * FROM px WHERE zone > 0 AND valid)"


def _pixels(spark, d):
    return change.with_valid(V.pixels(spark, d))


@query(
    "rasterize_labels",
    """WITH z AS (SELECT id AS zone, lot_col * 10e0 AS x0, lot_row * 10e0 AS y0, lot_col * 10e0 + 9e0 AS x1, lot_row * 10e0 + 11.5e0 AS y1 FROM parcels)
    SELECT "row", col, max(zone) AS zone FROM z, unnest(range(CAST(y0 AS BIGINT), CAST(y1 AS BIGINT) + 2)) AS r("row"), unnest(range(CAST(x0 AS BIGINT), CAST(x1 AS BIGINT) + 2)) AS c(col)
    WHERE col + 0.5e0 > x0 AND col + 0.5e0 < x1 AND "row" + 0.5e0 >= y0 AND "row" + 0.5e0 < y1 GROUP BY "row", col""",
    ("parcels",),
)
def rasterize_labels(spark, d):
    """Lots that reach into the next row of lots: the later lot wins."""
    x, y = F.col("lot_col") * 10.0, F.col("lot_row") * 10.0
    zones = V.parcels(spark, d).select(F.col("id").alias("zone"), F.col("id").alias("ord"), geo.box_ring(x, y, x + 9.0, y + 11.5).alias("ring"))
    return zonal.label_rings(zones)


@query("zonal_mean", f"WITH {_USED} SELECT zone, count(*) AS pixels, round_even(avg(pre_nir), 6) AS nir, round_even(avg(post_red), 6) AS red FROM used GROUP BY zone", ("pixels",))
def zonal_mean(spark, d):
    return rounded(zonal.stats(_pixels(spark, d), {"nir": "pre_nir", "red": "post_red"}))


@query("zonal_fraction", f"WITH {_USED} SELECT zone, round_even(avg(CASE WHEN roof THEN 1e0 ELSE 0e0 END), 6) AS roof FROM used GROUP BY zone", ("pixels",))
def zonal_fraction(spark, d):
    return rounded(zonal.stats(_pixels(spark, d), {"roof": "roof"}).drop("pixels"))


@query(
    "zonal_quantile_nearest_rank",
    f"WITH {_USED}, r AS (SELECT zone, post_red, row_number() OVER (PARTITION BY zone ORDER BY post_red) AS r, count(*) OVER (PARTITION BY zone) AS n FROM used) SELECT zone, round_even(post_red, 9) AS p75 FROM r WHERE r = CAST(round_even(0.75e0 * (n - 1), 0) AS BIGINT) + 1",
    ("pixels",),
)
def zonal_quantile_nearest_rank(spark, d):
    return rounded(zonal.nearest_rank(_pixels(spark, d), "post_red", 0.75, "p75"), 9)


@query("zonal_max", f"WITH {_USED} SELECT zone, round_even(max(post_nir), 9) AS nir FROM used GROUP BY zone", ("pixels",))
def zonal_max(spark, d):
    return rounded(zonal.nearest_rank(_pixels(spark, d), "post_nir", 1.0, "nir"), 9)


@query("absent_zones", f"WITH {_USED}, s AS (SELECT zone, count(*) AS n, avg(pre_red) AS red FROM used GROUP BY zone) SELECT id AS zone, coalesce(n, 0) AS pixels, round_even(red, 6) AS red FROM parcels LEFT JOIN s ON zone = id", ("parcels", "pixels"))
def absent_zones(spark, d):
    return rounded(zonal.for_all(V.parcels(spark, d).select(F.col("id").alias("zone")), zonal.stats(_pixels(spark, d), {"red": "pre_red"})))


@query("coverage", f"WITH {_PX} SELECT round_even(avg(CASE WHEN valid THEN 1e0 ELSE 0e0 END), 9) AS coverage FROM px", ("pixels",))
def coverage(spark, d):
    return rounded(_pixels(spark, d).agg(F.avg(F.col("valid").cast("double")).alias("coverage")), 9)


# -- neighbourhoods ----------------------------------------------------------------------------------------------------


def _box_sql(values: str, size: int, source: str) -> str:
    """Means over the clamped neighbourhood, by joining each pixel with its ``size`` x ``size`` neighbours."""
    r = size // 2
    return f"""b AS (SELECT max("row") AS mr, max(col) AS mc FROM {source}),
    nb AS (SELECT p."row", p.col, least(greatest(p."row" + dr, 0), mr) AS nr, least(greatest(p.col + dc, 0), mc) AS nc FROM {source} p, b, unnest(range({-r}, {r + 1})) AS x(dr), unnest(range({-r}, {r + 1})) AS y(dc)),
    m AS (SELECT nb."row", nb.col, {values} FROM nb JOIN {source} q ON q."row" = nb.nr AND q.col = nb.nc GROUP BY nb."row", nb.col)"""


@query("box_filter", f"""WITH {_box_sql("avg(q.pre_red) AS red", 5, "pixels")} SELECT "row", col, round_even(red, 9) AS red FROM m""", ("pixels",))
def box_filter(spark, d):
    return rounded(neighbourhood.box_mean(V.pixels(spark, d).select("row", "col", F.col("pre_red").alias("red")), ["red"], 5), 9)


_SSIM = """CASE WHEN den = 0 THEN 1e0 ELSE least(greatest((2 * a * b + 0.000025e0) * (2 * (ab - a * b) + 0.000225e0) / den, -1e0), 1e0) END"""


@query(
    "ssim",
    f"""WITH {_box_sql("avg(q.pre_red) AS a, avg(q.post_red) AS b, avg(q.pre_red * q.pre_red) AS aa, avg(q.post_red * q.post_red) AS bb, avg(q.pre_red * q.post_red) AS ab", 7, "pixels")},
    s AS (SELECT *, (a * a + b * b + 0.000025e0) * ((aa - a * a) + (bb - b * b) + 0.000225e0) AS den FROM m) SELECT "row", col, round_even({_SSIM}, 5) AS ssim FROM s""",
    ("pixels",),
)
def ssim(spark, d):
    return rounded(neighbourhood.ssim(V.pixels(spark, d), "pre_red", "post_red").select("row", "col", "ssim"), 5)


@query(
    "windowed_mean",
    f"""WITH {_PX}, {_box_sql("avg(CASE WHEN q.valid THEN q.post_red ELSE 0e0 END) AS t, avg(CASE WHEN q.valid THEN 1e0 ELSE 0e0 END) AS w", 5, "px")}
    SELECT "row", col, round_even(CASE WHEN w > 0.15e0 THEN t / w ELSE 0e0 END, 6) AS m FROM m""",
    ("pixels",),
)
def windowed_mean(spark, d):
    return rounded(neighbourhood.windowed_mean(_pixels(spark, d), "post_red", "valid", 5, "m").select("row", "col", "m"))


@query(
    "focus_scores",
    f"""WITH {_PX}, {_box_sql("avg(CASE WHEN q.valid THEN q.post_red ELSE 0e0 END) AS t, avg(CASE WHEN q.valid THEN 1e0 ELSE 0e0 END) AS w", 3, "px")}, {_box_sql("avg(CASE WHEN q.valid THEN q.post_red ELSE 0e0 END) AS t, avg(CASE WHEN q.valid THEN 1e0 ELSE 0e0 END) AS w", 5, "px").replace("b AS", "b5 AS").replace(", b,", ", b5,").replace("nb AS", "nb5 AS").replace("FROM nb", "FROM nb5 nb").replace("m AS", "m5 AS")},
    u AS (SELECT *, 3 AS size FROM m UNION ALL SELECT *, 5 AS size FROM m5)
    SELECT zone, round_even(max(CASE WHEN w > 0.15e0 THEN t / w ELSE 0e0 END), 6) AS focus FROM u JOIN px USING ("row", col) WHERE zone > 0 AND valid AND size = CASE WHEN zone % 2 = 0 THEN 3 ELSE 5 END GROUP BY zone""",
    ("pixels",),
)
def focus_scores(spark, d):
    sizes = V.parcels(spark, d).select(F.col("id").alias("zone"), F.when(F.col("id") % 2 == 0, 3).otherwise(5).alias("size"))
    return rounded(neighbourhood.focus_scores(_pixels(spark, d), sizes, "post_red"))


@query(
    "focus_window_size",
    """SELECT l_orderkey, l_linenumber, CAST(list_min(list_transform([3, 5, 7, 9, 13, 17, 25], lambda s: CASE WHEN s >= greatest(3, CAST(round_even(sqrt(greatest(l_extendedprice / 10e0, 25e0)) / 2e0, 0) AS INTEGER) | 1) THEN s ELSE 25 END)) AS INTEGER) AS size
    FROM lineitem""",
)
def focus_window_size(spark, d):
    """The window for a patch of as many square metres as a tenth of each line's price."""
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", M.focus_size(F.col("l_extendedprice") / 10.0, F.lit(GSD)).alias("size"))


@query("shift_apply", """SELECT p."row", p.col, round_even(coalesce(q.pre_red, 0e0), 9) AS red FROM pixels p LEFT JOIN pixels q ON p."row" = q."row" + 3 AND p.col = q.col - 2""", ("pixels",))
def shift_apply(spark, d):
    px = V.pixels(spark, d).select("row", "col", F.col("pre_red").alias("red"))
    return rounded(change.shift_by(px, ["red"], 3, -2), 9)


@query("estimate_shift")
def estimate_shift(spark, d):
    """The later image is the earlier one, moved by (3, -2); expected is the move back."""
    px = V.pixels(spark, d).select("row", "col", "pre_red", F.col("pre_red").alias("moved"), F.lit(True).alias("valid"))
    return change.estimate_shift(change.shift_by(px, ["moved"], 3, -2), "pre_red", "moved")


# -- change ------------------------------------------------------------------------------------------------------------


def _index_sql(a: str, b: str) -> str:
    return f"CASE WHEN abs({a} + {b}) > 1e-6 THEN least(greatest(({a} - {b}) / ({a} + {b}), -1e0), 1e0) ELSE 0e0 END"


@query("ndvi_ndwi", f"""SELECT "row", col, round_even({_index_sql("pre_nir", "pre_red")}, 6) AS ndvi, round_even({_index_sql("post_green", "post_nir")}, 6) AS ndwi FROM pixels""", ("pixels",))
def ndvi_ndwi(spark, d):
    c = F.col
    return rounded(V.pixels(spark, d).select("row", "col", M.ndvi(c("pre_nir"), c("pre_red")).alias("ndvi"), M.ndwi(c("post_green"), c("post_nir")).alias("ndwi")))


_RAW = "sqrt((" + " + ".join(f"(post_{b} - pre_{b}) * (post_{b} - pre_{b})" for b in BANDS) + ") / 4e0)"
_STABLE = f"""{_PX}, q AS (SELECT *, {_RAW} AS raw, valid AND {_index_sql("pre_nir", "pre_red")} < 0.3e0 AND {_index_sql("post_nir", "post_red")} < 0.3e0 AS plain FROM px),
  g AS (SELECT count(*) FILTER (plain) AS np, count(*) FILTER (valid) AS nv, quantile_cont(raw, 0.4) FILTER (plain) AS cp, quantile_cont(raw, 0.4) FILTER (valid) AS cv FROM q),
  st AS (SELECT q.*, CASE WHEN (CASE WHEN np < 2048 THEN nv ELSE np END) < 256 THEN valid ELSE (CASE WHEN np < 2048 THEN valid ELSE plain END) AND raw <= (CASE WHEN np < 2048 THEN cv ELSE cp END) END AS stable FROM q, g)"""


@query("stable_pixels", f"WITH {_STABLE} SELECT zone, count(*) FILTER (stable) AS stable FROM st GROUP BY zone", ("pixels",))
def stable_pixels(spark, d):
    return change.stable_pixels(stored(_pixels(spark, d))).groupBy("zone").agg(F.count_if("stable").alias("stable"))


def _fit_sql() -> str:
    use = "us AS (SELECT *, CASE WHEN (SELECT count(*) FROM st WHERE valid AND stable) < 256 THEN valid ELSE valid AND stable END AS use FROM st)"
    one = "f1 AS (SELECT " + ", ".join(f"regr_slope(pre_{b}, post_{b}) FILTER (use) AS g_{b}, regr_intercept(pre_{b}, post_{b}) FILTER (use) AS o_{b}" for b in BANDS) + " FROM us)"
    off = {b: f"abs(pre_{b} - (post_{b} * g_{b} + o_{b}))" for b in BANDS}
    cut = "cu AS (SELECT " + ", ".join(f"quantile_cont({off[b]}, 0.8) FILTER (use) AS c_{b}" for b in BANDS) + " FROM us, f1)"
    two = "f2 AS (SELECT " + ", ".join(f"regr_slope(pre_{b}, post_{b}) FILTER (use AND {off[b]} <= c_{b}) AS gain_{b}, regr_intercept(pre_{b}, post_{b}) FILTER (use AND {off[b]} <= c_{b}) AS offset_{b}" for b in BANDS) + " FROM us, f1, cu)"
    sane = "f3 AS (SELECT " + ", ".join(f"CASE WHEN gain_{b} BETWEEN 0.6e0 AND 1.7e0 THEN gain_{b} ELSE 1e0 END AS gain_{b}, CASE WHEN gain_{b} BETWEEN 0.6e0 AND 1.7e0 THEN offset_{b} ELSE 0e0 END AS offset_{b}" for b in BANDS) + " FROM f2)"
    return ", ".join([_STABLE, use, one, cut, two, sane])


@query("ols_fit_trimmed", "WITH " + _fit_sql() + " SELECT " + ", ".join(f"round_even(gain_{b}, 6) AS gain_{b}, round_even(offset_{b}, 6) AS offset_{b}" for b in BANDS) + " FROM f3", ("pixels",))
def ols_fit_trimmed(spark, d):
    fits = change.band_fits(change.stable_pixels(stored(_pixels(spark, d))))
    return rounded(spark.range(1).select(*[F.lit(v).alias(f"{k}_{b}") for b, pair in fits.items() for k, v in zip(("gain", "offset"), pair)]))


_NORM = "no AS (SELECT px.* REPLACE (" + ", ".join(f"post_{b} * gain_{b} + offset_{b} AS post_{b}" for b in BANDS) + ") FROM px, f3)"
_GREY = "(({0}_red + {0}_green + {0}_blue) / 3e0)"


def _score_sql() -> str:
    gr = f"gr AS (SELECT *, {_GREY.format('pre')} AS ga, {_GREY.format('post')} AS gb FROM no)"
    box = _box_sql("avg(q.ga) AS a, avg(q.gb) AS b, avg(q.ga * q.ga) AS aa, avg(q.gb * q.gb) AS bb, avg(q.ga * q.gb) AS ab", 7, "gr")
    s = "sm AS (SELECT *, (a * a + b * b + 0.000025e0) * ((aa - a * a) + (bb - b * b) + 0.000225e0) AS den FROM m)"
    me = f"""me AS (SELECT gr.*, {_RAW} AS magnitude, least(greatest(1e0 - ({_SSIM}), 0e0), 1e0) AS structure_loss, {_index_sql("pre_nir", "pre_red")} AS v0, {_index_sql("post_nir", "post_red")} AS v1, {_index_sql("pre_green", "pre_nir")} AS w0, {_index_sql("post_green", "post_nir")} AS w1 FROM gr JOIN sm USING ("row", col))"""
    fl = "fl AS (SELECT *, valid AND w1 > 0.05e0 AND w1 - w0 > 0.1e0 AS flooded, valid AND v0 > 0.3e0 AS veg, valid AND v0 > 0.3e0 AND v1 - v0 < -0.18e0 AS vegetation_loss, (0.55e0 * least(magnitude / 0.11e0, 1e0) + 0.45e0 * least(structure_loss / 0.45e0, 1e0)) AS s0 FROM me)"
    sc = "ch AS (SELECT *, CASE WHEN valid THEN least(greatest(CASE WHEN veg THEN s0 * 0.35e0 ELSE s0 END, CASE WHEN flooded THEN 0.45e0 ELSE 0e0 END, 0e0), 1e0) ELSE 0e0 END AS score FROM fl)"
    return ", ".join([_fit_sql(), _NORM, gr, box, s, me, fl, sc])


_CHANGE = _score_sql()


@query("damage_score", f"""WITH {_CHANGE} SELECT "row", col, round_even(score, 4) AS score, flooded, vegetation_loss, round_even(magnitude, 5) AS magnitude FROM ch""", ("pixels",))
def damage_score(spark, d):
    out = change.detect(V.pixels(spark, d)).select("row", "col", F.bround("score", 4).alias("score"), "flooded", "vegetation_loss", F.bround("magnitude", 5).alias("magnitude"))
    return out


@query(
    "change_summary",
    f"""WITH {_CHANGE} SELECT round_even(avg(CASE WHEN valid THEN 1e0 ELSE 0e0 END), 6) AS coverage, round_even(avg(score) FILTER (valid), 6) AS mean_score, round_even(quantile_cont(score, 0.95) FILTER (valid), 6) AS p95_score,
    round_even(avg(CASE WHEN flooded THEN 1e0 ELSE 0e0 END) FILTER (valid), 6) AS flooded_share, round_even(avg(CASE WHEN vegetation_loss THEN 1e0 ELSE 0e0 END) FILTER (valid), 6) AS vegetation_share FROM ch""",
    ("pixels",),
)
def change_summary(spark, d):
    return rounded(change.summary(change.detect(V.pixels(spark, d))))


def _class_sql(s: str) -> str:
    return f"CASE WHEN {s} IS NULL OR isnan({s}) THEN 'none' WHEN {s} < 0.16e0 THEN 'none' WHEN {s} < 0.33e0 THEN 'possible' WHEN {s} < 0.55e0 THEN 'moderate' WHEN {s} < 0.78e0 THEN 'severe' ELSE 'destroyed' END"


@query("classify", f"SELECT event_id, {_class_sql('s')} AS damage_class FROM (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN 'NaN'::DOUBLE ELSE abs(value) / 100e0 END AS s FROM events)")
def classify(spark, d):
    s = F.when(F.col("event_id") % 17 == 0, None).when(F.col("event_id") % 19 == 0, float("nan")).otherwise(F.abs("value") / 100.0)
    return V.table(spark, d, "events").select("event_id", M.damage_class(s).alias("damage_class"))


@query(
    "confidence",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p <= 0 THEN 'low' WHEN a THEN CASE WHEN p >= 12 AND m / 4e0 >= 4 THEN 'medium' ELSE 'low' END WHEN p >= 20 AND m / 4e0 >= 12 THEN 'high' WHEN p >= 6 AND m / 4e0 >= 2 THEN 'medium' ELSE 'low' END AS confidence
    FROM (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS INTEGER) - 2 AS p, l_linenumber % 2 = 0 AS a, l_partkey % 120 * 1e0 AS m FROM lineitem)""",
)
def confidence(spark, d):
    p, a, m = F.col("l_quantity").cast("int") - 2, F.col("l_linenumber") % 2 == 0, F.col("l_partkey") % 120 * 1.0
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", M.confidence(p, a, F.lit(GSD), m).alias("confidence"))


# -- roll-up -----------------------------------------------------------------------------------------------------------

_FOCUS_ONE = "focus AS (SELECT zone, max(CASE WHEN w > 0.15e0 THEN t / w ELSE 0e0 END) AS focus FROM fu JOIN ch USING (\"row\", col) WHERE zone > 0 AND valid AND size = (SELECT size FROM sz WHERE sz.zone = ch.zone) GROUP BY zone)"


def _rollup_sql() -> str:
    parts = [_CHANGE, _STRUCTURES]
    parts.append("sz AS (SELECT parcel_id AS zone, min(CASE WHEN s >= greatest(3, CAST(round_even(sqrt(greatest(b, 25e0)) / 2e0, 0) AS INTEGER) | 1) THEN s ELSE 25 END) AS size FROM (SELECT parcel_id, max(area_m2) AS b FROM structures GROUP BY parcel_id), (VALUES (3), (5), (7), (9), (13), (17), (25)) AS v(s) GROUP BY parcel_id)")
    # windowed means through integral sums over a clamped grid: each pixel with its neighbours, per window size in use
    parts.append("bd AS (SELECT max(\"row\") AS mr, max(col) AS mc FROM ch)")
    parts.append(
        "nf AS (SELECT p.zone, p.\"row\", p.col, sz.size, least(greatest(p.\"row\" + dr, 0), mr) AS nr, least(greatest(p.col + dc, 0), mc) AS nc FROM ch p JOIN sz ON sz.zone = p.zone, bd, unnest(range(-(CAST(size / 2 AS BIGINT)), CAST(size / 2 AS BIGINT) + 1)) AS x(dr), unnest(range(-(CAST(size / 2 AS BIGINT)), CAST(size / 2 AS BIGINT) + 1)) AS y(dc) WHERE p.valid AND p.\"row\" % 10 BETWEEN 1 AND 7 AND p.col % 10 BETWEEN 1 AND 7)".replace(
            "CAST(size / 2 AS BIGINT)", "(size // 2)"
        )
    )
    parts.append("fm AS (SELECT nf.zone, nf.\"row\", nf.col, avg(CASE WHEN q.valid THEN q.score ELSE 0e0 END) AS t, avg(CASE WHEN q.valid THEN 1e0 ELSE 0e0 END) AS w FROM nf JOIN ch q ON q.\"row\" = nf.nr AND q.col = nf.nc GROUP BY ALL)")
    parts.append("fo AS (SELECT zone, max(CASE WHEN w > 0.15e0 THEN t / w ELSE 0e0 END) AS focus FROM fm GROUP BY zone)")
    parts.append("zs AS (SELECT zone, count(*) AS pixels, avg(magnitude) AS magnitude, avg(structure_loss) AS structure_loss, avg(v1 - v0) AS ndvi_delta, avg(CASE WHEN flooded THEN 1e0 ELSE 0e0 END) AS flooded FROM ch WHERE zone > 0 AND valid AND \"row\" % 10 BETWEEN 1 AND 7 AND col % 10 BETWEEN 1 AND 7 GROUP BY zone)")
    parts.append(
        f"scored AS (SELECT s.parcel_id, s.ord, s.kind, s.area_m2, focus AS score, {_class_sql('focus')} AS damage_class, coalesce(pixels, 0) AS pixels, magnitude, zs.structure_loss, zs.ndvi_delta, zs.flooded AS flooded_fraction, s.description, CASE WHEN coalesce(pixels, 0) <= 0 THEN 'low' WHEN pixels >= 12 AND area_m2 / 4e0 >= 4 THEN 'medium' ELSE 'low' END AS confidence FROM structures s LEFT JOIN fo ON fo.zone = parcel_id LEFT JOIN zs ON zs.zone = parcel_id)"
    )
    rank = "CASE damage_class " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CLASSES)) + " END"
    factor = "CASE damage_class WHEN 'none' THEN 0e0 WHEN 'possible' THEN 0.05e0 WHEN 'moderate' THEN 0.25e0 WHEN 'severe' THEN 0.6e0 ELSE 1e0 END"
    parts.append("ps AS (SELECT zone AS id, count(*) FILTER (valid) AS pixels, avg(CASE WHEN valid THEN 1e0 ELSE 0e0 END) AS coverage, avg(score) FILTER (valid) AS score, avg(CASE WHEN flooded THEN 1e0 ELSE 0e0 END) FILTER (valid) AS flooded, avg(CASE WHEN vegetation_loss THEN 1e0 ELSE 0e0 END) FILTER (valid) AS veg, avg(CASE WHEN score >= 0.33e0 THEN 1e0 ELSE 0e0 END) FILTER (valid) AS changed FROM ch WHERE zone > 0 GROUP BY zone)")
    parts.append(f"sc AS (SELECT parcel_id AS id, count(*) AS structures, {', '.join(f'count(*) FILTER (damage_class = {chr(39)}{c}{chr(39)}) AS n_{c}' for c in CLASSES)}, max({rank}) AS worst, sum(area_m2 * {factor}) AS lost, sum(area_m2) AS area FROM scored GROUP BY parcel_id)")
    own = _class_sql("ps.score")
    names = "CASE worst " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLASSES)) + " END"
    zero = ", ".join(f"coalesce(n_{c}, 0) AS n_{c}" for c in CLASSES)
    parts.append(
        f"rolled AS (SELECT p.id, coalesce(structures, 0) AS structures, {zero}, coalesce({names}, {own}) AS worst_class, ps.score AS parcel_score, ps.flooded AS flooded_fraction, ps.veg AS vegetation_loss_fraction, changed * area_m2 AS changed_area_m2, CASE WHEN apr_bldg <> 0 AND structures IS NOT NULL THEN lost / CASE WHEN area = 0 THEN 1e0 ELSE area END * apr_bldg END AS estimated_loss, coalesce(ps.pixels, 0) AS pixels, coalesce(ps.coverage, 0e0) AS coverage FROM parcels p LEFT JOIN sc USING (id) LEFT JOIN ps USING (id))"
    )
    return ", ".join(parts)


_ROLLUP = _rollup_sql()


def _lots(spark, d):
    x, y = F.col("lot_col") * 10.0, F.col("lot_row") * 10.0
    return V.parcels(spark, d).select(F.col("id").alias("parcel_id"), x.alias("x0"), y.alias("y0"), (x + 9.0).alias("x1"), (y + 9.0).alias("y1"))


def _assessed(spark, d):
    return assess(V.parcels(spark, d), V.pixels(spark, d), GSD, lots=_lots(spark, d))


@query("structure_rollup", f"WITH {_ROLLUP} SELECT parcel_id, ord, kind, round_even(score, 3) AS score, damage_class, pixels, confidence, round_even(magnitude, 4) AS magnitude FROM scored", ("parcels", "pixels"))
def structure_rollup(spark, d):
    out = _assessed(spark, d).structures
    return out.select("parcel_id", "ord", "kind", F.bround("score", 3).alias("score"), "damage_class", "pixels", "confidence", F.bround("magnitude", 4).alias("magnitude"))


_BAR = ", ".join(f"({k}, '{c}')" for k, c in enumerate(CLASSES))


@query(
    "class_bar",
    f"""WITH {_ROLLUP} SELECT rank, c.damage_class, count(s.damage_class) AS structures, round_even(count(s.damage_class) / sum(count(s.damage_class)) OVER (), 6) AS share
    FROM (VALUES {_BAR}) AS c(rank, damage_class) LEFT JOIN scored s USING (damage_class) GROUP BY rank, c.damage_class""",
    ("parcels", "pixels"),
)
def class_bar(spark, d):
    return rollup.class_bar(_assessed(spark, d).structures).withColumn("share", F.bround("share", 6))


@query(
    "structures_by_parcel",
    f"WITH {_ROLLUP} SELECT parcel_id, count(*) AS structures, string_agg(ord || ':' || damage_class, ',' ORDER BY ord) AS classes FROM scored GROUP BY parcel_id",
    ("parcels", "pixels"),
)
def structures_by_parcel(spark, d):
    listed = rollup.by_parcel(_assessed(spark, d).structures.select("parcel_id", "ord", "damage_class"))
    each = F.transform("structures", lambda s: F.concat(s["ord"].cast("string"), F.lit(":"), s["damage_class"]))
    return listed.select("parcel_id", F.size("structures").cast("long").alias("structures"), F.array_join(each, ",").alias("classes"))


_ROLLED = ", ".join(["id", "structures", *[f"n_{c}" for c in CLASSES], "worst_class"])


@query("parcel_rollup", f"WITH {_ROLLUP} SELECT {_ROLLED}, round_even(parcel_score, 4) AS parcel_score, round_even(flooded_fraction, 6) AS flooded_fraction, pixels, round_even(coverage, 6) AS coverage FROM rolled", ("parcels", "pixels"))
def parcel_rollup(spark, d):
    out = _assessed(spark, d).parcels
    return out.select(*_ROLLED.split(", "), F.bround("parcel_score", 4).alias("parcel_score"), F.bround("flooded_fraction", 6).alias("flooded_fraction"), "pixels", F.bround("coverage", 6).alias("coverage"))


@query("loss_estimate", f"WITH {_ROLLUP} SELECT id, worst_class, round_even(estimated_loss, 2) AS estimated_loss, round_even(changed_area_m2, 4) AS changed_area_m2 FROM rolled", ("parcels", "pixels"))
def loss_estimate(spark, d):
    return _assessed(spark, d).parcels.select("id", "worst_class", F.bround("estimated_loss", 2).alias("estimated_loss"), F.bround("changed_area_m2", 4).alias("changed_area_m2"))


@query(
    "summary",
    f"WITH {_ROLLUP} SELECT count(*) AS parcels, CAST(sum(structures) AS BIGINT) AS structures, {', '.join(f'CAST(sum(n_{c}) AS BIGINT) AS n_{c}' for c in CLASSES)}, CAST(sum(n_moderate + n_severe + n_destroyed) AS BIGINT) AS damaged, count(*) FILTER (worst_class <> 'none') AS affected, count(*) FILTER (flooded_fraction > 0.05e0) AS flooded_parcels, round_even(sum(estimated_loss), 0) AS estimated_loss FROM rolled",
    ("parcels", "pixels"),
)
def summary(spark, d):
    return rounded(_assessed(spark, d).summary, 0)


@query("worst_first_top60", f"WITH {_ROLLUP} SELECT id, worst_class, round_even(parcel_score, 3) AS score FROM rolled WHERE worst_class <> 'none' ORDER BY CASE worst_class {' '.join(f'WHEN {chr(39)}{c}{chr(39)} THEN {i}' for i, c in enumerate(CLASSES))} END DESC, round_even(coalesce(parcel_score, 0), 6) DESC, id LIMIT 60", ("parcels", "pixels"))
def worst_first_top60(spark, d):
    return rollup.worst_first(_assessed(spark, d).parcels, 60).select("id", "worst_class", F.bround("parcel_score", 3).alias("score"))


@query("warnings", f"WITH {_ROLLUP} SELECT 1 AS ord, concat(CAST(count(*) FILTER (coverage < 0.5e0) AS VARCHAR), ' of ', CAST(count(*) AS VARCHAR), ' parcels had under half of their pixels usable on both dates') AS warning FROM rolled UNION ALL SELECT 2, 'structure outlines are approximate'", ("parcels", "pixels"))
def warnings(spark, d):
    return rollup.warnings(_assessed(spark, d).parcels)


@query("geojson_features")
def geojson_features(spark, d):
    ring = geo.box_ring(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"))
    return V.parcels(spark, d).select("id", files.feature_json(["id", "pin", "address"], ring).alias("feature"))


@query("render_ramp", f"SELECT kind, count(*) AS n FROM (SELECT {_class_sql('abs(value) / 100e0')} AS kind FROM events) GROUP BY kind")
def render_ramp(spark, d):
    """Colours map back to their classes."""
    px = V.table(spark, d, "events").select(M.ramp(F.abs("value") / 100.0, F.lit(True)).alias("c"))
    kind = F.when(F.col("c.a") == 0, "none").when(F.col("c.g") == 213, "possible").when(F.col("c.g") == 152, "moderate").when(F.col("c.g") == 57, "severe").otherwise("destroyed")
    return px.select(kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "percentile_stretch",
    """WITH v AS (SELECT unnest([pre_red, pre_green, pre_blue]) AS v FROM pixels WHERE pre_valid), g AS (SELECT quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM v)
    SELECT "row", col, CASE WHEN pre_valid THEN CAST(round_even(pow(least(greatest((pre_red - lo) / greatest(hi - lo, 1e-6), 0e0), 1e0), 1e0 / 1.35e0) * 255e0, 0) AS INTEGER) ELSE 0 END AS red FROM pixels, g""",
    ("pixels",),
)
def percentile_stretch(spark, d):
    px = stored(V.pixels(spark, d).select("row", "col", "pre_red", "pre_green", "pre_blue", "pre_valid"))
    return render.stretched(px, ["pre_red", "pre_green", "pre_blue"], "pre_valid").select("row", "col", F.col("pre_red").alias("red"))


@query("raster_overview", """SELECT CAST(floor("row" / 4e0) AS BIGINT) AS "row", CAST(floor(col / 4e0) AS BIGINT) AS col, round_even(avg(pre_red), 9) AS pre_red FROM pixels GROUP BY 1, 2""", ("pixels",))
def raster_overview(spark, d):
    return rounded(render.overview(V.pixels(spark, d), "pre_red", 4), 9)


# -- scenes and simulation ---------------------------------------------------------------------------------------------


@query(
    "scene_search",
    """WITH f AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY datetime, id) AS r FROM scenes WHERE CAST(datetime AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND west <= -79.16e0 AND west + 0.1e0 >= -79.2e0 AND (provider <> 'catalogue' OR cloud <= 40))
    SELECT id, provider, round_even(cloud, 6) AS cloud FROM f WHERE r <= 40""",
    ("scenes",),
)
def scene_search(spark, d):
    out = scenes.search(V.scenes(spark, d), "2024-01-05", "2024-01-20", -79.2, -79.16, 40, 40.0)
    return rounded(out.select("id", "provider", "cloud"))


@query("scene_label", "SELECT id, concat_ws(' | ', strftime(datetime, '%Y-%m-%d'), platform, CASE WHEN cloud IS NOT NULL THEN CAST(CAST(round_even(cloud, 0) AS INTEGER) AS VARCHAR) || '% cloud' END, CASE WHEN synthetic THEN 'SYNTHETIC' END) AS label FROM scenes", ("scenes",))
def scene_label(spark, d):
    return V.scenes(spark, d).select("id", scenes.label().alias("label"))


@query(
    "scene_records",
    """SELECT id, strftime(datetime, '%Y-%m-%d') AS date, 'catalogue' AS collection, round_even(cloud, 6) AS cloud, synthetic,
      concat_ws(' | ', strftime(datetime, '%Y-%m-%d'), CASE WHEN id % 5 = 0 THEN 'catalogue' ELSE platform END, CASE provider WHEN 'local' THEN '0.6 m' WHEN 'demo' THEN '1 m' END,
        CASE WHEN cloud IS NOT NULL THEN CAST(CAST(round_even(cloud, 0) AS INTEGER) AS VARCHAR) || '% cloud' END, CASE WHEN synthetic THEN 'SYNTHETIC' END) AS label FROM scenes""",
    ("scenes",),
)
def scene_records(spark, d):
    size = F.when(F.col("provider") == "local", 0.6).when(F.col("provider") == "demo", 1.0)
    given = V.scenes(spark, d).withColumns({"collection": F.lit("catalogue"), "platform": F.when(F.col("id") % 5 != 0, F.col("platform")), "gsd": size})
    record = F.from_json("record", "date string, collection string, cloud_cover double, synthetic boolean, label string").alias("r")
    return scenes.records(given).select("id", record).select("id", "r.date", "r.collection", F.bround("r.cloud_cover", 6).alias("cloud"), "r.synthetic", "r.label")


@query("least_cloudy_scene", "SELECT provider, arg_min(id, (coalesce(cloud, 100e0), id)) AS id, round_even(min(coalesce(cloud, 100e0)), 6) AS cloud FROM scenes GROUP BY provider", ("scenes",))
def least_cloudy_scene(spark, d):
    return rounded(scenes.clearest(V.scenes(spark, d), ["provider"]).select("provider", "id", "cloud"))


@query(
    "scene_either_side",
    """WITH s AS (SELECT *, CASE WHEN CAST(datetime AS DATE) < DATE '2024-01-15' AND CAST(datetime AS DATE) >= DATE '2024-01-05' THEN 'before' WHEN CAST(datetime AS DATE) > DATE '2024-01-15' AND CAST(datetime AS DATE) <= DATE '2024-01-22' THEN 'after' END AS side FROM scenes)
    SELECT side, arg_min(id, (coalesce(cloud, 100e0), id)) AS id, round_even(min(coalesce(cloud, 100e0)), 6) AS cloud FROM s WHERE side IS NOT NULL GROUP BY side""",
    ("scenes",),
)
def scene_either_side(spark, d):
    return rounded(scenes.either_side(V.scenes(spark, d), "2024-01-15", 10, 7).select("side", "id", "cloud"))


@query(
    "demo_calendar",
    """WITH e AS (SELECT CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b, CAST(CAST(min(ts) AS DATE) + INTERVAL 15 DAY AS DATE) AS hit FROM events),
    d AS (SELECT CAST(DATE '2020-01-01' + INTERVAL 1 DAY * (12 * k) AS DATE) AS day FROM range(1000) AS t(k) UNION SELECT CAST(hit - INTERVAL 6 DAY AS DATE) FROM e UNION SELECT CAST(hit + INTERVAL 4 DAY AS DATE) FROM e)
    SELECT strftime(day, '%Y-%m-%d') AS day, concat('demo-', strftime(day, '%Y-%m-%d')) AS id, day > hit AS after_event FROM d, e WHERE day BETWEEN a AND b""",
)
def demo_calendar(spark, d):
    """Scene dates over the days of the events, around the sixteenth of them."""
    r = V.table(spark, d, "events").agg(*[F.date_format(c, "yyyy-MM-dd").alias(n) for n, c in {"a": F.min("ts"), "b": F.max("ts"), "hit": F.date_add(F.to_date(F.min("ts")), 15)}.items()]).first()
    return scenes.calendar(spark, r["a"], r["b"], r["hit"]).withColumn("day", scenes.date(F.col("day")))


@query(
    "simulated_truth",
    """WITH r AS (SELECT id, CAST(('0x' || substr(sha256(concat('storm|p', CAST(id AS VARCHAR))), 1, 16))::UBIGINT % 1000003 AS DOUBLE) / 1000003e0 AS roll,
      least(greatest(exp(-pow((lot_col * 10e0 * cos(radians(30e0)) - lot_row * 10e0 * sin(radians(30e0)) - 200e0) / 90e0, 2)), 0e0), 1e0) * 0.9e0 AS p FROM parcels)
    SELECT id, CASE WHEN roll < p * 0.32e0 THEN 'destroyed' WHEN roll < p * 0.62e0 THEN 'major' WHEN roll < p * 0.92e0 THEN 'minor' ELSE 'intact' END AS state FROM r""",
    ("parcels",),
)
def simulated_truth(spark, d):
    across = F.col("lot_col") * 10.0 * F.cos(F.radians(F.lit(30.0))) - F.col("lot_row") * 10.0 * F.sin(F.radians(F.lit(30.0))) - 200.0
    level = F.exp(-F.pow(across / 90.0, F.lit(2)))
    return V.parcels(spark, d).select("id", simulate.damage(F.concat(F.lit("p"), F.col("id").cast("string")), "storm", level, 0.9).alias("state"))


@query("phenology", "SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day, round_even(0.55e0 + 0.45e0 * (0.5e0 - 0.5e0 * cos(2e0 * 3.141592653589793e0 * (dayofyear(ts) - 20) / 365.25e0)), 9) AS greenness FROM events")
def phenology(spark, d):
    day = V.table(spark, d, "events").select(F.to_date("ts").alias("day")).distinct()
    return rounded(day.select(scenes.date(F.col("day")).alias("day"), simulate.phenology(F.col("day")).alias("greenness")), 9)


@query("world_noise")
def world_noise(spark, d):
    px = V.pixels(spark, d).select("row", "col")
    return px.select("row", "col", simulate.lattice_noise(F.col("col") * 2.0, F.col("row") * 2.0, 64.0).alias("noise"))


# -- accuracy ----------------------------------------------------------------------------------------------------------

_SCORED = "(SELECT l_orderkey, l_quantity / 60e0 AS score, (l_partkey * 31 + l_suppkey) % 100 < 2 * l_quantity AS truth FROM lineitem)"


def _labelled(spark, d):
    return V.table(spark, d, "labels").select((F.col("toxic") == 1).alias("truth"), (F.col("quality") == 0).alias("pred"))


def _scored(spark, d):
    return V.table(spark, d, "lineitem").select((F.col("l_quantity") / 60.0).alias("score"), ((F.col("l_partkey") * 31 + F.col("l_suppkey")) % 100 < 2 * F.col("l_quantity")).alias("truth"))


@query(
    "binary_metrics",
    """WITH c AS (SELECT count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic <> 1 AND quality = 0) AS fp, count(*) FILTER (toxic = 1 AND quality <> 0) AS fn, count(*) FILTER (toxic <> 1 AND quality <> 0) AS tn FROM labels),
    r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0e0) AS p, coalesce(tp / nullif(tp + fn, 0), 0e0) AS r FROM c)
    SELECT tp, fp, fn, tn, round_even(p, 9) AS "precision", round_even(r, 9) AS recall, round_even(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0e0), 9) AS accuracy, round_even(coalesce(2 * p * r / nullif(p + r, 0), 0e0), 9) AS f1 FROM r""",
)
def binary_metrics(spark, d):
    return rounded(accuracy.binary(_labelled(spark, d)), 9)


@query("confusion_pivot", "SELECT toxic AS truth, count(*) FILTER (quality = 0) AS \"0\", count(*) FILTER (quality = 1) AS \"1\" FROM labels GROUP BY toxic")
def confusion_pivot(spark, d):
    return accuracy.confusion(V.table(spark, d, "labels").select(F.col("toxic").alias("truth"), F.col("quality").alias("pred")), [0, 1])


@query(
    "threshold_sweep",
    f"""WITH s AS {_SCORED}, t AS (SELECT CAST(k AS INTEGER) AS k, 0.05e0 + k * 0.005e0 AS threshold FROM range(161) AS r(k)), h AS (SELECT score, count(*) FILTER (truth) AS t, count(*) FILTER (NOT truth) AS f FROM s GROUP BY score),
    c AS (SELECT k, CAST(sum(CASE WHEN score >= threshold - 1e-11 THEN t ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN score >= threshold - 1e-11 THEN f ELSE 0 END) AS BIGINT) AS fp, CAST(sum(t) AS BIGINT) AS a FROM t, h GROUP BY k)
    SELECT k, tp, fp, a - tp AS fn, round_even(coalesce(2e0 * tp / nullif(2 * tp + fp + a - tp, 0), 0e0), 9) AS f1 FROM c""",
)
def threshold_sweep(spark, d):
    return rounded(accuracy.sweep(_scored(spark, d)).drop("threshold"), 9)


@query("score_quantiles_by_state", f"SELECT truth AS state, round_even(quantile_cont(score, 0.1), 9) AS p10, round_even(quantile_cont(score, 0.5), 9) AS p50, round_even(quantile_cont(score, 0.9), 9) AS p90, count(*) AS n FROM {_SCORED} GROUP BY truth")
def score_quantiles_by_state(spark, d):
    return rounded(accuracy.quantiles_by(_scored(spark, d).withColumnRenamed("truth", "state"), "state"), 9)


@query("loss_by_quarter", "SELECT date_trunc('quarter', o_orderdate) AS quarter, o_orderpriority, round_even(sum(o_totalprice), 2) AS value, count(*) AS n FROM orders GROUP BY ALL")
def loss_by_quarter(spark, d):
    out = V.table(spark, d, "orders").groupBy(F.date_trunc("quarter", "o_orderdate").alias("quarter"), "o_orderpriority").agg(F.bround(F.sum("o_totalprice"), 2).alias("value"), F.count("*").alias("n"))
    return out
