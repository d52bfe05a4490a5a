"""More registered queries: mapped structures, grids, areas, result files, intake and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.functions import geo
from lotwise.operators import accuracy, change, parcels, render, rollup, scenes, structures, zonal
from lotwise.params import CLASSES
from lotwise.plans import reports
from lotwise.plans.queries import BOX, GSD, _CHANGE, _E, _PX, _R0, _ROLLUP, _assessed, _class_sql, _footprints, _pixels, query, rounded
from lotwise.sources import files
from lotwise.sources import testviews as V
from lotwise.sources.tables import stored

# -- mapped structures -------------------------------------------------------------------------------------------------

_SPAN = 'unnest(range(CAST(floor(y0) AS BIGINT), CAST(floor(y1) AS BIGINT) + 1)) AS r("row"), unnest(range(CAST(floor(x0) AS BIGINT), CAST(floor(x1) AS BIGINT) + 1)) AS c(col)'
_MAPPED = f"""f AS (SELECT fid, kind, x0, y0, x0 + w AS x1, y0 + w AS y1, w FROM footprints),
    ov AS (SELECT fid, id, (least(x1, maxx) - greatest(x0, minx)) * (least(y1, maxy) - greatest(y0, miny)) AS a FROM f JOIN parcels ON x1 > minx AND x0 < maxx AND y1 > miny AND y0 < maxy),
    ow AS (SELECT fid, arg_max(id, (a, -id)) AS parcel_id FROM ov WHERE a > 0 GROUP BY fid),
    bx AS (SELECT fid, kind, parcel_id, (x0 + 79.18e0) / 0.0006e0 * 10e0 AS x0, (y0 - 35.478e0) / 0.0006e0 * 10e0 AS y0, (x1 + 79.18e0) / 0.0006e0 * 10e0 AS x1, (y1 - 35.478e0) / 0.0006e0 * 10e0 AS y1, (w / 0.0006e0 * 20e0) * (w / 0.0006e0 * 20e0) AS m2 FROM f JOIN ow USING (fid)),
    lb AS (SELECT "row", col, arg_max(fid, (parcel_id, fid)) AS fid FROM bx, {_SPAN} WHERE col < x1 AND col + 1 > x0 AND "row" < y1 AND "row" + 1 > y0 GROUP BY "row", col),
    lp AS (SELECT lb.fid, ch.score, ch.flooded, row_number() OVER (PARTITION BY lb.fid ORDER BY ch.score) AS r, count(*) OVER (PARTITION BY lb.fid) AS n FROM ch JOIN lb USING ("row", col) WHERE valid),
    st2 AS (SELECT fid, count(*) AS pixels, avg(score) AS mean, max(CASE WHEN r = CAST(round_even(0.75e0 * (n - 1), 0) AS BIGINT) + 1 THEN score END) AS p75, avg(CASE WHEN flooded THEN 1e0 ELSE 0e0 END) AS flooded FROM lp GROUP BY fid),
    sc2 AS (SELECT fid, parcel_id, m2, coalesce(pixels, 0) AS pixels, CASE WHEN pixels >= 4 THEN p75 ELSE mean END AS score, flooded FROM bx LEFT JOIN st2 USING (fid))"""


def _mapped(spark, d):
    """Mapped footprints as structures with rings in pixels."""
    px, py = (lambda c: (F.col(c) + 79.18) / 0.0006 * 10), (lambda c: (F.col(c) - 35.478) / 0.0006 * 10)
    own = structures.overlapping(_footprints(spark, d), V.parcels(spark, d), 0.002).where("parcel_id is not null")
    side = (F.col("x1") - F.col("x0")) / 0.0006 * 20
    return own.select(
        "parcel_id", F.col("fid").cast("string").alias("id"), "kind", F.col("fid").alias("ord"), (side * side).alias("area_m2"), F.col("kind").alias("description"), F.lit(False).alias("approximate"),
        geo.box_ring(px("x0"), py("y0"), px("x1"), py("y1")).alias("ring"),
    )


@query(
    "footprint_rollup",
    f"""WITH {_CHANGE}, {_MAPPED} SELECT CAST(fid AS VARCHAR) AS id, parcel_id, pixels, round_even(score, 3) AS score, {_class_sql("score")} AS damage_class, round_even(flooded, 6) AS flooded_fraction,
    CASE WHEN pixels >= 20 AND m2 / 4e0 >= 12 THEN 'high' WHEN pixels >= 6 AND m2 / 4e0 >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM sc2""",
    ("parcels", "pixels", "footprints"),
)
def footprint_rollup(spark, d):
    """Each mapped structure is scored on its own pixels."""
    known = structures.with_zone(_mapped(spark, d))
    lots = V.parcels(spark, d).select(F.col("id").alias("parcel_id"), *[F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1")])
    labels = zonal.label_rings(structures.zones(known, lots, GSD), all_touched=True).withColumnRenamed("zone", "structure_zone")
    layers = stored(change.detect(V.pixels(spark, d)).join(labels, ["row", "col"], "left"))
    out = rollup.structure_scores(layers, known, GSD)
    return out.select("id", "parcel_id", "pixels", F.bround("score", 3).alias("score"), "damage_class", F.bround("flooded_fraction", 6).alias("flooded_fraction"), "confidence")


@query(
    "developed_core",
    """WITH l AS (SELECT c_custkey + 1 AS id, 6e0 + 13e0 * (c_custkey % 7) AS w, 9e0 + 11e0 * (c_custkey % 5) AS h, 50e0 * (c_custkey % 9) AS b FROM customer), c AS (SELECT *, CASE WHEN w <= 6 OR h <= 6 OR (w - 6) * (h - 6) < 0.15e0 * w * h THEN 0e0 ELSE 3e0 END AS i FROM l)
    SELECT id, round_even((w - 2 * i) * (h - 2 * i), 6) AS core_m2, CASE WHEN w * h > 4000 THEN round_even(greatest(16e0, sqrt(greatest(b, 40e0) * 3.2e0)), 6) END AS radius FROM c""",
)
def developed_core(spark, d):
    k = F.col("c_custkey")
    lots = V.table(spark, d, "customer").select((k + 1).alias("id"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (6.0 + 13.0 * (k % 7)).alias("x1"), (9.0 + 11.0 * (k % 5)).alias("y1"), (50.0 * (k % 9)).alias("built_m2"))
    out = structures.developed_core(lots)
    return out.select("id", F.bround(geo.ring_area(F.col("ring")), 6).alias("core_m2"), F.bround("radius", 6).alias("radius"))


@query("zonal_sum", f"WITH {_PX} SELECT zone, count(*) AS pixels, round_even(sum(pre_nir), 6) AS nir FROM px WHERE zone > 0 AND valid GROUP BY zone", ("pixels",))
def zonal_sum(spark, d):
    return rounded(zonal.totals(_pixels(spark, d), {"nir": "pre_nir"}))


@query("box_in_tile_join", "SELECT fid, count(*) AS n FROM (SELECT fid, x0, y0, x0 + w AS x1, y0 + w AS y1 FROM footprints) f JOIN parcels ON x1 >= minx AND x0 <= maxx AND y1 >= miny AND y0 <= maxy GROUP BY fid", ("parcels", "footprints"))
def box_in_tile_join(spark, d):
    """How many parcels' bounds each footprint meets."""
    return parcels.meeting(_footprints(spark, d), V.parcels(spark, d), 0.002).groupBy("fid").agg(F.count("*").alias("n"))


# -- change layers on their own ----------------------------------------------------------------------------------------


@query("change_layers", f"""WITH {_CHANGE} SELECT "row", col, round_even(structure_loss, 4) AS structure_loss, round_even(v1 - v0, 5) + 0e0 AS ndvi_delta, round_even(w1 - w0, 5) + 0e0 AS ndwi_delta, round_even(gb - ga, 6) + 0e0 AS brightness_delta, veg AS pre_vegetation FROM ch""", ("pixels",))
def change_layers(spark, d):
    out = change.detect(V.pixels(spark, d))
    return out.select("row", "col", F.bround("structure_loss", 4).alias("structure_loss"), F.bround("ndvi_delta", 5).alias("ndvi_delta"), F.bround("ndwi_delta", 5).alias("ndwi_delta"), F.bround("brightness_delta", 6).alias("brightness_delta"), "pre_vegetation")


@query("changed_area", f"WITH {_CHANGE} SELECT zone, count(*) FILTER (valid AND score >= 0.33e0) AS changed, count(*) FILTER (flooded) AS flooded, count(*) FILTER (vegetation_loss) AS vegetation FROM ch WHERE zone > 0 GROUP BY zone", ("pixels",))
def changed_area(spark, d):
    used = change.detect(V.pixels(spark, d)).where("zone > 0")
    return used.groupBy("zone").agg(F.count_if((F.col("score") >= 0.33) & F.col("valid")).alias("changed"), F.count_if("flooded").alias("flooded"), F.count_if("vegetation_loss").alias("vegetation"))


# -- geometry ----------------------------------------------------------------------------------------------------------


def _utm(points: str) -> str:
    """x and y of (id, k, lon, lat) in zone 17."""
    series = lambda f, g: "".join(f" + ({a!r}) * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, a in enumerate(geo._FORWARD, 1))
    return f"""a AS (SELECT id, k, radians(lat) AS phi, radians(lon + 81e0) AS lam FROM {points}),
    t AS (SELECT id, k, lam, sinh(atanh(sin(phi)) - {_E!r}e0 * atanh({_E!r}e0 * sin(phi))) AS t FROM a),
    e AS (SELECT id, k, atan2(t, cos(lam)) AS xi, asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam))) AS eta FROM t),
    utm AS (SELECT id, k, 500000e0 + {_R0!r}e0 * (eta {series("cos", "sinh")}) AS x, {_R0!r}e0 * (xi {series("sin", "cosh")}) AS y FROM e)"""


_CORNERS = "q AS (SELECT id, k, CASE WHEN k IN (0, 3) THEN minx ELSE maxx END AS lon, CASE WHEN k IN (0, 1) THEN miny ELSE maxy END AS lat FROM parcels, range(4) AS r(k))"


@query(
    "make_grid",
    f"""WITH {_CORNERS}, {_utm("q")}, b AS (SELECT id, floor(min(x) / 2e0) * 2e0 AS l, floor(min(y) / 2e0) * 2e0 AS b, ceil(max(x) / 2e0) * 2e0 AS r, ceil(max(y) / 2e0) * 2e0 AS t FROM utm GROUP BY id)
    SELECT id, 32617 AS epsg, l AS "left", b AS bottom, CAST(round((r - l) / 2e0) AS INTEGER) AS width, CAST(round((t - b) / 2e0) AS INTEGER) AS height FROM b""",
    ("parcels",),
)
def make_grid(spark, d):
    cells = geo.grid(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"), F.lit(GSD))
    return V.parcels(spark, d).select("id", *[cells[c].cast("double" if c in ("left", "bottom") else "int").alias(c) for c in ("epsg", "left", "bottom", "width", "height")])


@query("area_m2", f"WITH {_CORNERS}, {_utm('q')} SELECT p.id, round_even(abs(sum(p.x * n.y - n.x * p.y)) / 2e0, 1) AS m2 FROM (SELECT id, k, x - min(x) OVER w AS x, y - min(y) OVER w AS y FROM utm WINDOW w AS (PARTITION BY id)) p JOIN (SELECT id, (k + 3) % 4 AS k, x - min(x) OVER w AS x, y - min(y) OVER w AS y FROM utm WINDOW w AS (PARTITION BY id)) n USING (id, k) GROUP BY p.id", ("parcels",))
def area_m2(spark, d):
    ring = geo.box_ring(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"))
    return V.parcels(spark, d).select("id", F.bround(geo.ring_m2(ring), 1).alias("m2"))


@query(
    "clip_to_box",
    f"SELECT id, round_even(greatest(0e0, least(maxx, {BOX[2]}e0) - greatest(minx, {BOX[0]}e0)) * greatest(0e0, least(maxy, {BOX[3]}e0) - greatest(miny, {BOX[1]}e0)) * 1e10, 2) AS area FROM parcels",
    ("parcels",),
)
def clip_to_box(spark, d):
    """The part of each lot's ring in a box, by clipping."""
    ring = geo.box_ring(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"))
    return V.parcels(spark, d).select("id", F.bround(geo.ring_area(geo.clipped(ring, *map(F.lit, BOX))) * 1e10, 2).alias("area"))


# -- areas, intake, metadata -------------------------------------------------------------------------------------------


@query("resolve_aoi_ids", "WITH w AS (SELECT min(minx) AS w, min(miny) AS s, max(maxx) AS e, max(maxy) AS n FROM parcels WHERE id IN (3, 9, 77)) SELECT id, round_even(w - 40e0 / greatest(1e0, 111320e0 * cos(radians((s + n) / 2e0))), 9) AS west, round_even(n + 40e0 / 111320e0, 9) AS north FROM parcels, w WHERE id IN (3, 9, 77)", ("parcels",))
def resolve_aoi_ids(spark, d):
    box, found = reports.area_of(V.parcels(spark, d), ids=[3, 9, 77])
    return found.select("id", F.bround(F.lit(box[0]), 9).alias("west"), F.bround(F.lit(box[3]), 9).alias("north"))


@query("resolve_aoi_box", f"SELECT id FROM parcels WHERE least(maxx, {BOX[2]}e0) > greatest(minx, {BOX[0]}e0) AND least(maxy, {BOX[3]}e0) > greatest(miny, {BOX[1]}e0)", ("parcels",))
def resolve_aoi_box(spark, d):
    return reports.area_of(V.parcels(spark, d), box=BOX)[1].select("id")


@query(
    "ingest_rows",
    """SELECT id, nullif(trim(address), '') AS address, coalesce(CAST(CASE WHEN dwel_yrblt % 7 = 0 THEN NULL ELSE dwel_yrblt END AS VARCHAR), '') AS dwel_yrblt, apr_bldg, round_even((minx + maxx) / 2e0, 7) AS lon, round_even((miny + maxy) / 2e0, 7) AS lat, maxx FROM parcels WHERE id % 13 <> 0""",
    ("parcels",),
)
def ingest_rows(spark, d):
    """A layer with other field names, years as text, and lots without an area, whose ids stay free."""
    raw = V.parcels(spark, d).select(
        (F.col("id") - 1).alias("seq"), geo.box_ring(F.col("minx"), F.col("miny"), F.when(F.col("id") % 13 == 0, F.col("minx")).otherwise(F.col("maxx")), F.col("maxy")).alias("ring"),
        F.col("address").alias("SITUS"), F.when(F.col("dwel_yrblt") % 7 == 0, "0").otherwise(F.concat(F.col("dwel_yrblt").cast("string"), F.lit(".0"))).alias("YrBlt"), F.col("apr_bldg").cast("string").alias("BLDGVAL"),
    )
    year = F.coalesce(F.col("dwel_yrblt").cast("string"), F.lit("")).alias("dwel_yrblt")
    return reports.parcel_rows(raw).select("id", "address", year, "apr_bldg", "lon", "lat", "maxx")


@query("meta_json", "SELECT 'count' AS key, CAST(count(*) AS VARCHAR) AS value FROM parcels UNION ALL SELECT 'ids', concat('[', min(id), ',', max(id), ']') FROM parcels UNION ALL SELECT 'name', '\"Lots\"'", ("parcels",))
def meta_json(spark, d):
    row = V.parcels(spark, d).agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).first()
    meta = spark.createDataFrame([("name", '"old"')], "key string, value string")
    for key, value in (("name", F.lit("Lots")), ("count", F.lit(row["n"])), ("ids", F.array(F.lit(row["a"]), F.lit(row["b"])))):
        meta = parcels.set_meta(meta, key, value)
    return parcels.all_meta(meta)


# -- result files ------------------------------------------------------------------------------------------------------


def _text(x: str, kind: str) -> str:
    if kind == "real":
        return f"coalesce(CAST(CAST(round_even({x}, 4) AS DOUBLE) AS VARCHAR), '')"
    return f"CASE WHEN {x} THEN 'yes' ELSE 'no' END" if kind == "flag" else f"coalesce(CAST({x} AS VARCHAR), '')"


_REPORT = {
    "pin": ("pin", ""), "parid": ("parid", ""), "address": ("address", ""), "owner": ("owner", ""), "acres": ("acres", "real"), "damage_class": ("worst_class", ""), "parcel_score": ("round_even(parcel_score, 3)", "real"),
    "buildings_total": ("structures", ""), "buildings_damaged": ("n_moderate + n_severe + n_destroyed", ""), "buildings_changed": ("structures - n_none", ""), **{f"buildings_{c}": (f"n_{c}", "") for c in CLASSES},
    "flooded_fraction": ("round_even(flooded_fraction, 3)", "real"), "vegetation_loss_fraction": ("round_even(vegetation_loss_fraction, 3)", "real"), "changed_area_m2": ("round_even(changed_area_m2, 1)", "real"),
    "apr_bldg": ("apr_bldg", "real"), "estimated_loss_usd": ("round_even(estimated_loss, 0)", "real"), "coverage": ("round_even(coverage, 3)", "real"), "approximate_footprints": ("structures > 0", "flag"),
    "dwel_desc": ("dwel_desc", ""), "dwel_yrblt": ("dwel_yrblt", ""), "dwel_sfla": ("dwel_sfla", "real"), "lon": ("(minx + maxx) / 2e0", "real"), "lat": ("(miny + maxy) / 2e0", "real"), "tax_card": ("tax_card", ""),
}


def _with_centre(spark, d):
    return V.parcels(spark, d).withColumns({"lon": (F.col("minx") + F.col("maxx")) / 2, "lat": (F.col("miny") + F.col("maxy")) / 2})


@query(
    "parcels_csv_rows",
    f"WITH {_ROLLUP} SELECT {', '.join(f'{_text(*_REPORT[c])} AS {chr(34)}{h}{chr(34)}' for c, h in reports.PARCEL_HEADINGS.items())} FROM (SELECT p.*, r.* EXCLUDE (id) FROM parcels p JOIN rolled r USING (id)) ORDER BY pin",
    ("parcels", "pixels"),
)
def parcels_csv_rows(spark, d):
    return reports.parcels_file(reports.parcel_report(_with_centre(spark, d).drop("lot_row", "lot_col"), _assessed(spark, d).parcels))


_S_REPORT = {
    "id": ("concat('p', CAST(parcel_id AS VARCHAR), '-', substr(kind, 1, 3), CAST(ord AS VARCHAR))", ""), "parcel_pin": ("pin", ""), "parcel_address": ("address", ""), "kind": ("kind", ""), "description": ("description", ""),
    "year_built": ("CASE WHEN kind = 'dwelling' THEN dwel_yrblt ELSE ob_yrblt END", ""), "area_m2": ("round_even(s_m2, 1)", "real"), "damage_class": ("damage_class", ""), "score": ("round_even(score, 3)", "real"), "confidence": ("confidence", ""),
    "approximate": ("true", "flag"), "pixels": ("pixels", ""), "flooded_fraction": ("round_even(flooded_fraction, 3)", "real"), "source": ("'attribute'", ""),
}


@query(
    "buildings_csv_rows",
    f"WITH {_ROLLUP} SELECT {', '.join(f'{_text(*_S_REPORT[c])} AS {chr(34)}{h}{chr(34)}' for c, h in reports.STRUCTURE_HEADINGS.items())} FROM (SELECT s.* EXCLUDE (area_m2), s.area_m2 AS s_m2, pin, address, dwel_yrblt, ob_yrblt FROM scored s JOIN parcels p ON p.id = s.parcel_id)",
    ("parcels", "pixels"),
)
def buildings_csv_rows(spark, d):
    return reports.structures_file(reports.structure_report(V.parcels(spark, d), _assessed(spark, d).structures))


@query(
    "provider_union",
    """WITH f AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY datetime, id) AS r FROM scenes WHERE provider <> 'catalogue' AND CAST(datetime AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-25' AND west <= -79.16e0 AND east >= -79.2e0)
    SELECT CAST(id AS VARCHAR) AS id, provider, '' AS error FROM f WHERE r <= 30 UNION ALL SELECT '', 'catalogue', 'not reachable'""",
    ("scenes",),
)
def provider_union(spark, d):
    """Two providers answer, one fails."""

    def fails():
        raise OSError("not reachable")

    own = lambda name: lambda: V.scenes(spark, d).where(F.col("provider") == name)
    found, problems = scenes.search_all(spark, {"local": own("local"), "demo": own("demo"), "catalogue": fails}, "2024-01-03", "2024-01-25", -79.2, -79.16, 30)
    return found.select(F.col("id").cast("string").alias("id"), "provider", F.lit("").alias("error")).unionByName(problems.select(F.lit("").alias("id"), "provider", "error"))


@query("rgb_side_by_side", """WITH s AS (SELECT max("row") + 1 AS h, max(col) + 1 AS w FROM pixels) SELECT count(*) AS n, CAST(max(w * 2 + 4) AS BIGINT) AS width, count(*) FILTER (kind = 'gap') AS gap FROM
    (SELECT 'a' AS kind, w FROM pixels, s UNION ALL SELECT 'b', w FROM pixels, s UNION ALL SELECT 'gap', w FROM s, range(100000) AS r(k) WHERE k < h * 4)""", ("pixels",))
def rgb_side_by_side(spark, d):
    """Both dates as stretched colours next to each other."""
    px = stored(_pixels(spark, d))
    both = render.side_by_side([render.rgb(px, [f"{p}_{b}" for b in ("red", "green", "blue")]) for p in ("pre", "post")])
    edge = px.agg((F.max("col") + 1).alias("w")).first()["w"]
    return both.agg(F.count("*").alias("n"), (F.max("col") + 1).alias("width"), F.count_if((F.col("col") >= edge) & (F.col("col") < edge + 4)).alias("gap"))


@query("calibration_best", """WITH t AS (SELECT parcel_id, score, state IN ('major', 'destroyed') AS truth FROM (SELECT l_orderkey AS parcel_id, l_quantity / 60e0 AS score FROM lineitem) JOIN (SELECT o_orderkey AS parcel_id, CASE o_orderkey % 4 WHEN 0 THEN 'major' WHEN 1 THEN 'destroyed' WHEN 2 THEN 'minor' ELSE 'intact' END AS state FROM orders) USING (parcel_id)),
    k AS (SELECT CAST(k AS INTEGER) AS k, count(*) FILTER (truth AND score >= 0.05e0 + k * 0.005e0 - 1e-11) AS tp, count(*) FILTER (NOT truth AND score >= 0.05e0 + k * 0.005e0 - 1e-11) AS fp, count(*) FILTER (truth) AS a FROM t, range(161) AS r(k) GROUP BY k),
    f AS (SELECT k, coalesce(2e0 * tp / nullif(2 * tp + fp + a - tp, 0), 0e0) AS f1 FROM k) SELECT arg_max(k, (round_even(f1, 9), -k)) AS k, round_even(max(f1), 9) AS f1 FROM f""")
def calibration_best(spark, d):
    scored = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("parcel_id"), (F.col("l_quantity") / 60.0).alias("score"))
    state = F.element_at(F.array(*map(F.lit, ("major", "destroyed", "minor", "intact"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    truth = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("parcel_id"), state.alias("state"))
    return rounded(accuracy.calibration(scored, truth)[1], 9)


@query("result_features", f"WITH {_ROLLUP} SELECT r.id, worst_class AS damage_class, round_even(parcel_score, 3) AS parcel_score, structures AS buildings_total FROM rolled r", ("parcels", "pixels"))
def result_features(spark, d):
    """The features of the parcel result, read back from their JSON."""
    report = reports.parcel_report(_with_centre(spark, d), _assessed(spark, d).parcels)
    ring = geo.box_ring(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"))
    made = report.select(files.feature_json(["id", "pin", "damage_class", "parcel_score", "buildings_total", "note"], ring).alias("f"))
    back = F.from_json("f", "type string, properties struct<id:long,damage_class:string,parcel_score:double,buildings_total:long>")
    return made.select(back.alias("x")).select("x.properties.id", "x.properties.damage_class", "x.properties.parcel_score", "x.properties.buildings_total")
