"""Registered queries over rasters and the stored parcel table."""

from __future__ import annotations

import uuid
from math import ceil

from pyspark.sql import functions as F

from lotwise.operators import raster
from lotwise.plans.queries import query
from lotwise.sources import catalogue
from lotwise.sources import testviews as V
from lotwise.sources.tables import shared_folder
from lotwise.sources.tile_store import TileStore

# -- reading onto a grid -----------------------------------------------------------------------------------------------


def _grid_sql(gsd: float, left: float, top: float, coarse: bool) -> str:
    """Bilinear reading of a raster of 2 m and 500 columns, by four joins' worth of neighbours; with ``coarse`` over means of twice the target's sampling."""
    w = ceil(1000 / gsd)
    height = f"CAST(ceil(h * 2e0 / {gsd}e0) AS BIGINT)"
    source = 'SELECT "row" AS y, col AS x, val AS v, ok FROM px'
    if coarse:
        source = """SELECT y, x, sum(val * wy * wx) / sum(wy * wx) AS v, true AS ok FROM (SELECT val, y, x, least((y + 1) * sy, "row" + 1) - greatest(y * sy, "row") AS wy, least((x + 1) * sx, col + 1) - greatest(x * sx, col) AS wx
            FROM px, s, unnest(range(CAST(floor("row" / sy) AS BIGINT), CAST(ceil(("row" + 1) / sy) AS BIGINT))) AS a(y), unnest(range(CAST(floor(col / sx) AS BIGINT), CAST(ceil((col + 1) / sx) AS BIGINT))) AS b(x) WHERE ok AND y < oh AND x < ow)
            WHERE wy > 1e-12 AND wx > 1e-12 GROUP BY y, x"""
    oh, ow = (f"2 * {height}", str(2 * w)) if coarse else ("h", "500")
    return f"""WITH px AS (SELECT "row", col, pre_red + 0.01e0 AS val, pre_valid AS ok FROM pixels), g AS (SELECT max("row") + 1 AS h FROM px),
    s AS (SELECT h, {height} AS th, {oh} AS oh, {ow} AS ow, h / CAST({oh} AS DOUBLE) AS sy, 500e0 / {ow} AS sx FROM g), src AS ({source}),
    t AS (SELECT i AS "row", j AS col, ((i + 0.5e0) * {gsd}e0 - {top}e0) / 2e0 / sy - 0.5e0 AS v, ((j + 0.5e0) * {gsd}e0 + {left}e0) / 2e0 / sx - 0.5e0 AS u, oh, ow FROM s, unnest(range(th)) AS a(i), range({w}) AS b(j)),
    n AS (SELECT "row", col, floor(v) + dy AS y, floor(u) + dx AS x, (1 - abs(v - floor(v) - dy)) * (1 - abs(u - floor(u) - dx)) AS w, floor(v + 0.5e0) AS ny, floor(u + 0.5e0) AS nx, oh, ow FROM t, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS o(dy, dx)),
    b AS (SELECT n."row", n.col, sum(w * CASE WHEN ok THEN src.v ELSE 0e0 END) / nullif(sum(w) FILTER (n.y >= 0 AND n.y < oh AND n.x >= 0 AND n.x < ow), 0) AS value,
            coalesce(bool_or(ok AND n.y = ny AND n.x = nx), false) AS valid FROM n LEFT JOIN src ON src.y = n.y AND src.x = n.x GROUP BY n."row", n.col)
    SELECT "row", col, CASE WHEN valid THEN round_even(value, 6) ELSE 0e0 END AS value, valid FROM b"""


def _on_grid(spark, d, gsd: float, left: float, top: float):
    px = V.pixels(spark, d)
    height = px.agg(F.max("row")).first()[0] + 1
    band = raster.scaled(px.select("row", "col", F.when(F.col("pre_valid"), F.col("pre_red")).otherwise(-9.0).alias("value")), offset=0.01, nodata=-9.0)
    out = raster.read_to_grid(band, raster.Raster(0.0, 0.0, 2.0, 500, height), raster.Raster(left, top, gsd, ceil(1000 / gsd), ceil(height * 2 / gsd)), block=128)
    return out.select("row", "col", F.bround("value", 6).alias("value"), "valid")


@query("read_to_grid_finer", _grid_sql(1.3, 0.0, 0.0, False), ("pixels",))
def read_to_grid_finer(spark, d):
    return _on_grid(spark, d, 1.3, 0.0, 0.0)


@query("read_to_grid_coarser", _grid_sql(9.0, 0.0, 0.0, True), ("pixels",))
def read_to_grid_coarser(spark, d):
    return _on_grid(spark, d, 9.0, 0.0, 0.0)


@query("read_to_grid_shifted", _grid_sql(2.0, 0.9, -3.1, False), ("pixels",))
def read_to_grid_shifted(spark, d):
    return _on_grid(spark, d, 2.0, 0.9, -3.1)


# -- pyramids ----------------------------------------------------------------------------------------------------------

#: Windows (row0, col0, row1, col1) that are asked for, and how many pixels along the longer side.
WINDOWS = ((0, 0, 300, 500, 100), (37, 101, 93, 190, 64), (250, 440, 900, 900, 20))


@query(
    "raster_window",
    f"""WITH px AS (SELECT "row", col, pre_red AS v FROM pixels WHERE pre_valid), g AS (SELECT max("row") + 1 AS h FROM px),
    q AS (SELECT w, r0, c0, least(r1, h) AS r1, least(c1, 500) AS c1, size, h FROM g, (VALUES {", ".join(f"({i}, {a}, {b}, {c}, {e}, {n})" for i, (a, b, c, e, n) in enumerate(WINDOWS))}) AS v(w, r0, c0, r1, c1, size)),
    l AS (SELECT w, r0, c0, r1, c1, max(k) AS k FROM q, range(5) AS t(k) WHERE k = 0 OR greatest(r1 - r0, c1 - c0) >= size * (1 << k) AND least(h, 500) // (1 << k) >= 32 GROUP BY ALL)
    SELECT w, CAST(k AS INT) AS level, "row" >> k AS "row", col >> k AS col, round_even(avg(v), 6) AS value FROM l JOIN px ON ("row" >> k) BETWEEN (r0 >> k) AND ((r1 - 1) >> k) AND (col >> k) BETWEEN (c0 >> k) AND ((c1 - 1) >> k) GROUP BY w, k, "row" >> k, col >> k""",
    ("pixels",),
)
def raster_window(spark, d):
    """Three windows, read from a pyramid on the level that suits each."""
    px = V.pixels(spark, d).select("row", "col", "pre_red", F.col("pre_valid").alias("valid"))
    grid = raster.Raster(0.0, 0.0, 2.0, 500, px.agg(F.max("row")).first()[0] + 1)
    path = f"{shared_folder(spark)}/pyramid-{uuid.uuid4().hex}"
    raster.write_pyramid(px, ["pre_red"], grid, path, tile=64)
    parts = [raster.raster_window(spark, path, "pre_red", grid, (a, b, c, e), n).select(F.lit(i).alias("w"), "level", "row", "col", F.bround("value", 6).alias("value")) for i, (a, b, c, e, n) in enumerate(WINDOWS)]
    return parts[0].union(parts[1]).union(parts[2])


# -- the stored parcel table -------------------------------------------------------------------------------------------


@query(
    "stored_upserts",
    """WITH base AS (SELECT id, owner, minx, miny, maxx, maxy FROM parcels),
    one AS (SELECT id, 'moved' AS owner, minx + 0.03e0 AS minx, miny, maxx + 0.03e0 AS maxx, maxy FROM base WHERE id % 7 = 0 UNION ALL SELECT id + 1000000, owner, minx, miny + 0.02e0, maxx, maxy + 0.02e0 FROM base WHERE id % 11 = 0),
    two AS (SELECT id, concat('again ', CAST(id % 5 AS VARCHAR)) AS owner, minx - 0.01e0 AS minx, miny, maxx - 0.01e0 AS maxx, maxy FROM base WHERE id % 14 = 0),
    every AS (SELECT 0 AS k, * FROM (SELECT id, owner, minx, miny, maxx, maxy FROM base) UNION ALL SELECT 1, id, owner, minx, miny, maxx, maxy FROM one UNION ALL SELECT 2, id, owner, minx, miny, maxx, maxy FROM two)
    SELECT id, owner, round_even(minx, 6) AS minx, CAST(floor(minx / 0.01e0) AS BIGINT) AS tile_x, CAST(floor(miny / 0.01e0) AS BIGINT) AS tile_y FROM every QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1""",
    ("parcels",),
)
def stored_upserts(spark, d):
    """A stored table after two inserts that replace, move and add parcels."""
    base = V.parcels(spark, d).select("id", "owner", "minx", "miny", "maxx", "maxy")
    store = TileStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    east = lambda by: {"minx": F.col("minx") + by, "maxx": F.col("maxx") + by}
    store.insert(base)
    moved = base.where("id % 7 = 0").withColumns(east(0.03) | {"owner": F.lit("moved")})
    added = base.where("id % 11 = 0").withColumns({"id": F.col("id") + 1_000_000, "miny": F.col("miny") + 0.02, "maxy": F.col("maxy") + 0.02})
    store.insert(moved.unionByName(added))
    again = base.where("id % 14 = 0").withColumns(east(-0.01) | {"owner": F.concat(F.lit("again "), (F.col("id") % 5).cast("string"))})
    store.insert(again.withColumn("ord", F.lit(2)).unionByName(again.withColumns({"owner": F.lit("overtaken"), "ord": F.lit(1)})), order="ord")
    at = F.split("tile", "_")
    return store.read().select("id", "owner", F.bround("minx", 6).alias("minx"), at[0].cast("bigint").alias("tile_x"), at[1].cast("bigint").alias("tile_y"))


# -- catalogue items ---------------------------------------------------------------------------------------------------


@query(
    "catalogue_items",
    """WITH i AS (SELECT CAST(event_id AS VARCHAR) AS id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS datetime, event_id % 3 AS c, event_id % 5 AS a, CASE WHEN event_id % 19 = 0 THEN NULL ELSE least(abs(value), 100e0) END AS cloud,
      -79.3e0 + 0.001e0 * (user_id % 200) AS west FROM events)
    SELECT id, datetime, cloud, round_even(west, 6) AS west, CASE WHEN a = 1 THEN 'blue,nir' ELSE 'blue,green,nir,red' END AS bands FROM i
    WHERE c = 0 AND a <> 0 AND datetime >= '2024-01-05' AND datetime < '2024-01-21' AND west <= -79.16e0 AND west + 0.05e0 >= -79.24e0 AND cloud <= 40 ORDER BY datetime, id LIMIT 400""",
)
def catalogue_items(spark, d):
    """Items in files, searched by the data source: box, days, cloud and collection."""
    c = F.col
    href = lambda b: F.struct(F.concat(F.lit(f"s3://{b}/"), c("event_id").cast("string")).alias("href")).alias(b)
    west = -79.3 + 0.001 * (c("user_id") % 200)
    assets = F.when(c("event_id") % 5 == 0, F.to_json(F.struct(href("thumbnail")))).when(c("event_id") % 5 == 1, F.to_json(F.struct(href("blue"), href("nir08")))).otherwise(F.to_json(F.struct(*[href(b) for b in ("blue", "green", "red", "nir08")])))
    facts = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"), F.when(c("event_id") % 19 != 0, F.least(F.abs("value"), F.lit(100.0))).alias("eo:cloud_cover")))
    kind = F.when(c("event_id") % 3 == 0, "landsat-c2-l2").otherwise("sentinel-2-l2a")
    line = F.concat(F.lit('{"id":"'), c("event_id").cast("string"), F.lit('","collection":"'), kind, F.lit('","bbox":['), F.concat_ws(",", west.cast("string"), F.lit("35.4"), (west + 0.05).cast("string"), F.lit("35.5")), F.lit('],"properties":'), facts, F.lit(',"assets":'), assets, F.lit("}"))
    path = f"{shared_folder(spark)}/items-{uuid.uuid4().hex}"
    V.table(spark, d, "events").select(line.alias("value")).write.text(path)
    found = catalogue.items(spark, path, (-79.24, 35.45, -79.16, 35.48), "2024-01-05", "2024-01-20", collection="landsat-c2-l2", max_cloud=40.0, limit=400)
    return found.select("id", "datetime", "cloud", F.bround("west", 6).alias("west"), F.array_join(F.array_sort(F.map_keys("assets")), ",").alias("bands"))
