"""Jobs of several processes, and assessments from scenes."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.operators import raster, scenes, structures
from lotwise.params import JobError
from lotwise.plans import assessment as A
from lotwise.plans.jobs import Job, Jobs
from lotwise.sources import testviews as V

DATA = "/root/testdata/sf0.001"


def waited(job):
    for _ in range(900):
        if job.status in ("done", "error"):
            return job
        time.sleep(0.2)
    raise AssertionError("the job does not end")


def test_two_registries_share_a_log(spark, tmp_path):
    one, two = Jobs(spark, str(tmp_path), lost_after=30), Jobs(spark, str(tmp_path), lost_after=30)
    assert one.recent() == [] and one.get("nothing") is None
    bad = waited(one.submit(lambda: 1 / 0))
    wrong = waited(two.submit(lambda: A.check_area(V.parcels(spark, DATA).limit(0))))
    seen = {j.id: j for j in one.recent()}
    assert set(seen) == {bad.id, wrong.id} and two.get(bad.id).error.startswith("ZeroDivisionError") and seen[wrong.id].error == "no parcels in the area"
    # a process that died while it worked, and one that is silent for a short time only
    one.log.append(Job("dead", "running", "", time.time() - 500))
    two.log.append(Job("alive", "running", "", time.time() - 400))
    two.log.lost_after = one.log.lost_after = 1e9
    assert two.get("dead").status == "running"
    one.log.lost_after = 0.0
    assert one.get("dead").status == "lost" and one.get(bad.id).status == "error"
    assert [j.id for j in two.recent(2)] == [wrong.id, bad.id]


def test_result_files_and_chips(spark, tmp_path):
    px = V.pixels(spark, DATA)
    size = px.agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w")).first()
    grid = raster.Raster(1000.0, 9000.0, 2.0, size["w"], size["h"])
    jobs = Jobs(spark, str(tmp_path))
    job = waited(jobs.submit(lambda: A.assess(V.parcels(spark, DATA).withColumns({"lon": (F.col("minx") + F.col("maxx")) / 2, "lat": F.col("miny"), "apr_total": F.col("apr_bldg") + F.col("apr_land")}), px, 2.0), grid))
    assert job.status == "done", job.error
    for name, key in (("parcels_geojson", "parcel_score"), ("buildings_geojson", "damage_class")):
        whole = json.loads("\n".join(r["value"] for r in spark.read.text(f"{job.path}/{name}", wholetext=True).collect()))
        assert whole["type"] == "FeatureCollection" and len(whole["features"]) > 100 and key in whole["features"][0]["properties"] and whole["features"][0]["geometry"]["type"] in ("Polygon", "Point")
    chip = Jobs(spark, str(tmp_path)).chip(job.id, (1000.0 + 40, 9000.0 - 58, 1000.0 + 58, 9000.0 - 40), size=17, pad=0.0)["score"]
    change = jobs.get(job.id) and {(r["row"], r["col"]): r["score"] for r in spark.read.parquet(f"{job.path}/layers/layer=score/level=0").select(F.posexplode("values").alias("p", "score"), "tile_row", "tile_col").where("tile_row = 0 and tile_col = 0").selectExpr("p div 256 as row", "p % 256 as col", "score").collect()}
    want = [[change[20 + int((i + 0.5) * 9 / 17), 20 + int((j + 0.5) * 9 / 17)] for j in range(17)] for i in range(17)]
    assert np.allclose(chip, np.array([[np.nan if v is None else v for v in r] for r in want], float), equal_nan=True)
    with pytest.raises(JobError):
        jobs.chip("nothing", (0, 0, 1, 1))


def scene(px, date, prefix, grid):
    bands = {b: px.select("row", "col", F.when(F.col(f"{prefix}_valid"), F.col(f"{prefix}_{b}") * 100).otherwise(-1.0).alias("value")) for b in ("blue", "green", "red", "nir")}
    return A.SceneBands(date, grid, bands, scale=100.0, nodata=-1.0)


def test_pixels_of_scenes_in_any_order(spark):
    px = V.pixels(spark, DATA)
    size = px.agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w")).first()
    grid = raster.Raster(0.0, 0.0, 2.0, size["w"], size["h"])
    before, after = scene(px, "2024-01-05", "pre", grid), scene(px, "2024-02-01", "post", grid)
    got = A.scene_pixels(after, before, grid)
    same = got.join(px.select("row", "col", *[F.col(f"{p}_{c}").alias(f"w_{p}_{c}") for p in ("pre", "post") for c in ("nir", "valid")]), ["row", "col"], "full")
    wrong = same.where(~(F.col("pre_valid").eqNullSafe(F.col("w_pre_valid")) & F.col("post_valid").eqNullSafe(F.col("w_post_valid"))) | F.col("pre_valid") & (F.abs(F.col("pre_nir") - F.col("w_pre_nir")) > 1e-9) & F.col("post_valid"))
    assert got.count() == size["h"] * size["w"] and wrong.count() == 0
    with pytest.raises(JobError, match="hardly cover"):
        A.scene_pixels(before, after, raster.Raster(1e6, 0.0, 2.0, 50, 50))


def test_an_assessment_from_two_scenes(spark):
    """Lots in degrees meet scenes in metres: a bright patch on one lot is its damage."""
    lots = V.parcels(spark, DATA).where("id <= 4")
    box = tuple(lots.agg(F.min("minx"), F.min("miny"), F.max("maxx"), F.max("maxy")).first())
    at = spark.range(1).select(*[c.alias(k) for k, c in A.geo.grid(*map(F.lit, box), F.lit(1.0)).items()]).first()
    source = raster.Raster(float(at["left"]) - 20, float(at["top"]) + 20, 2.0, 160, 60)
    cells = spark.range(source.height).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(source.width - 1).cast("long"))).alias("col"))
    noise = F.pmod(F.xxhash64("row", "col"), F.lit(1000)) / 100000
    shapes = A.lot_shapes(lots, source, 17).where("zone = 2")
    hit = A.zonal.label_rings(shapes)
    base = {b: cells.select("row", "col", (F.lit(v) + noise).alias("value")) for b, v in (("blue", 0.06), ("green", 0.09), ("red", 0.07), ("nir", 0.12))}
    later = {b: df.join(hit, ["row", "col"], "left").select("row", "col", F.when(F.col("zone").isNotNull(), 0.35 + 0.1 * (F.col("row") % 2)).otherwise(F.col("value")).alias("value")) for b, df in base.items()}
    first, second = A.SceneBands("2024-01-01", source, base), A.SceneBands("2024-03-01", source, later)
    found, grid = A.assess_scenes(lots, second, first, 17, box)
    assert grid.gsd == 2.0
    score = {r["id"]: (r["parcel_score"], r["worst_class"]) for r in found.parcels.collect()}
    assert score[2][1] in ("severe", "destroyed") and all(score[i][0] < 0.2 for i in (1, 3, 4) if score[i][0] is not None)


def test_sources_fall_through(spark):
    table = spark.range(3)
    broken = lambda: spark.read.parquet("/nowhere/at/all")
    kind, some, failed = structures.chosen(broken, table, table, file=broken)
    assert kind == "tax-roll" and some.count() == 3 and [k for k, _ in failed] == ["file", "mapped"]
    assert structures.chosen(lambda: table, table, table)[0] == "mapped" and structures.chosen(None, table, table, file=table)[0] == "file"
    with pytest.raises(JobError):
        structures.chosen(None, broken, table)


def test_scenes_are_registered_once(spark):
    shape = "id string, datetime string, note string"
    held = spark.createDataFrame([("a", "2024-01-01", "old"), ("b", "2024-01-02", "old")], shape)
    new = spark.createDataFrame([("a", "2024-01-05", "new"), ("a", "2024-01-09", "newer"), ("c", "2024-01-03", "new")], shape)
    got = {r["id"]: r["note"] for r in scenes.upsert(held, new).collect()}
    assert got == {"a": "newer", "b": "old", "c": "new"} and scenes.upsert(held, new).count() == 3
    assert [r["id"] for r in scenes.remove(held, "a").collect()] == ["b"]
    with pytest.raises(JobError):
        scenes.remove(held, "z")
