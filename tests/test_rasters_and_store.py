"""Rasters, pyramids and the stored parcel table."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.operators import raster
from lotwise.sources import testviews as V
from lotwise.sources.tables import scope, stored
from lotwise.sources.tile_store import TileStore


def band(spark, array, valid=None):
    rows = [(r, c, float(array[r, c]), bool(valid[r, c]) if valid is not None else True) for r in range(array.shape[0]) for c in range(array.shape[1])]
    return spark.createDataFrame(rows, "row long, col long, value double, valid boolean")


def grid(df, height, width):
    values, valid = np.full((height, width), np.nan), np.zeros((height, width), bool)
    rows = df.collect()
    assert len(rows) == height * width
    for r in rows:
        values[r["row"], r["col"]], valid[r["row"], r["col"]] = r["value"], r["valid"]
    return values, valid


def test_a_plane_stays_a_plane(spark):
    """Bilinear reading of a slope gives the slope at every target centre away from the border, across block borders too."""
    r, c = np.mgrid[0:40, 0:50]
    source, target = raster.Raster(100.0, 900.0, 2.0, 50, 40), raster.Raster(103.1, 895.7, 0.7, 110, 90)
    values, valid = grid(raster.read_to_grid(band(spark, 3 * r + c), source, target, block=32), 90, 110)
    tr, tc = np.mgrid[0:90, 0:110]
    want = 3 * ((900 - 895.7 + (tr + 0.5) * 0.7) / 2 - 0.5) + (3.1 + (tc + 0.5) * 0.7) / 2 - 0.5
    assert valid.all() and np.abs(values - want).max() < 1e-9


def test_no_overlap_and_holes(spark):
    array, good = np.ones((30, 30)), np.ones((30, 30), bool)
    good[10:20, 10:20] = False
    source = raster.Raster(0.0, 0.0, 1.0, 30, 30)
    values, valid = grid(raster.read_to_grid(band(spark, array, good), source, raster.Raster(500.0, 0.0, 1.0, 8, 6)), 6, 8)
    assert not valid.any() and (values == 0).all()
    values, valid = grid(raster.read_to_grid(band(spark, array, good), source, raster.Raster(-2.0, 1.0, 1.0, 40, 40), block=16), 40, 40)
    want = np.zeros((40, 40), bool)
    want[1:31, 2:32] = good
    assert (valid == want).all() and (values[~want] == 0).all() and (values[want] == 1).all()


def test_checkerboard_is_averaged(spark):
    array = np.indices((120, 120)).sum(0) % 2 * 200.0 + 30
    source, target = raster.Raster(0.0, 0.0, 1.0, 120, 120), raster.Raster(0.0, 0.0, 12.0, 10, 10)
    values, valid = grid(raster.read_to_grid(band(spark, array), source, target), 10, 10)
    assert valid.all() and np.abs(values - 130).max() < 1e-9


def test_scaling(spark):
    raw = spark.createDataFrame([(0, 0, 100.0), (0, 1, 0.0), (0, 2, None), (0, 3, float("nan"))], "row long, col long, value double")
    got = {r["col"]: (r["value"], r["valid"]) for r in raster.scaled(raw, 200.0, 20.0, 0.0).collect()}
    assert got == {0: (0.6, True), 1: (None, False), 2: (None, False), 3: (None, False)}


@pytest.fixture(scope="module")
def pyramid(spark, tmp_path_factory):
    rng = np.random.default_rng(2)
    array, good = rng.random((150, 200)), rng.random((150, 200)) > 0.1
    good[64:128, 64:128] = False
    path = str(tmp_path_factory.mktemp("p") / "pyramid")
    own = raster.Raster(0.0, 0.0, 1.0, 200, 150)
    raster.write_pyramid(band(spark, array, good), ["value"], own, path, tile=64)
    return path, own, array, good


def test_windows_read_their_tiles_only(spark, pyramid):
    path, own, array, good = pyramid
    assert raster.levels(200, 150) == [0, 1, 2] and sorted(os.path.basename(p) for p in glob.glob(f"{path}/layer=value/*")) == ["level=0", "level=1", "level=2"]
    got = raster.raster_window(spark, path, "value", own, (10, 20, 60, 130), 50)
    assert "PartitionFilters: [isnotnull(layer" in got._jdf.queryExecution().toString() and "GreaterThanOrEqual(tile_row,0)" in got._jdf.queryExecution().toString()
    for r in got.collect():
        cell = (slice(2 * r["row"], 2 * r["row"] + 2), slice(2 * r["col"], 2 * r["col"] + 2))
        assert r["level"] == 1 and abs(r["value"] - array[cell][good[cell]].mean()) < 1e-12
    assert raster.raster_window(spark, path, "value", own, (70, 70, 120, 120), 500).count() == 0
    assert raster.raster_window(spark, path, "nothing", own, (0, 0, 9, 9), 5).count() == 0


def test_chips(spark, pyramid):
    path, own, array, good = pyramid
    chip = raster.chip(spark, path, ["value"], own, (-5, 10, 50, 50), 100)["value"]
    assert chip.shape == (100, 80)
    want = np.where(good, array, np.nan)[np.ix_(((np.arange(100) + 0.5) * 50 / 100).astype(int), (10 + (np.arange(80) + 0.5) * 40 / 80).astype(int))]
    assert np.array_equal(chip, want, equal_nan=True)
    assert raster.chip(spark, path, ["value"], own, (0, 0, 150, 200), 40)["value"].shape == (30, 40)
    assert raster.chip(spark, path, ["value"], own, (500, 0, 600, 9), 40) == {}


# -- stored parcels ----------------------------------------------------------------------------------------------------


def lots(spark, rows):
    return spark.createDataFrame([(i, o, x, y, x + w, y + 0.001) for i, o, x, y, w in rows], "id long, owner string, minx double, miny double, maxx double, maxy double")


def files(path, part):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/{part}/*/*.parquet")}


def test_inserts_touch_their_tiles_only(spark, tmp_path):
    path = str(tmp_path / "store")
    store = TileStore(spark, path)
    assert not store.exists()
    store.insert(lots(spark, [(k, "first", 0.0005 + 0.01 * (k % 20), 0.0005, 0.001) for k in range(200)] + [(900, "wide", 0.001, 0.0, 0.5)]))
    store.set_meta("source", F.lit("one"))
    assert store.exists() and store.read().count() == 201
    before = files(path, "parcels")
    store.insert(lots(spark, [(3, "moved", 0.0505, 0.0005, 0.001), (3, "moved", 0.0505, 0.0005, 0.001), (500, "new", 0.9005, 0.0005, 0.001)]))
    after = files(path, "parcels")
    changed = {os.path.basename(os.path.dirname(p)) for p in before.keys() ^ after.keys()}
    assert changed == {"tile=3_0", "tile=5_0", "tile=90_0"} and all(after[p] == before[p] for p in before.keys() & after.keys())
    rows = store.read().where("id in (3, 500)").orderBy("id").collect()
    assert [(r["id"], r["owner"], r["tile"]) for r in rows] == [(3, "moved", "5_0"), (500, "new", "90_0")] and store.read().count() == 202
    store.insert(lots(spark, [(500, "gone elsewhere", 0.0005, 0.0005, 0.001), (900, "narrow now", 0.001, 0.0, 0.001)]))
    tiles = {os.path.basename(p) for p in glob.glob(f"{path}/parcels/tile=*")}
    assert "tile=90_0" not in tiles and "tile=wide" not in tiles and store.read().count() == 202
    assert [r["owner"] for r in store.get(500).collect()] == ["gone elsewhere"] and store.get(12345).count() == 0
    assert {r["id"] for r in store.in_box((0.0, 0.0, 0.002, 0.002)).collect()} >= {500, 900, 0, 20}
    index = spark.read.parquet(f"{path}/index")
    assert index.count() == 202 and index.join(store.read(), ["id", "tile"]).count() == 202
    store.reset()
    assert not store.exists() and store.get_meta("source") == '"one"'
    store.insert(lots(spark, [(1, "again", 0.0, 0.0, 0.001)]))
    assert store.read().count() == 1


def test_the_last_of_several_rows_counts(spark, tmp_path):
    store = TileStore(spark, str(tmp_path / "store"))
    rows = lots(spark, [(1, f"owner {k}", 0.01 * k, 0.0, 0.001) for k in range(9)]).withColumn("ord", F.expr("cast(substring(owner, 7) as int)"))
    store.insert(rows.where("ord < 5"), order="ord")
    store.insert(rows, order="ord")
    assert [(r["owner"], r["tile"]) for r in store.read().collect()] == [("owner 8", "8_0")]


def test_scopes_delete_their_tables(spark):
    with scope():
        kept = stored(spark.range(5))
        at = kept.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(at)
    assert not os.path.exists(at)


def test_pixels_of_far_lots(spark, tmp_path):
    """The noise of lots whose place times its factor passes 64 bits, and of the first ones."""
    keys = [0, 1, 49, 50, 14_999, 2_200_000, 5_399_999, 40_000_000_000]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = {(r["row"], r["col"]): r for r in V.pixels(spark, str(tmp_path)).collect()}
    assert len(got) == 100 * len(keys)
    for key in keys:
        for k in range(0, 100, 9):
            row, col = key // 50 * 10 + k // 10, key % 50 * 10 + k % 10
            lot, roof = k % 10 < 9 and k < 90, 2 <= k % 10 <= 6 and 20 <= k <= 69
            noise = lambda band: 0.02 * ((row * 7919 + col * 104729 + band * 1299709) * 2654435761 % 4294967296 / 4294967296.0 - 0.5)  # noqa: B023, E731
            ground = 0.24 if roof else 0.07 if lot else 0.14
            later = 0.33 if key % 7 == 0 and roof else 0.05 if key % 50 < 3 and lot else ground
            assert got[row, col]["pre_red"] == ground + noise(2) and got[row, col]["post_red"] == (later + noise(6)) * 1.05 + 0.01


@pytest.mark.parametrize("name", ["summary", "read_to_grid_coarser", "change_layers", "footprint_rollup", "change_summary"])
def test_queries_with_far_lots(spark, name, tmp_path):
    """Lots of which half lie beyond row 438,000, where a place times the noise's factor passes 64 bits."""
    import __spark_entry__

    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
    lots = read("customer")
    lots.unionByName(lots.withColumn("c_custkey", F.col("c_custkey") + 2_500_000)).write.parquet(f"{tmp_path}/customer.parquet")
    for t in ("nation", "part"):
        read(t).write.parquet(f"{tmp_path}/{t}.parquet")
    n = 2 * lots.count()
    with scope():
        out = __spark_entry__.queries()[name](spark, str(tmp_path))
        if name == "summary":
            assert out.first()["parcels"] == n
        elif name == "change_layers":
            assert out.where("structure_loss is not null").count() == 100 * n
        elif name == "read_to_grid_coarser":
            assert out.where("valid and row > 100000").count() > 0
        else:
            assert out.count() > 0
