import json

import pytest
from pyspark.sql import functions as F

from lotwise.functions import geo, shapes
from lotwise.functions import measures as M
from lotwise.operators import parcels, render, rollup, scenes, structures
from lotwise.params import CLASSES, LOSS_FACTOR, JobError, Limits
from lotwise.plans import reports
from lotwise.sources import files

SHAPE = "id long, pin string, parid string, address string, owner string, minx double, miny double, maxx double, maxy double, area_m2 double, apr_bldg double, dwel_sfla double, dwel_desc string, ob_area double, ob_desc string, subdivision string"


@pytest.fixture(scope="module")
def block(spark):
    rows = []
    for i in range(8):
        x, y = -79.18 + 0.0006 * (i % 4), 35.478 + 0.0006 * (i // 4)
        sheds = {0: "WOODEN SHED", 1: "WOODEN SHED", 2: "WOODEN SHED", 3: "ASPHALT YARD"}
        rows.append((i + 1, f"LOT-{i:04d}", f"P{i}", f"{100 + i} MILL ROAD", f"OWNER {i}", x, y, x + 0.00054, y + 0.00054, 2900.0, 150000.0 if i < 6 else 0.0, 1600.0 if i < 6 else None, "RANCH" if i < 6 else None, 300.0 if i < 4 else None, sheds.get(i), "ELMS"))
    return spark.createDataFrame(rows, SHAPE)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_lookups(block):
    assert ids(parcels.by_pin(block, "P3")) == [4] and ids(parcels.by_id(block, 99)) == []
    assert ids(parcels.many(block, [5, 2, 99, 5, 1])) == [2, 5, 1]
    assert ids(parcels.search(block, "owner 7")) == [8] and len(ids(parcels.search(block, "mill road", 3))) == 3
    assert parcels.extent(block).first()["n"] == 8


def test_boxes(block, spark, tmp_path):
    box = (-79.1801, 35.4779, -79.1795, 35.4785)
    assert ids(parcels.in_box(block, box)) == [1] and ids(parcels.in_box(block, box, 1)) == [1]
    edge = (-79.18 + 0.00054, 35.4, -79.18 + 0.0006, 35.5)  # bounds touch, no area is shared
    assert set(ids(parcels.candidates(block, edge))) >= {1, 2} and ids(parcels.in_box(block, edge)) == []
    parcels.write(block, str(tmp_path / "p"))
    stored = parcels.read_box(spark, str(tmp_path / "p"), box)
    assert ids(stored) == [1]


def test_upsert_keeps_the_last(block, spark):
    new = spark.createDataFrame([(1, "A", 1), (1, "B", 2), (50, "C", 1)], "id long, owner string, ord int")
    got = {r["id"]: r["owner"] for r in parcels.upsert(block.select("id", "owner"), new).collect()}
    assert got[1] == "B" and got[50] == "C" and len(got) == 9


def test_tax_roll(block):
    got = structures.from_tax_roll(block).collect()
    kinds = [r["kind"] for r in got]
    assert kinds.count("dwelling") == 6 and kinds.count("outbuilding") == 3
    assert all(abs(r["width"] * r["height"] - r["area_m2"]) < 1e-9 for r in got)
    assert got == structures.from_tax_roll(block).collect()


def test_attribute_rules(spark):
    rows = [("GARDEN SHED", True), ("paving", False), ("OLD DWELLING", False), ("", False), (None, False)]
    df = spark.createDataFrame(rows, "d string, want boolean")
    assert df.where(M.is_structure(F.col("d")) != F.col("want")).count() == 0
    roof = df.limit(1).select(M.roof_m2(F.lit(1900.0), F.lit("colonial ")).alias("a"), M.roof_m2(F.lit(1900.0), F.lit(None)).alias("b"), M.roof_m2(F.lit(10.0), F.lit("RANCH")).alias("c")).first()
    assert abs(roof["a"] - 92.90304) < 1e-9 and abs(roof["b"] - 1900 * 0.09290304 / 1.2) < 1e-9 and roof["c"] == 20
    sizes = df.limit(1).select(*[M.focus_size(F.lit(a), F.lit(g)).alias(f"s{i}") for i, (a, g) in enumerate([(10.0, 1.0), (150.0, 1.0), (150.0, 10.0), (9999.0, 1.0)])]).first()
    assert tuple(sizes) == (5, 13, 3, 25)


def test_classes_cover_every_break(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (0.1,), (0.2,), (0.4,), (0.6,), (0.9,)], "s double")
    assert [r[0] for r in df.select(M.damage_class(F.col("s"))).collect()] == ["none", "none", *CLASSES]
    assert list(LOSS_FACTOR.values()) == sorted(LOSS_FACTOR.values())


def test_overlap_join_takes_the_larger_share(block, spark):
    x = -79.18 + 0.00054
    boxes = spark.createDataFrame([("a", x - 0.0002, 35.4781, x + 0.0001, 35.4782), ("b", 0.0, 0.0, 1.0, 1.0)], "fid string, x0 double, y0 double, x1 double, y1 double")
    got = {r["fid"]: r["parcel_id"] for r in structures.overlapping(boxes, block).collect()}
    assert got == {"a": 1, "b": None}
    assert structures.choose_source(2, 8, False) == "mapped" and structures.choose_source(1, 8, False) == "tax-roll"


def test_rollup_of_uniform_damage(block, spark):
    scored = structures.from_tax_roll(block).withColumns({"score": F.lit(0.9), "damage_class": F.lit("destroyed")})
    stats = spark.createDataFrame([(i + 1, 10, 0.4 if i == 0 else 1.0, 0.9, 0.0, 0.0, 1.0) for i in range(8)], "zone long, pixels long, coverage double, score double, flooded double, veg_loss double, changed double")
    rolled = rollup.parcel_rollup(block, scored, stats)
    assert all(r["worst_class"] == "destroyed" for r in rolled.collect())
    total = rollup.totals(rolled).first()
    assert total["n_destroyed"] == 9 and total["damaged"] == 9 and abs(total["estimated_loss"] - 6 * 150000) < 1e-6 and total["affected"] == 8
    assert [r["ord"] for r in rollup.warnings(rolled).collect()] == [1, 2]


def test_projection(spark):
    df = spark.createDataFrame([(-79.15, 35.47, 17), (3.0, 0.0, 31), (10.2, 59.9, 32)], "lon double, lat double, z int")
    x, y = geo.utm_xy(F.col("lon"), F.col("lat"), F.col("z"))
    out = df.withColumns({"x": x, "y": y})
    lon, lat = geo.utm_lonlat(F.col("x"), F.col("y"), F.col("z"))
    for r in out.select("*", lon.alias("lon2"), lat.alias("lat2"), geo.utm_zone(F.col("lon")).alias("zone")).collect():
        assert abs(r["lon"] - r["lon2"]) < 1e-9 and abs(r["lat"] - r["lat2"]) < 1e-9 and r["zone"] == r["z"]
    on_axis = out.where("lat = 0").first()
    assert abs(on_axis["x"] - 500000) < 1e-6 and abs(on_axis["y"]) < 1e-6
    assert geo.parse_bbox("2,3,1,0") == (1, 0, 2, 3)
    with pytest.raises(ValueError):
        geo.parse_bbox("1,2,3")


def test_rings_are_clipped_and_measured(spark):
    shape = lambda pts: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pts])
    one = spark.range(1)
    diamond = shape([(0, -2), (2, 0), (0, 2), (-2, 0)])
    cut = geo.clipped(diamond, F.lit(-1.0), F.lit(-3.0), F.lit(1.0), F.lit(3.0))
    away = geo.clipped(diamond, F.lit(5.0), F.lit(5.0), F.lit(6.0), F.lit(6.0))
    got = one.select(geo.ring_area(cut).alias("a"), F.size(cut).alias("n"), geo.ring_area(away).alias("b")).first()
    assert abs(got["a"] - 6) < 1e-12 and got["n"] == 6 and got["b"] == 0
    lot = shape([(-79.18, 35.478), (-79.17, 35.478), (-79.17, 35.488), (-79.18, 35.488)])
    size = one.select(geo.ring_m2(lot).alias("m2"), geo.bbox_km2(*map(F.lit, (-79.18, 35.478, -79.17, 35.488))).alias("km2")).first()
    assert abs(size["m2"] / size["km2"] / 1e6 - 1) < 0.005
    hook = shape([(0, 0), (10, 0), (10, 10), (8, 10), (8, 2), (0, 2)])  # its centre lies outside
    at = one.select(shapes.interior_point(F.array(hook)).alias("p")).first()["p"]
    assert (at["x"], at["y"]) == (9, 6)
    grid = geo.grid(*map(F.lit, (-79.18, 35.478, -79.17, 35.488, 2.0)))
    g = one.select(*[c.alias(n) for n, c in grid.items()]).first()
    assert g["epsg"] == 32617 and (g["right"] - g["left"]) / 2 == g["width"] and g["left"] % 2 == 0
    back = geo.grid_degrees(*[F.lit(g[c]) for c in ("left", "bottom", "right", "top")], F.lit(17))
    w, s, e, n = one.select(*[c.alias(f"c{i}") for i, c in enumerate(back)]).first()
    assert w <= -79.18 and s <= 35.478 and e >= -79.17 and n >= 35.488 and e - w < 0.0106


def test_areas_of_jobs(block):
    box, found = reports.area_of(block, ids=[2, 5])
    assert ids(found) == [2, 5] and box[0] < -79.18 and box[2] > -79.18 + 0.0006 + 0.00054
    assert len(ids(reports.area_of(block, box=(-79.1801, 35.4779, -79.1789, 35.4785))[1])) == 2
    for given in ({"ids": [99]}, {"box": (0.0, 0.0, 1.0, 1.0)}, {}, {"box": (-82.0, 33.0, -77.0, 37.0)}):
        with pytest.raises(JobError):
            reports.area_of(block, **given)
    with pytest.raises(JobError):
        reports.area_of(block, ids=list(range(1, 9)), limits=Limits(parcels=3))


def test_intake_keeps_gaps_and_meta(spark, tmp_path):
    ring = lambda x, w: [(x, 0.0), (x + w, 0.0), (x + w, 0.001), (x, 0.001)]
    raw = spark.createDataFrame([(0, ring(1.0, 0.001), " a ", "1990.0"), (1, ring(2.0, 0.0), "b", "1"), (2, None, "c", "1"), (3, ring(3.0, 0.05), "d", "0")], "seq long, ring array<struct<x:double,y:double>>, SITUS string, YRBLT string")
    meta = {r["key"]: r["value"] for r in reports.ingest(raw, str(tmp_path / "layer"), "given.shp", "Lots").collect()}
    assert meta["feature_count"] == "2" and meta["dataset_name"] == '"Lots"' and meta["extent"].startswith("[1.0,0.0")
    got = {r["id"]: r for r in spark.read.parquet(str(tmp_path / "layer/parcels")).collect()}
    assert set(got) == {1, 4} and got[1]["address"] == "a" and got[1]["dwel_yrblt"] == 1990 and got[4]["dwel_yrblt"] is None and got[1]["owner"] is None
    assert ids(parcels.read_box(spark, str(tmp_path / "layer/parcels"), (3.04, 0.0, 3.045, 0.0005))) == [4]  # far from its corner's tile


def test_features_make_a_collection(spark):
    made = spark.createDataFrame([(0, '{"a":1}'), (1, '{"a":2}')], "ord long, feature string")
    text = "\n".join(r["value"] for r in reports.collection(made, spark.createDataFrame([(5,)], "parcels long")).collect())
    assert [f["a"] for f in json.loads(text)["features"]] == [1, 2] and json.loads(text)["properties"] == {"parcels": 5}
    assert json.loads("".join(r["value"] for r in reports.collection(made.limit(0)).collect()))["features"] == []


def test_files(spark, tmp_path):
    ring = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    feature = {"type": "Feature", "properties": {"id": "7", "n": 1}, "geometry": {"type": "Polygon", "coordinates": ring}}
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature, feature | {"geometry": None}]}))
    (tmp_path / "b.json").write_text(json.dumps(feature) + "\nnot json\n")
    for name, lines in (("a.json", False), ("b.json", True)):
        got = files.read_features(spark, str(tmp_path / name), lines).collect()
        assert [r["id"] for r in got] == ["7"] and got[0]["ring"][1]["x"] == 1
    (tmp_path / "m.json").write_text(json.dumps({"scenes": [{"id": "s", "datetime": "2024-01-01T00:00:00Z", "assets": {"red": "r.tif", "nir": {"href": "n.tif", "band": 4}}}]}))
    assets = files.read_scenes(spark, str(tmp_path / "m.json")).first()["assets"]
    assert (assets["red"]["href"], assets["red"]["band"], assets["nir"]["href"], assets["nir"]["band"]) == ("r.tif", 1, "n.tif", 4)
    raw = spark.createDataFrame([(" a ", "12.9", "x"), ("", "0", "0")], "PIN string, living_area string, bldg_value string")
    got = files.mapped(raw).collect()
    assert got[0]["pin"] == "a" and got[1]["pin"] is None and got[0]["dwel_sfla"] == 12.9 and got[0]["apr_bldg"] is None and got[1]["apr_bldg"] == 0.0 and got[0]["owner"] is None


def test_small_pieces(spark, block, tmp_path):
    assert files.scale_of("uint8") == 255 and files.scale_of("int16") == 10_000 and files.scale_of("float32") == 1 and files.scale_of("uint8", 2.0) == 2
    known = {"r": "red", "red": "red", "g": "green", "b": "blue", "nir": "nir"}
    assert files.bands_of(["B", "g", "R"], known) == ["blue", "green", "red"] and files.bands_of(["", "", "", ""], known) == ["red", "green", "blue", "nir"] and files.bands_of(["x"], known, "nir, red") == ["nir", "red"]
    for bad in ((["x"], "purple"), (["x", "y"], None)):
        with pytest.raises(ValueError):
            files.bands_of(bad[0], known, bad[1])
    items = spark.createDataFrame([("a", "s2", 10.0, {"red": "x", "nir": "y"}), ("b", "s2", None, {"red": "x"}), ("c", "l8", 90.0, {"nir": "y", "red": "z"})], "id string, collection string, cloud double, assets map<string,string>")
    assert {r["id"] for r in scenes.having(items, "s2", 50.0).collect()} == {"a", "b"} and {r["id"] for r in scenes.having(items, bands=("red", "nir")).collect()} == {"a", "c"}
    assert items.where("id = 'a'").select(scenes.bands(F.col("assets")).alias("b")).first()["b"] == ["red", "nir"]
    assert scenes.by_id(items, "b").count() == 1
    with pytest.raises(JobError):
        scenes.by_id(items, "z")
    assert render.hex_to_rgb("#ff8000") == (255, 128, 0)
    assert not parcels.exists(spark, str(tmp_path / "none")) and ids(parcels.in_order(block))[0] == 1
    kind, some, failed = structures.chosen(None, structures.from_tax_roll(block), block)
    assert kind == "tax-roll" and some.count() == 9 and [x["id"] for x in structures.sources() if x["available"]] == ["auto", "tax-roll"]


def test_calendar_and_grid_size(spark):
    got = [r["id"] for r in scenes.calendar(spark, "2024-02-20", "2024-03-20", "2024-03-03").collect()]
    assert "demo-2024-02-26" in got and "demo-2024-03-07" in got and got == sorted(got)
    assert scenes.common_gsd(1.0, 2.0, 0.5, 100, 100, 10**6) == 2.0
    assert scenes.common_gsd(1.0, 1.0, None, 10_000, 10_000, 10**6) == 10.0
