"""The catalogue data source."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, Not, StringContains

from lotwise.operators import rollup, scenes
from lotwise.params import JobError
from lotwise.sources import catalogue as C
from lotwise.sources import files


def item(key, day, cloud, west=0.0, collection="sentinel-2-l2a", assets=("blue", "green", "red", "nir"), **more):
    return {"id": key, "collection": collection, "bbox": [west, 10.0, west + 1, 11.0], "properties": {"datetime": f"2024-01-{day:02d}T10:00:00Z", "eo:cloud_cover": cloud, "platform": "s2a"}, "assets": {a: {"href": f"s3://x/{key}/{a}"} for a in assets}} | more


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("items")
    first = [item("a", 1, 5.0), item("b", 2, 80.0), item("c", 3, None), item("d", 3, 10, west=50.0), item("none", 4, 1, assets=("thumbnail",))]
    second = [item("e", 9, 0.0, collection="landsat-c2-l2", assets=("blue", "nir08")), item("f", 5, 7.0, bbox=None), item("g", 20, 3.0), item("h", 5, 9.0, assets=("red",))]
    (at / "one.json").write_text("\n".join(map(json.dumps, first)) + "\nno json\n[1, 2]\n\n")
    (at / "two.json").write_text("\n".join(map(json.dumps, second)))
    (at / "_SUCCESS").write_text("")
    return str(at)


def test_items(spark, folder):
    got = C.items(spark, folder, (0.5, 10.5, 0.6, 10.6), "2024-01-01", "2024-01-19", collection="sentinel-2-l2a", max_cloud=50.0)
    assert [r["id"] for r in got.collect()] == ["a", "h"]
    assert [r["id"] for r in C.items(spark, folder, (0.5, 10.5, 0.6, 10.6), "2024-01-01", "2024-01-31", collection="sentinel-2-l2a", limit=3).collect()] == ["a", "b", "c"]
    assert [r["id"] for r in C.items(spark, "file://" + folder, (0.5, 10.5, 0.6, 10.6), "2024-01-20", "2024-01-20").collect()] == ["g"]
    landsat = C.items(spark, folder, (0, 10, 1, 11), "2024-01-01", "2024-01-31", collection="landsat-c2-l2").first()
    assert landsat["assets"] == {"blue": "s3://x/e/blue", "nir": "s3://x/e/nir08"} and landsat["gsd"] == 30.0 and landsat["platform"] == "s2a"


def test_filters_are_taken(spark, folder):
    reader = C.CatalogueReader(folder, None)
    given = [EqualTo(("collection",), "x"), GreaterThanOrEqual(("cloud",), 5.0), In(("id",), ("a", "b")), IsNotNull(("west",))]
    left = [Not(EqualTo(("id",), "a")), StringContains(("id",), "a"), EqualTo(("assets", "blue"), "x")]
    assert list(reader.pushFilters([*given, *left])) == left and len(reader.tests) == 4
    assert len(reader.partitions()) == 2
    reader.tests = [t for t in reader.tests if t[0] == "cloud"]
    assert sorted(r[0] for p in reader.partitions() for r in reader.read(p)) == ["a", "b", "d", "f", "h"]
    spark.conf.set(C.PUSHDOWN, "true")
    spark.dataSource.register(C.CatalogueSource)
    plan = spark.read.format("catalogue").load(folder).where((F.col("cloud") <= 5) & F.col("id").contains("a"))._jdf.queryExecution().executedPlan().toString()
    assert "contains(id" in plan.split("BatchScan")[0].lower() and "cloud" not in plan.split("BatchScan")[0].split("Filter")[1].split("\n")[0]


def test_presets(spark):
    assert C.presets(spark).count() == 4 and C.preset("planetary", "naip").band_index["nir"] == 4
    with pytest.raises(JobError):
        C.preset("planetary", "nothing")


def test_providers_and_their_dates(spark):
    got = {r["id"]: r for r in C.providers(spark, "2024-03-01", "2024-01-10", False, " demo, planetary:naip ,").collect()}
    assert set(got) == {"local", "demo"} | {f"{c}:{k}" for c, some in C.PRESETS.items() for k in some}
    assert {k for k, r in got.items() if r["enabled"]} == {"demo", "planetary:naip"}
    dates = lambda r: [str(r[c]) for c in ("pre_start", "pre_end", "post_start", "post_end")]
    assert dates(got["demo"]) == ["2023-12-01", "2024-01-09", "2024-01-11", "2024-02-19"]
    assert dates(got["planetary:naip"]) == ["2023-11-02", "2024-01-31", "2024-02-01", "2024-03-01"]
    assert dates(got["local"]) == ["None"] * 4 and not got["local"]["available"]
    assert all(r["enabled"] for r in C.providers(spark, "2024-03-01", "2024-01-10", True).collect())


def test_manifests_that_are_absent_or_empty(spark, tmp_path):
    for name, text in {"none.json": '{"scenes": []}', "one.json": '{"scenes": [{"id": "a"}]}'}.items():
        (tmp_path / name).write_text(text)
    assert [files.has_scenes(spark, str(tmp_path / x)) for x in ("absent.json", "none.json", "one.json")] == [False, False, True]
    hrefs = spark.createDataFrame([("a.tif",), ("/x/a.tif",), ("s3://x/a.tif",), (None,)], "h string")
    assert [r[0] for r in hrefs.select(files.resolved(F.col("h"), "/d/")).collect()] == ["/d/a.tif", "/x/a.tif", "s3://x/a.tif", None]


def test_records_of_scenes(spark):
    rows = spark.sql("SELECT 'a' AS id, timestamp'2024-01-05 10:00:00' AS datetime, 'local' AS provider, '' AS platform, 'naip' AS collection, 0.6D AS gsd, map('nir', 'n', 'red', 'r', 'x', 'y') AS assets, CAST(NULL AS DOUBLE) AS cloud")
    got = json.loads(scenes.records(rows).first()["record"])
    assert got["label"] == "2024-01-05 | naip | 0.6 m" and got["bands"] == ["red", "nir", "x"] and got["date"] == "2024-01-05" and not got["synthetic"] and "cloud_cover" not in got and "note" not in got
    bare = json.loads(scenes.records(rows.select("id", "datetime", "provider")).first()["record"])
    assert bare["label"] == "2024-01-05" and bare["bands"] == []


def test_shares_and_groups_of_structures(spark):
    scored = spark.createDataFrame([(1, 2, "severe"), (1, 1, "none"), (2, 1, "none"), (3, 1, "destroyed")], "parcel_id long, ord int, damage_class string")
    bars = {r["damage_class"]: (r["rank"], r["structures"], r["share"]) for r in rollup.class_bar(scored).collect()}
    assert bars == {"none": (0, 2, 0.5), "possible": (1, 0, 0.0), "moderate": (2, 0, 0.0), "severe": (3, 1, 0.25), "destroyed": (4, 1, 0.25)}
    assert {r["share"] for r in rollup.class_bar(scored.where("false")).collect()} == {0.0}
    grouped = {r["parcel_id"]: [(s["ord"], s["damage_class"]) for s in r["structures"]] for r in rollup.by_parcel(scored).collect()}
    assert grouped == {1: [(1, "none"), (2, "severe")], 2: [(1, "none")], 3: [(1, "destroyed")]}
