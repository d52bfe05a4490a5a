"""A Spark data source for catalogue items (one STAC item as JSON a line): filters reach the reader, every file is a partition.

    spark.dataSource.register(CatalogueSource)
    spark.read.format("catalogue").option("preset", "sentinel-2-l2a").load(folder).where("cloud <= 20 and datetime >= '2024-01-05'")

Files are opened by Arrow's file systems, so local, HDFS and object store addresses do. Rows are built for items that pass the pushed filters only.
"""

from __future__ import annotations

import io
import json
import operator
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from lotwise.params import JobError

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
SHAPE = "id string, datetime string, collection string, platform string, gsd double, cloud double, west double, south double, east double, north double, assets map<string,string>"


@dataclass(frozen=True)
class Preset:
    """How to read one collection: the assets of its bands, its pixel size, and the property with its cloud cover."""

    collection: str
    label: str
    bands: dict[str, str]
    gsd: float
    cloud: str = "eo:cloud_cover"
    band_index: dict[str, int] = field(default_factory=dict)


_PLAIN = {"blue": "blue", "green": "green", "red": "red", "nir": "nir"}
#: Public collections by catalogue, with the asset of each band.
PRESETS = {
    "earth-search": {
        "sentinel-2-l2a": Preset("sentinel-2-l2a", "Sentinel-2 L2A (10 m, ~5 day revisit)", _PLAIN, 10.0),
        "landsat-c2-l2": Preset("landsat-c2-l2", "Landsat 8/9 Collection 2 L2 (30 m)", _PLAIN | {"nir": "nir08"}, 30.0),
    },
    "planetary": {
        "sentinel-2-l2a": Preset("sentinel-2-l2a", "Sentinel-2 L2A (10 m, ~5 day revisit)", {"blue": "B02", "green": "B03", "red": "B04", "nir": "B08"}, 10.0),
        "naip": Preset("naip", "NAIP aerial (0.6-1 m, every 2-3 years, US only)", dict.fromkeys(("red", "green", "blue", "nir"), "image"), 0.6, "", {"red": 1, "green": 2, "blue": 3, "nir": 4}),
    },
}


def preset(catalogue: str, collection: str) -> Preset:
    try:
        return PRESETS[catalogue][collection]
    except KeyError:
        raise JobError(f"no preset for {collection!r} of {catalogue!r}") from None


def presets(spark: SparkSession) -> DataFrame:
    """(catalogue, collection, label, gsd, bands) of all presets."""
    rows = [(c, p.collection, p.label, p.gsd, list(p.bands)) for c, some in PRESETS.items() for p in some.values()]
    return spark.createDataFrame(rows, "catalogue string, collection string, label string, gsd double, bands array<string>")


def enabled_ids(listed: str) -> list[str]:
    """Provider ids of a setting that separates them by commas."""
    return [x for x in map(str.strip, listed.split(",")) if x]


def providers(spark: SparkSession, today: str, event: str, local_ready: bool, listed: str = "") -> DataFrame:
    """What imagery can be chosen: local scenes, simulated scenes and the presets of catalogues, with the dates to search by default and whether ``listed`` enables it (an empty list enables all).

    Dates are given as yyyy-MM-dd. Simulated scenes are searched 40 days around the event, catalogues in the last 120 days with the event some 30 days ago; local scenes have no default.
    """
    own = [("local", "Registered scenes", None, False, local_ready, False), ("demo", "Simulated scenes", 1.0, False, True, True)]
    shown = spark.createDataFrame(own, "id string, label string, gsd double, requires_network boolean, available boolean, synthetic boolean")
    remote = presets(spark).select(F.concat_ws(":", "catalogue", "collection").alias("id"), "label", "gsd", F.lit(True).alias("requires_network"), F.lit(True).alias("available"), F.lit(False).alias("synthetic"))
    now, hit = F.to_date(F.lit(today)), F.to_date(F.lit(event))
    simulated = {"pre_start": F.date_sub(hit, 40), "pre_end": F.date_sub(hit, 1), "post_start": F.date_add(hit, 1), "post_end": F.date_add(hit, 40)}
    recent = {"pre_start": F.date_sub(now, 120), "pre_end": F.date_sub(now, 30), "post_start": F.date_sub(now, 29), "post_end": now}
    window = {c: F.when(F.col("synthetic"), simulated[c]).when(F.col("requires_network"), recent[c]) for c in recent}
    wanted = enabled_ids(listed)
    return shown.unionByName(remote).withColumns(window).withColumn("enabled", F.col("id").isin(wanted) if wanted else F.lit(True))


@dataclass
class FilePartition(InputPartition):
    path: str


_COMPARE: dict[type, Callable] = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
_COMPARED = ("id", "datetime", "collection", "platform", "gsd", "cloud", "west", "south", "east", "north")


def _file_system(path: str):
    from pyarrow import fs

    if re.match(r"\w+:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


class CatalogueReader(DataSourceReader):
    def __init__(self, path: str, chosen: Preset | None):
        self.path, self.chosen, self.tests = path, chosen, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes comparisons and lists of plain columns; the rest is left to Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            if type(f) in _COMPARE and column in _COMPARED:
                self.tests.append((column, _COMPARE[type(f)], f.value))
            elif isinstance(f, In) and column in _COMPARED:
                self.tests.append((column, lambda v, some: v in some, tuple(f.value)))
            elif isinstance(f, IsNotNull) and column in _COMPARED:
                self.tests.append((column, lambda v, _: True, None))
            else:
                yield f

    def partitions(self) -> list[FilePartition]:
        from pyarrow import fs

        system, root = _file_system(self.path)
        found = system.get_file_info(root)
        files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        return [FilePartition(x.path) for x in sorted(files, key=lambda x: x.path) if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        system, _ = _file_system(self.path)
        with io.TextIOWrapper(system.open_input_stream(partition.path), encoding="utf-8") as lines:
            for line in lines:
                row = self.row(line)
                if row is not None and all(row[c] is not None and test(row[c], value) for c, test, value in self.tests):
                    yield tuple(row.values())

    def row(self, line: str) -> dict | None:
        """The columns of an item; none for a line that is no item, an item of another collection, or one without a band of the preset."""
        try:
            item = json.loads(line)
            facts, assets = item.get("properties") or {}, item.get("assets") or {}
        except (ValueError, AttributeError):
            return None
        p = self.chosen
        if p is not None and item.get("collection") != p.collection:
            return None
        names = p.bands if p is not None else {k: k for k in assets}
        held = {band: assets[key]["href"] for band, key in names.items() if isinstance(assets.get(key), dict) and assets[key].get("href")}
        if not held:
            return None
        number = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
        box = [number(v) for v in item.get("bbox") or []]
        west, south, east, north = box if len(box) == 4 else (None,) * 4
        cloud = (p.cloud if p is not None else "eo:cloud_cover") or None
        text = lambda v: None if v is None else str(v)
        return {
            "id": text(item.get("id")), "datetime": text(facts.get("datetime")), "collection": text(item.get("collection")), "platform": text(facts.get("platform")) or "",
            "gsd": number(facts.get("gsd")) or (p.gsd if p is not None else None), "cloud": number(facts.get(cloud)) if cloud else None, "west": west, "south": south, "east": east, "north": north, "assets": held,
        }


class CatalogueSource(DataSource):
    """Options: path; catalogue (earth-search unless given) and preset, a collection, for the bands and cloud of that collection."""

    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def schema(self) -> str:
        return SHAPE

    def reader(self, schema) -> CatalogueReader:
        named = self.options.get("preset")
        return CatalogueReader(self.options["path"], preset(self.options.get("catalogue", "earth-search"), named) if named else None)


def items(spark: SparkSession, path: str, box: tuple[float, float, float, float], start: str, end: str, catalogue: str = "earth-search", collection: str | None = None, max_cloud: float | None = None, limit: int = 50) -> DataFrame:
    """The first ``limit`` items by time whose box meets another and whose day lies in a range of days, with at most so much cloud. All conditions reach the reader."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(CatalogueSource)
    source = spark.read.format("catalogue").option("catalogue", catalogue)
    w, s, e, n = box
    day_after = F.date_format(F.date_add(F.to_date(F.lit(end)), 1), "yyyy-MM-dd")
    found = (source.option("preset", collection) if collection else source).load(path)
    found = found.where((F.col("datetime") >= start) & (F.col("datetime") < day_after) & (F.col("west") <= e) & (F.col("east") >= w) & (F.col("south") <= n) & (F.col("north") >= s))
    if max_cloud is not None and max_cloud < 100 and not (collection and not preset(catalogue, collection).cloud):
        found = found.where(F.col("cloud") <= max_cloud)
    return found.orderBy("datetime", "id").limit(limit)
