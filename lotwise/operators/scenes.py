"""Search and choice of scenes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.params import BANDS, JobError


def search(scenes: DataFrame, start: str, end: str, west: float, east: float, limit: int, max_cloud: float | None = None) -> DataFrame:
    """Per provider the first ``limit`` scenes of a date range whose footprint (west, east) meets the box, or that have none; the cloud limit binds the catalogue only."""
    day = F.to_date("datetime")
    meets = F.coalesce((F.col("west") <= east) & (F.col("east") >= west), F.lit(True))
    found = scenes.where(day.between(F.lit(start), F.lit(end)) & meets)
    if max_cloud is not None and max_cloud < 100:
        found = found.where((F.col("provider") != "catalogue") | (F.col("cloud") <= max_cloud))
    rank = F.row_number().over(Window.partitionBy("provider").orderBy("datetime", "id"))
    return found.withColumn("_r", rank).where(F.col("_r") <= limit).drop("_r").orderBy("datetime", "id")


def search_all(spark: SparkSession, providers: dict[str, Callable[[], DataFrame]], *given, **more) -> tuple[DataFrame | None, DataFrame]:
    """Scenes of several providers (a name and what makes their table) by time, and (provider, error) of those that failed: one that cannot be read does not sink the search."""
    found, problems = [], []
    for name, table in providers.items():
        try:
            found.append(search(table().withColumn("provider", F.lit(name)), *given, **more))
        except Exception as e:  # whatever a source may raise
            problems.append((name, str(e)[:500]))
    scenes = reduce(DataFrame.unionByName, found).orderBy("datetime", "id") if found else None
    return scenes, spark.createDataFrame(problems, "provider string, error string")


def by_id(scenes: DataFrame, key: str) -> DataFrame:
    """The scene of an id; none is a user error."""
    found = scenes.where(F.col("id").cast("string") == key)
    if not found.limit(1).count():
        raise JobError(f"no scene {key!r}; search for imagery again")
    return found


def having(items: DataFrame, collection: str | None = None, max_cloud: float | None = None, bands: tuple[str, ...] = ()) -> DataFrame:
    """Catalogue items of a collection, with at most so much cloud (unknown cloud passes) and with all of some bands among their assets."""
    out = items if collection is None else items.where(F.col("collection") == collection)
    out = out if max_cloud is None else out.where(F.col("cloud").isNull() | (F.col("cloud") <= max_cloud))
    return out.where(F.size(F.array_except(F.array(*map(F.lit, bands)).cast("array<string>"), F.map_keys("assets"))) == 0) if bands else out


def bands(assets: Column) -> Column:
    """Names of the bands of a scene in their usual order, others behind them."""
    usual = F.array(*map(F.lit, BANDS))
    return F.concat(F.array_intersect(usual, F.map_keys(assets)), F.array_sort(F.array_except(F.map_keys(assets), usual)))


def date(scene_time: Column) -> Column:
    return F.date_format(scene_time, "yyyy-MM-dd")


def full_label() -> Column:
    """Label of a scene with all that is known: date, platform or else collection, pixel size, cloud, SYNTHETIC."""
    source = F.coalesce(F.nullif(F.col("platform"), F.lit("")), F.nullif(F.col("collection"), F.lit("")))
    size = F.when(F.coalesce(F.col("gsd"), F.lit(0.0)) != 0, F.concat(F.regexp_replace(F.col("gsd").cast("string"), r"\.0$", ""), F.lit(" m")))
    cloud = F.concat(F.bround("cloud", 0).cast("int").cast("string"), F.lit("% cloud"))
    return F.concat_ws(" | ", date(F.col("datetime")), source, size, cloud, F.when(F.col("synthetic"), F.lit("SYNTHETIC")))


def label() -> Column:
    cloud = F.when(F.col("cloud").isNotNull(), F.concat(F.bround("cloud", 0).cast("int").cast("string"), F.lit("% cloud")))
    return F.concat_ws(" | ", date(F.col("datetime")), F.col("platform"), cloud, F.when(F.col("synthetic"), F.lit("SYNTHETIC")))


def records(scenes: DataFrame) -> DataFrame:
    """(id, record): each scene as JSON with its date, bands in their usual order and full label. Columns that the table lacks are taken as unknown, and unknown fields are left out."""
    kinds = {"collection": "string", "platform": "string", "gsd": "double", "cloud": "double", "assets": "map<string,string>", "preview": "string", "note": "string", "synthetic": "boolean", "bbox": "array<double>"}
    full = scenes.withColumns({c: F.lit(None).cast(kind) for c, kind in kinds.items() if c not in scenes.columns})
    plain = ("provider", "datetime", "collection", "platform", "gsd")
    record = F.struct(
        F.col("id").cast("string").alias("id"), *plain, date(F.col("datetime")).alias("date"), F.col("cloud").alias("cloud_cover"), "bbox",
        F.coalesce(bands(F.col("assets")), F.array().cast("array<string>")).alias("bands"), "preview", F.coalesce("synthetic", F.lit(False)).alias("synthetic"), full_label().alias("label"), "note",
    )
    return full.select("id", F.to_json(record).alias("record"))


def clearest(scenes: DataFrame, by: list[str]) -> DataFrame:
    """Per group the least cloudy scene; unknown cloud counts as 100, the first id wins."""
    return scenes.groupBy(*by).agg(F.min_by("id", F.struct(F.coalesce("cloud", F.lit(100.0)), "id")).alias("id"), F.min(F.coalesce("cloud", F.lit(100.0))).alias("cloud"))


def either_side(scenes: DataFrame, event: str, days_before: int, days_after: int) -> DataFrame:
    """The clearest scene on either side of an event: side, id, cloud."""
    day, event_day = F.to_date("datetime"), F.to_date(F.lit(event))
    side = F.when((day < event_day) & (day >= F.date_sub(event_day, days_before)), "before").when((day > event_day) & (day <= F.date_add(event_day, days_after)), "after")
    return clearest(scenes.withColumn("side", side).where("side is not null"), ["side"])


def calendar(spark: SparkSession, start: str, end: str, event: str, every: int = 12, limit: int = 50) -> DataFrame:
    """Dates of the simulated sensor: every 12 days from 2020-01-01, and one scene six days before and four after the event."""
    first, last, hit = F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.to_date(F.lit(event))
    anchor = F.to_date(F.lit("2020-01-01"))
    skip = F.greatest(F.lit(0), F.ceil(F.datediff(first, anchor) / float(every))).cast("int")
    begin = F.date_add(anchor, skip * every)
    regular = F.when(begin <= last, F.sequence(begin, last, F.expr(f"interval {every} days"))).otherwise(F.array().cast("array<date>"))
    regular = F.slice(regular, 1, limit)
    extra = F.filter(F.array(F.date_sub(hit, 6), F.date_add(hit, 4)), lambda d: (d >= first) & (d <= last))
    days = spark.range(1).select(F.explode(F.array_distinct(F.concat(regular, extra))).alias("day"))
    return days.select("day", F.concat(F.lit("demo-"), F.date_format("day", "yyyy-MM-dd")).alias("id"), (F.col("day") > hit).alias("after_event")).orderBy("day").limit(limit)


def upsert(scenes: DataFrame, new: DataFrame) -> DataFrame:
    """Scenes with new ones registered, an id replacing its former row; of several new rows of an id the latest date holds."""
    one = new.groupBy("id").agg(F.max_by(F.struct(*scenes.columns), "datetime").alias("r")).select("r.*")
    return scenes.join(one, "id", "left_anti").unionByName(one)


def remove(scenes: DataFrame, key: str) -> DataFrame:
    """Scenes without the one of an id; none of it is a user error."""
    by_id(scenes, key)
    return scenes.where(F.col("id").cast("string") != key)


def common_gsd(native_before: float, native_after: float, requested: float | None, width_m: float, height_m: float, most_pixels: int) -> float:
    """Pixel size of a job: never finer than the coarser date, and coarser still if the grid would be too large."""
    native = max(native_before, native_after)
    gsd = max(requested or native, native)
    n = (width_m / gsd) * (height_m / gsd)
    return gsd * (n / most_pixels) ** 0.5 if n > most_pixels else gsd
