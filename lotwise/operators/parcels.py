"""Queries over a parcel table: lookups, text and box search, extent, upsert, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.functions import geo, shapes

#: Side of a spatial tile in degrees; parcels are stored by tile, and box queries name the tiles they touch.
TILE = 0.01


def tile_of(x: Column, y: Column, size: float = TILE) -> Column:
    return F.concat_ws("_", F.floor(x / size), F.floor(y / size))


def tiles_of(x0: Column, y0: Column, x1: Column, y1: Column, size: float = TILE) -> Column:
    """All tiles that a box touches."""
    xs = F.sequence(F.floor(x0 / size), F.floor(x1 / size))
    return F.flatten(F.transform(xs, lambda i: F.transform(F.sequence(F.floor(y0 / size), F.floor(y1 / size)), lambda j: F.concat_ws("_", i, j))))


def with_tile(parcels: DataFrame) -> DataFrame:
    return parcels.withColumn("tile", tile_of(F.col("minx"), F.col("miny")))


def by_id(parcels: DataFrame, key: int) -> DataFrame:
    return parcels.where(F.col("id") == key)


def by_pin(parcels: DataFrame, pin: str) -> DataFrame:
    return parcels.where((F.col("pin") == pin) | (F.col("parid") == pin))


def many(parcels: DataFrame, keys: list[int]) -> DataFrame:
    """The parcels of a list of ids in its order (``pos``); of a repeated id the last place counts."""
    asked = parcels.sparkSession.createDataFrame([(k, i) for i, k in enumerate(keys)], "id long, pos int").groupBy("id").agg(F.max("pos").alias("pos"))
    return parcels.join(F.broadcast(asked), "id").orderBy("pos")  # as long as the request


def search(parcels: DataFrame, text: str, limit: int = 25) -> DataFrame:
    """Parcels whose address, owner, pin or parid holds the text in any case, by id."""
    like = f"%{text.strip().upper()}%"
    held = [F.col(c).ilike(like) for c in ("address", "owner", "pin", "parid")]
    return parcels.where(held[0] | held[1] | held[2] | held[3]).orderBy("id").limit(limit)


def candidates(parcels: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Parcels whose bounds meet the box; a filter on plain columns, so Parquet statistics prune."""
    w, s, e, n = box
    return parcels.where((F.col("maxx") >= w) & (F.col("minx") <= e) & (F.col("maxy") >= s) & (F.col("miny") <= n))


def in_box(parcels: DataFrame, box: tuple[float, float, float, float], limit: int | None = None) -> DataFrame:
    """Parcels of which a positive area lies in the box, by id; the limit applies after the exact test. Parcels with a ``shape`` are cut as they are, others are their bounds."""
    own = tuple(F.col(c) for c in ("minx", "miny", "maxx", "maxy"))
    w, s, e, n = (F.lit(v) for v in box)
    bounds = geo.boxes_overlap(own, (w, s, e, n))
    within = (own[0] >= w) & (own[1] >= s) & (own[2] <= e) & (own[3] <= n)
    shared = F.when(F.col("shape").isNull(), bounds).when(within, shapes.area(F.col("shape"))).otherwise(shapes.shared_area(F.col("shape"), shapes.box(w, s, e, n))) if "shape" in parcels.columns else bounds
    found = candidates(parcels, box).withColumn("shared", shared).where("shared > 0").orderBy("id")
    return found.limit(limit) if limit else found


def meeting(boxes: DataFrame, parcels: DataFrame, size: float = TILE) -> DataFrame:
    """Boxes (x0, y0, x1, y1) joined with the parcels (id) whose bounds they meet, by the tiles that both touch; a pair that meets in several tiles counts once."""
    left = boxes.withColumn("tile", F.explode(tiles_of(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), size)))
    right = parcels.select("id", "minx", "miny", "maxx", "maxy", F.explode(tiles_of(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"), size)).alias("tile"))
    own = tile_of(F.greatest("x0", "minx"), F.greatest("y0", "miny"), size) == F.col("tile")  # the tile of the corner of what they share
    met = geo.boxes_meet(tuple(F.col(c) for c in ("x0", "y0", "x1", "y1")), tuple(F.col(c) for c in ("minx", "miny", "maxx", "maxy")))
    return left.join(right, "tile").where(met & own).drop("tile")


def shape_of(parcels: DataFrame) -> Column:
    """The parcels' shapes; of those without one, their bounds."""
    bounds = shapes.box(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")])
    return F.coalesce("shape", bounds) if "shape" in parcels.columns else bounds


def in_area(parcels: DataFrame, area: list[list[tuple[float, float]]], limit: int | None = None) -> DataFrame:
    """Parcels that have a point in common with an area of one or more rings (holes and parts are rings alike), by id, with the area that they share with it (``shared``)."""
    xs, ys = [p[0] for ring in area for p in ring], [p[1] for ring in area for p in ring]
    near = candidates(parcels, (min(xs), min(ys), max(xs), max(ys))).withColumn("own", shape_of(parcels))
    found = near.where(shapes.meet(F.col("own"), shapes.given(area))).withColumn("shared", shapes.shared_area(F.col("own"), shapes.given(area))).drop("own").orderBy("id")
    return found.limit(limit) if limit else found


def in_ring(parcels: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """Parcels that have a point in common with a polygon, by id."""
    return in_area(parcels, [ring]).drop("shared")


def extent(parcels: DataFrame) -> DataFrame:
    return parcels.agg(F.min("minx").alias("west"), F.min("miny").alias("south"), F.max("maxx").alias("east"), F.max("maxy").alias("north"), F.count("*").alias("n"))


def upsert(existing: DataFrame, new: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """``existing`` with rows of ``new`` added or replaced; of several new rows of a key the last by ``order`` holds."""
    cols = [c for c in new.columns if c != order]
    last = new.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("r")).select("r.*")
    return existing.join(last, key, "left_anti").unionByName(last.select(existing.columns))


def write(parcels: DataFrame, path: str) -> None:
    """Stores parcels by the tile of their corner; one that is larger than a tile goes to a folder of its own that every search reads."""
    wide = (F.col("maxx") - F.col("minx") > TILE) | (F.col("maxy") - F.col("miny") > TILE)
    tile = F.when(wide, F.lit("wide")).otherwise(tile_of(F.col("minx"), F.col("miny")))
    parcels.withColumn("tile", tile).write.mode("overwrite").partitionBy("tile").parquet(path)


def read_box(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Stored parcels that meet a box; only the tiles around it are listed and read."""
    w, s, e, n = box
    span = lambda a, b: range(int((a - TILE) // TILE), int(b // TILE) + 1)
    tiles = [f"{i}_{j}" for i in span(w, e) for j in span(s, n)]
    return candidates(spark.read.parquet(path).where(F.col("tile").isin(["wide", *tiles])), box)


def exists(spark: SparkSession, path: str) -> bool:
    """True if parcels are stored below ``path``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)) and spark.read.parquet(path).limit(1).count() > 0


def in_order(parcels: DataFrame) -> DataFrame:
    """All parcels by id."""
    return parcels.orderBy("id")


def set_meta(meta: DataFrame, key: str, value: Column) -> DataFrame:
    """``meta`` (key, value as JSON) with one value set."""
    row = meta.sparkSession.range(1).select(F.lit(key).alias("key"), F.to_json(F.struct(value.alias("v"))).alias("text"))
    row = row.select("key", F.expr("substring(text, 6, length(text) - 6)").alias("value"))  # the value of {"v":...}
    return meta.where(F.col("key") != key).unionByName(row)


def get_meta(meta: DataFrame, key: str) -> str | None:
    """The JSON text of a key; null if it is not set."""
    row = meta.where(F.col("key") == key).select("value").first()
    return row["value"] if row else None


def all_meta(meta: DataFrame) -> DataFrame:
    return meta.select("key", "value").orderBy("key")
