"""Structures on parcels: from the tax roll, or from mapped footprints joined to the parcel they overlap most."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions import geo, shapes
from lotwise.functions import measures as M
from lotwise.operators.parcels import tile_of, tiles_of
from lotwise.operators.zonal import line_runs, pixels_of
from lotwise.params import CORE_AREA_FACTOR, CORE_INSET_M, CORE_MIN_RADIUS_M, LARGE_PARCEL_M2, SQFT_TO_M2, JobError

ASPECT = 1.35


def from_tax_roll(parcels: DataFrame, spread: float = 0.0) -> DataFrame:
    """Up to two approximate structures per parcel: parcel_id, id, kind, ord, area_m2, description, approximate, and the offset (dx, dy) in metres and
    angle of a rectangle (width, height) from the parcel's centre."""
    limit = F.greatest(F.lit(20.0), F.col("area_m2") * 0.6)
    own = lambda kind, area, text: F.struct(F.lit(kind).alias("kind"), F.least(area, limit).alias("area_m2"), text.alias("description"))
    house = F.when(F.coalesce(F.col("dwel_sfla"), F.lit(0.0)) > 0, own("dwelling", M.roof_m2(F.col("dwel_sfla"), F.col("dwel_desc")), F.col("dwel_desc")))
    shed = F.when((F.coalesce(F.col("ob_area"), F.lit(0.0)) > 0) & M.is_structure(F.col("ob_desc")), own("outbuilding", F.greatest(F.lit(10.0), F.col("ob_area") * SQFT_TO_M2), F.col("ob_desc")))
    both = F.filter(F.array(house, shed), lambda s: s.isNotNull())
    out = parcels.select(F.col("id").alias("parcel_id"), F.posexplode(both).alias("ord", "s")).select("parcel_id", "ord", "s.*")
    dx, dy, angle = M.jitter(F.col("parcel_id") * 7 + F.col("ord") * 13, spread)
    side, back = F.sqrt("area_m2"), F.col("kind") == "outbuilding"
    width = F.sqrt(F.col("area_m2") * ASPECT)
    return out.select(
        "parcel_id",
        F.concat(F.lit("p"), F.col("parcel_id").cast("string"), F.lit("-"), F.substring("kind", 1, 3), F.col("ord").cast("string")).alias("id"),
        "kind",
        "ord",
        "area_m2",
        "description",
        F.lit(True).alias("approximate"),
        (dx + F.when(back, side * 1.6).otherwise(0.0)).alias("dx"),
        (dy - F.when(back, side * 1.2).otherwise(0.0)).alias("dy"),
        angle.alias("angle"),
        width.alias("width"),
        (F.col("area_m2") / width).alias("height"),
    )


def overlapping(footprints: DataFrame, parcels: DataFrame, size: float = 0.01) -> DataFrame:
    """Footprints (fid, x0, y0, x1, y1, and shape unless they are boxes) with the parcel that shares the most area with them, the smaller id on ties; null where none does.

    Parcels with a ``shape`` count by it, others by their bounds. Both sides are keyed by the tiles they touch, so the join is an equi-join; a pair that meets in several tiles counts in one only.
    """
    f, p = ("x0", "y0", "x1", "y1"), ("minx", "miny", "maxx", "maxy")
    cols = lambda names: tuple(F.col(c) for c in names)
    formed = {"f": "shape" in footprints.columns, "p": "shape" in parcels.columns}
    left = footprints.select("fid", *f, *(["shape"] if formed["f"] else []), F.explode(tiles_of(*cols(f), size)).alias("tile"))
    right = parcels.select("id", *p, *([F.col("shape").alias("lot")] if formed["p"] else []), F.explode(tiles_of(*cols(p), size)).alias("tile"))
    own_tile = tile_of(F.greatest("x0", "minx"), F.greatest("y0", "miny"), size) == F.col("tile")
    shared = geo.boxes_overlap(cols(f), cols(p))
    if any(formed.values()):
        a = F.coalesce("shape", shapes.box(*cols(f))) if formed["f"] else shapes.box(*cols(f))
        b = F.coalesce("lot", shapes.box(*cols(p))) if formed["p"] else shapes.box(*cols(p))
        shared = F.when(shared > 0, shapes.shared_area(a, b)).otherwise(0.0)
    pairs = left.join(right, "tile").where(geo.boxes_meet(cols(f), cols(p)) & own_tile).select("fid", "id", shared.alias("overlap"), ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("bounds")).where("overlap > 0")
    # shares of shapes that differ by rounding only are equal
    rank = F.struct(F.bround(F.col("overlap") / F.col("bounds"), 9) if any(formed.values()) else F.col("overlap"), -F.col("id"))
    best = pairs.groupBy("fid").agg(F.max_by("id", rank).alias("parcel_id"), F.max("overlap").alias("overlap"))
    return footprints.join(best, "fid", "left")


def core_pixels(lots: DataFrame, gsd: float = 1.0) -> DataFrame:
    """(zone, ord, row, col): where the structures of lots of any shape plausibly sit. ``lots``: zone, ord, shape (rings in pixels of ``gsd`` metres), built_m2.

    The core is made of the pixels whose centre keeps a distance from all edges, or of all pixels where those are less than 0.15 of the lot's area. On a large lot it is cut to a disc around a point
    that surely lies inside, unless nothing would be left of it.
    """
    area = shapes.area(F.col("shape")) * gsd * gsd
    radius = F.greatest(F.lit(CORE_MIN_RADIUS_M), F.sqrt(F.greatest(F.coalesce("built_m2", F.lit(0.0)), F.lit(40.0)) * CORE_AREA_FACTOR)) / gsd
    dealt = lots.select("zone", "ord", "shape", "built_m2").where("zone is not null and ord is not null").repartition("zone", "ord")  # a small table of lots is one partition
    sized = geo.exploded(dealt, {"area": area, "middle": shapes.interior_point(F.col("shape"))})
    sized = sized.select("zone", "ord", "shape", "area", F.when(F.col("area") > LARGE_PARCEL_M2, F.struct(F.col("middle.x").alias("x"), F.col("middle.y").alias("y"), radius.alias("radius"))).alias("disc"))
    lines = line_runs(sized, inset=CORE_INSET_M / gsd)
    reach = F.nanvl(F.sqrt(F.pow("disc.radius", F.lit(2)) - F.pow(F.col("row") + 0.5 - F.col("disc.y"), F.lit(2))), F.lit(0.0))  # 0 where the disc does not meet the row
    lines = geo.exploded(lines, {"reach": F.coalesce(reach, F.lit(0.0))})
    # the columns whose centre is nearer to the disc's middle than that; the rounding of the two ends is looked after
    within = lambda c: F.abs(c + 0.5 - F.col("disc.x")) < F.col("reach")
    west, east = F.ceil(F.col("disc.x") - F.col("reach") - 0.5).cast("long"), F.floor(F.col("disc.x") + F.col("reach") - 0.5).cast("long")
    west = geo.once(west, lambda c: F.when(within(c - 1), c - 1).when(within(c), c).otherwise(c + 1))
    east = geo.once(east, lambda c: F.when(within(c + 1), c + 1).when(within(c), c).otherwise(c - 1))
    lines = geo.exploded(lines, {"west": west, "east": east})
    cut = lambda runs: F.filter(F.transform(runs, lambda r: F.struct(F.greatest(r["a"], "west").alias("a"), F.least(r["b"], "east").alias("b"))), lambda r: r["a"] <= r["b"])
    near = lambda runs: F.when(F.col("disc").isNull(), F.col(runs)).otherwise(F.when(F.col("disc.x").isNull(), F.slice(runs, 1, 0)).otherwise(cut(runs)))
    count = lambda runs: F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"] + 1)
    lines = geo.exploded(lines, {"n_deep": count("deep"), "n": count(near("cols")), "m": count(near("deep"))})
    lot = Window.partitionBy("zone", "ord")  # counts and lines in one pass: a lot's lines are few numbers each
    whole = F.sum("n_deep").over(lot) * gsd * gsd < 0.15 * F.max("area").over(lot)
    lines = lines.select("*", whole.alias("whole"), F.sum("n").over(lot).alias("ns"), F.sum("m").over(lot).alias("ms"))
    lines = lines.withColumn("cut", F.when(F.col("whole"), F.col("ns")).otherwise(F.col("ms")) > 0)
    core = F.when(F.col("whole"), F.when(F.col("cut"), near("cols")).otherwise(F.col("cols"))).otherwise(F.when(F.col("cut"), near("deep")).otherwise(F.col("deep")))
    return lines.select("zone", "ord", "row", F.explode(pixels_of(core)).alias("col"))


def developed_core(lots: DataFrame, gsd: float = 1.0) -> DataFrame:
    """Where the structures of a lot plausibly sit. ``lots``: box (x0, y0, x1, y1) in pixels of ``gsd`` metres and built_m2. Adds ring (the lot pulled back from its
    edge, or all of it where little would be left) and, on large lots, a disc (cx, cy, radius in pixels) around its centre that the core is cut to."""
    inset = CORE_INSET_M / gsd
    inner = (F.col("x1") - F.col("x0") - 2 * inset, F.col("y1") - F.col("y0") - 2 * inset)
    lot = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    whole = (inner[0] <= 0) | (inner[1] <= 0) | (inner[0] * inner[1] < 0.15 * lot)
    by = F.when(whole, 0.0).otherwise(inset)
    large = lot * gsd * gsd > LARGE_PARCEL_M2
    radius = F.greatest(F.lit(CORE_MIN_RADIUS_M), F.sqrt(F.greatest(F.coalesce("built_m2", F.lit(0.0)), F.lit(40.0)) * CORE_AREA_FACTOR)) / gsd
    return lots.withColumns(
        {
            "ring": geo.box_ring(F.col("x0") + by, F.col("y0") + by, F.col("x1") - by, F.col("y1") - by),
            "cx": F.when(large, (F.col("x0") + F.col("x1")) / 2),
            "cy": F.when(large, (F.col("y0") + F.col("y1")) / 2),
            "radius": F.when(large, radius),
        }
    )


def with_zone(structures: DataFrame) -> DataFrame:
    """``structures`` with the zone that each is scored on: a mapped one has its own, the approximate ones of a parcel share one."""
    own = F.when(F.col("approximate"), F.xxhash64("parcel_id")).otherwise(F.xxhash64("parcel_id", F.col("id").cast("string")))
    return structures.withColumn("zone", F.pmod(own, F.lit(2**62)) + 1)


def zones(structures: DataFrame, lots: DataFrame, gsd: float) -> DataFrame:
    """(zone, ord, ring, cx, cy, radius): shapes to label in pixels. ``structures`` with zone, and ring (in pixels) for the mapped ones; ``lots``: parcel_id and box in pixels."""
    disc = [F.lit(None).cast("double").alias(c) for c in ("cx", "cy", "radius")]
    rank = F.struct(F.col("parcel_id").cast("bigint").alias("parcel"), F.col("approximate").alias("shared"), F.col("ord").cast("bigint").alias("ord")).alias("ord")
    guessed = structures.where("approximate").groupBy("parcel_id", "zone").agg(F.sum("area_m2").alias("built_m2"), F.lit(True).alias("approximate"), F.max("ord").alias("ord"))
    shared = developed_core(guessed.join(lots, "parcel_id"), gsd).select("zone", rank, "ring", "cx", "cy", "radius")
    if "ring" not in structures.columns:
        return shared
    return structures.where(~F.col("approximate") & F.col("ring").isNotNull()).select("zone", rank, "ring", *disc).unionByName(shared)


def choose_source(n_mapped: int, n_parcels: int, has_file: bool, per_hundred: float = 25.0) -> str:
    """Which structures to use: a footprint file, the mapped footprints if there are enough of them, else the tax roll."""
    if has_file:
        return "file"
    return "mapped" if n_parcels and 100.0 * n_mapped / n_parcels >= per_hundred else "tax-roll"


def sources(file: str | None = None, mapped: bool = False) -> list[dict]:
    """The kinds of structures that may be used, with whether they can be."""
    return [
        {"id": "auto", "approximate": not file, "available": True},
        {"id": "tax-roll", "approximate": True, "available": True},
        {"id": "file", "approximate": False, "available": bool(file)},
        {"id": "mapped", "approximate": False, "available": mapped},
    ]


def chosen(mapped, tax_roll, parcels: DataFrame, file=None, per_hundred: float = 25.0) -> tuple[str, DataFrame, list[tuple[str, str]]]:
    """The structures to use, their kind, and (kind, error) of the sources that failed: those of a file, the mapped ones if there are enough of them, else the tax roll's.

    A source is a table or what makes one (None where there is none). Each is read for a first row before it is taken, and one that cannot be read is passed over; only a failing tax roll is an error.
    """
    problems: list[tuple[str, str]] = []

    def tried(kind: str, source) -> DataFrame | None:
        if source is None:
            return None
        try:
            found = source() if callable(source) else source
            found.limit(1).count()
            return found
        except Exception as e:  # whatever a source may raise
            problems.append((kind, str(e)[:500]))
            return None

    given = tried("file", file)
    if given is not None:
        return "file", given, problems
    found = tried("mapped", mapped)
    if found is not None and choose_source(found.count(), parcels.count(), False, per_hundred) == "mapped":
        return "mapped", found, problems
    last = tried("tax-roll", tax_roll)
    if last is None:
        raise JobError(f"no source of structures can be read: {problems}")
    return "tax-roll", last, problems
