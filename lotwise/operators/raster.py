"""Rasters as pixel tables: reading onto another grid, and tiled pyramids.

A grid is north-up and square: left and top in metres, gsd metres a pixel, width and height in pixels. A band is a table (row, col, value, valid); pixels that are not there are not valid.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.sources.tables import scope, stored

#: Side of the blocks that are resampled, and of the tiles of a pyramid, in pixels.
BLOCK, TILE = 256, 256
#: A pyramid ends before the level whose shorter side is below this.
LEAST_SIDE = 32


@dataclass(frozen=True)
class Raster:
    left: float
    top: float
    gsd: float
    width: int
    height: int

    @property
    def pixel_area_m2(self) -> float:
        return self.gsd * self.gsd


def scaled(pixels: DataFrame, divisor: float = 1.0, offset: float = 0.0, nodata: float | None = None) -> DataFrame:
    """(row, col, value, valid) of raw pixels (row, col, value): what is null, not a number or ``nodata`` is not valid, the rest is (value + offset) / divisor."""
    raw = F.col("value").cast("double")
    good = raw.isNotNull() & ~F.isnan(raw) & (F.lit(True) if nodata is None else raw != nodata)
    return pixels.select("row", "col", F.when(good, (raw + offset) / divisor).alias("value"), good.alias("valid"))


def window(source: Raster, target: Raster) -> tuple[int, int, int, int] | None:
    """(row0, col0, row1, col1) of the part of ``source`` under ``target``, with a pixel around it."""
    col0, row0 = (target.left - source.left) / source.gsd - 1, (source.top - target.top) / source.gsd - 1
    col1, row1 = col0 + target.width * target.gsd / source.gsd + 2, row0 + target.height * target.gsd / source.gsd + 2
    row0, col0, row1, col1 = max(0, floor(row0)), max(0, floor(col0)), min(source.height, ceil(row1)), min(source.width, ceil(col1))
    return (row0, col0, row1, col1) if row0 < row1 and col0 < col1 else None


def _averaged(pixels: DataFrame, rows: int, cols: int, out_rows: int, out_cols: int) -> DataFrame:
    """Pixels of a window (row and col from 0) as means over a coarser one, each weighted by the area of it that a coarse pixel covers."""

    def parts(at: str, size: int, out: int) -> Column:
        step = size / out
        first, last = F.floor(F.col(at) / step), F.least(F.ceil((F.col(at) + 1) / step) - 1, F.lit(out - 1))
        share = lambda k: F.least((k + 1) * step, F.col(at) + 1.0) - F.greatest(k * step, F.col(at).cast("double"))
        return F.filter(F.transform(F.sequence(first, last), lambda k: F.struct(k.alias("at"), share(k).alias("w"))), lambda p: p["w"] > 1e-12)

    dealt = pixels.where("valid").select("value", F.explode(parts("row", rows, out_rows)).alias("r"), F.col("col")).select("value", "r", F.explode(parts("col", cols, out_cols)).alias("c"))
    weight = F.col("r.w") * F.col("c.w")
    means = dealt.groupBy(F.col("r.at").alias("row"), F.col("c.at").alias("col")).agg((F.sum(F.col("value") * weight) / F.sum(weight)).alias("value"))
    return means.withColumn("valid", F.lit(True))


def read_to_grid(pixels: DataFrame, source: Raster, target: Raster, block: int = BLOCK) -> DataFrame:
    """(row, col, value, valid) of every pixel of ``target``, from (row, col, value, valid) of ``source`` in the same projection.

    A source more than twice as fine is averaged to twice the target's sampling first. Values are bilinear between the four source pixels around the target's centre, those outside the source left out and those
    not valid counted as 0; a pixel is valid if the source pixel that its centre lies in is, else its value is 0. Each source pixel goes to the target blocks that it touches (one, but at their borders), so a task holds a block and
    what lies under it.
    """
    spark, part = pixels.sparkSession, window(source, target)
    blocks = spark.range(ceil(target.height / block) * ceil(target.width / block)).select(F.expr(f"id div {ceil(target.width / block)}").alias("br"), (F.col("id") % ceil(target.width / block)).alias("bc"))
    if part is None:
        part, used = (0, 0, 1, 1), pixels.where(F.lit(False))
    else:
        used = pixels.where(F.col("row").between(part[0], part[2] - 1) & F.col("col").between(part[1], part[3] - 1))
    rows, cols = part[2] - part[0], part[3] - part[1]
    out_rows, out_cols = min(rows, 2 * target.height), min(cols, 2 * target.width)
    used = used.select((F.col("row") - part[0]).alias("row"), (F.col("col") - part[1]).alias("col"), F.col("value").cast("double").alias("value"), "valid")
    if out_rows < rows or out_cols < cols:
        used = _averaged(used, rows, cols, out_rows, out_cols)
    # a coarse pixel's centre in target pixels is step * (k + 0.5) + start
    step_r, step_c = rows / out_rows * source.gsd / target.gsd, cols / out_cols * source.gsd / target.gsd
    start_r, start_c = (target.top - source.top) / target.gsd + part[0] * source.gsd / target.gsd, (source.left - target.left) / target.gsd + part[1] * source.gsd / target.gsd

    def touched(at: str, step: float, start: float, size: int) -> Column:
        middle = (F.col(at) + 0.5) * step + start
        lo, hi = F.floor((middle - step - 1) / block), F.floor((middle + step + 1) / block)
        lo, hi = F.greatest(lo, F.lit(0)), F.least(hi, F.lit((size - 1) // block))
        return F.when(lo <= hi, F.sequence(lo, hi))

    to_rows, to_cols = touched("row", step_r, start_r, target.height), touched("col", step_c, start_c, target.width)
    dealt = used.where("valid").withColumn("br", F.explode(to_rows)).withColumn("bc", F.explode(to_cols)).select("br", "bc", "row", "col", "value")

    def fill(key, found, _):
        br, bc = key[0].as_py(), key[1].as_py()
        at_r = np.arange(br * block, min((br + 1) * block, target.height))
        at_c = np.arange(bc * block, min((bc + 1) * block, target.width))
        v, u = (at_r + 0.5 - start_r) / step_r - 0.5, (at_c + 0.5 - start_c) / step_c - 0.5
        r0, c0 = int(np.floor(v[0])) - 1, int(np.floor(u[0])) - 1
        shape = (int(np.floor(v[-1])) + 3 - r0, int(np.floor(u[-1])) + 3 - c0)
        values, valid = np.zeros(shape), np.zeros(shape, bool)
        fr, fc = (found.column(c).to_numpy() for c in ("row", "col"))
        near = (fr >= r0) & (fr < r0 + shape[0]) & (fc >= c0) & (fc < c0 + shape[1])
        values[fr[near] - r0, fc[near] - c0] = found.column("value").to_numpy()[near]
        valid[fr[near] - r0, fc[near] - c0] = True
        total, weights = np.zeros((len(v), len(u))), np.zeros((len(v), len(u)))
        for dr in (0, 1):
            for dc in (0, 1):
                rr, cc = np.floor(v).astype(int) + dr, np.floor(u).astype(int) + dc
                wr, wc = np.where((rr >= 0) & (rr < out_rows), 1 - np.abs(v - rr), 0), np.where((cc >= 0) & (cc < out_cols), 1 - np.abs(u - cc), 0)
                w = wr[:, None] * wc[None, :]
                total += w * values[np.ix_(rr - r0, cc - c0)]
                weights += w
        nr, nc = np.floor(v + 0.5).astype(int), np.floor(u + 0.5).astype(int)
        good = valid[np.ix_(nr - r0, nc - c0)] & ((nr >= 0) & (nr < out_rows))[:, None] & ((nc >= 0) & (nc < out_cols))[None, :]
        out = np.where(good, total / np.where(weights > 0, weights, 1), 0.0)
        return pa.table({"row": np.repeat(at_r, len(at_c)).astype(np.int64), "col": np.tile(at_c, len(at_r)).astype(np.int64), "value": out.ravel(), "valid": good.ravel()})

    return dealt.groupBy("br", "bc").cogroup(blocks.groupBy("br", "bc")).applyInArrow(fill, "row long, col long, value double, valid boolean")


# -- pyramids ----------------------------------------------------------------------------------------------------------


def levels(width: int, height: int) -> list[int]:
    """The levels of a pyramid: 0 is the raster, each further one half as fine, while the shorter side has ``LEAST_SIDE`` pixels; at most five."""
    return [0, *[k for k in range(1, 5) if min(width, height) // 2**k >= LEAST_SIDE]]


def write_pyramid(pixels: DataFrame, layers: list[str], raster: Raster, path: str, tile: int = TILE, valid: str = "valid") -> None:
    """Stores layers of (row, col, valid, layers) as tiles: (layer, level) folders with tile_row, tile_col and the tile's values by rows, null where no valid pixel lies.

    A pixel of a level is the mean of the valid pixels under it, from their sums, so levels do not add up rounding.
    """
    long = pixels.where(F.col(valid)).select("row", "col", F.explode(F.array(*[F.struct(F.lit(n).alias("layer"), F.col(n).cast("double").alias("v")) for n in layers])).alias("x")).select("row", "col", "x.*").where(F.col("v").isNotNull())
    now = long.select("layer", "row", "col", F.col("v").alias("s"), F.lit(1).cast("bigint").alias("n"))

    def pack(key, found):
        values = np.full(tile * tile, np.nan)
        values[found.column("p").to_numpy()] = found.column("v").to_numpy()
        lists = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, mask=np.isnan(values)))
        return pa.table([*[pa.array([k.as_py()], t) for k, t in zip(key, (pa.string(), pa.int64(), pa.int64()))], lists], ["layer", "tile_row", "tile_col", "values"])

    with scope():
        for k in levels(raster.width, raster.height):
            if k:  # from the sums of the level before, which are a quarter as many each time
                now = stored(now.groupBy("layer", F.expr("row div 2").alias("row"), F.expr("col div 2").alias("col")).agg(F.sum("s").alias("s"), F.sum("n").alias("n")))
            place = (F.pmod("row", F.lit(tile)) * tile + F.pmod("col", F.lit(tile))).cast("int")
            cells = now.select("layer", F.expr(f"row div {tile}").alias("tile_row"), F.expr(f"col div {tile}").alias("tile_col"), place.alias("p"), (F.col("s") / F.col("n")).alias("v"))
            packed = cells.groupBy("layer", "tile_row", "tile_col").applyInArrow(pack, "layer string, tile_row long, tile_col long, values array<double>")
            packed.select("layer", F.lit(k).alias("level"), "tile_row", "tile_col", F.lit(tile).alias("side"), "values").write.mode("append" if k else "overwrite").partitionBy("layer", "level").parquet(path)


def raster_window(spark: SparkSession, path: str, layer: str, raster: Raster, box: tuple[int, int, int, int], size: int) -> DataFrame:
    """(level, row, col, value): the pixels of a window (row0, col0, row1, col1 of the full raster) on the coarsest level that still has ``size`` pixels along its longer side; only its tiles are read."""
    r0, c0, r1, c1 = max(0, box[0]), max(0, box[1]), min(raster.height, box[2]), min(raster.width, box[3])
    longest = max(r1 - r0, c1 - c0)
    level = max(k for k in levels(raster.width, raster.height) if k == 0 or longest / 2**k >= size)
    lo_r, lo_c, hi_r, hi_c = r0 >> level, c0 >> level, (r1 - 1) >> level, (c1 - 1) >> level
    tiles = spark.read.parquet(path).where((F.col("layer") == layer) & (F.col("level") == level))
    side = tiles.select("side").limit(1).collect()
    if not side:
        return spark.createDataFrame([], "level int, row long, col long, value double")
    side = side[0]["side"]
    near = tiles.where(F.col("tile_row").between(lo_r // side, hi_r // side) & F.col("tile_col").between(lo_c // side, hi_c // side))
    cells = near.select("tile_row", "tile_col", F.posexplode("values").alias("p", "value")).where(F.col("value").isNotNull())
    row, col = F.col("tile_row") * side + F.expr(f"p div {side}"), F.col("tile_col") * side + F.col("p") % side
    return cells.select(F.lit(level).alias("level"), row.alias("row"), col.alias("col"), "value").where(F.col("row").between(lo_r, hi_r) & F.col("col").between(lo_c, hi_c))


def chip(spark: SparkSession, path: str, layers: list[str], raster: Raster, box: tuple[int, int, int, int], size: int) -> dict[str, np.ndarray]:
    """Each layer's window as an array of ``size`` pixels along its longer side, nan where nothing is: a picture of one lot. Bounded by ``size``: the level is chosen for it."""
    r0, c0, r1, c1 = max(0, box[0]), max(0, box[1]), min(raster.height, box[2]), min(raster.width, box[3])
    if r1 <= r0 or c1 <= c0:
        return {}
    scale = size / max(r1 - r0, c1 - c0)
    shape = max(1, round((r1 - r0) * scale)), max(1, round((c1 - c0) * scale))
    out = {}
    for layer in layers:
        found = raster_window(spark, path, layer, raster, box, size).toPandas()
        level = int(found["level"].iloc[0]) if len(found) else 0
        lo_r, lo_c = r0 >> level, c0 >> level
        array = np.full((((r1 - 1) >> level) - lo_r + 1, ((c1 - 1) >> level) - lo_c + 1), np.nan)
        array[found["row"] - lo_r, found["col"] - lo_c] = found["value"]
        at = lambda n, low, high: np.minimum(((np.arange(n) + 0.5) * (high - low) / n + low).astype(int) >> level, (high - 1) >> level)  # noqa: B023, E731
        out[layer] = array[np.ix_(at(shape[0], r0, r1) - lo_r, at(shape[1], c0, c1) - lo_c)]
    return out
