"""Display layers of pixel tables, and PNG files of bounded crops."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions.measures import clip
from lotwise.operators.quantiles import quantiles


def stretched(pixels: DataFrame, bands: list[str], valid: str, low: float = 0.02, high: float = 0.98, gamma: float = 1.35) -> DataFrame:
    """``bands`` as 0-255 between two percentiles pooled over all of them; invalid pixels black."""
    pooled = quantiles(pixels.where(F.col(valid)).select(F.explode(F.array(*bands)).alias("v")), {"v": F.col("v")}, (low, high))
    lo, hi = (pooled.get((None, "v", q)) for q in (low, high))
    if lo is None:
        return pixels.withColumns({b: F.lit(0) for b in bands})
    level = lambda b: F.pow(clip((F.col(b) - lo) / max(hi - lo, 1e-6), 0.0, 1.0), 1 / gamma)
    return pixels.withColumns({b: F.when(F.col(valid), F.bround(level(b) * 255, 0).cast("int")).otherwise(0) for b in bands})


def score_byte(score):
    """Score as 0-255, cut off, as rasters store it."""
    return F.floor(score * 255).cast("int")


def downsampled(pixels: DataFrame, longest: int, most: int = 1024) -> DataFrame:
    step = max(1, -(-longest // most))
    return pixels.where((F.col("row") % step == 0) & (F.col("col") % step == 0))


def overview(pixels: DataFrame, column: str, factor: int) -> DataFrame:
    """Means of ``factor`` x ``factor`` blocks."""
    block = lambda c: F.floor(F.col(c) / factor).alias(c)
    return pixels.groupBy(block("row"), block("col")).agg(F.avg(column).alias(column))


def rgb(pixels: DataFrame, bands: list[str], valid: str = "valid", **how) -> DataFrame:
    """(row, col, r, g, b) of three bands, each stretched on its own percentiles."""
    out = pixels.select("row", "col", valid, *bands)
    for b in bands:
        out = stretched(out, [b], valid, **how)
    return out.select("row", "col", *[F.col(b).alias(c) for b, c in zip(bands, "rgb")])


def side_by_side(images: list[DataFrame], gap: int = 4, fill: int = 255) -> DataFrame:
    """Pixel tables (row, col from 0, r, g, b) next to one another, as high as the lowest, with ``gap`` columns of ``fill`` between them."""
    if not images:
        raise ValueError("nothing to join")
    sizes = [x.agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w")).first() for x in images]
    height, left, out = min(s["h"] for s in sizes), 0, None
    for image, size in zip(images, sizes):
        moved = image.where(F.col("row") < height).select(F.col("row").cast("bigint"), (F.col("col") + left).cast("bigint").alias("col"), *[F.col(c).cast("int").alias(c) for c in "rgb"])
        if out is not None:
            line = image.sparkSession.range(height).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(left - gap).cast("bigint"), F.lit(left - 1).cast("bigint"))).alias("col"), *[F.lit(fill).alias(c) for c in "rgb"])
            out = out.unionByName(line) if gap else out
        out = moved if out is None else out.unionByName(moved)
        left += size["w"] + gap
    return out


def hex_to_rgb(text: str) -> tuple[int, int, int]:
    return tuple(bytes.fromhex(text.lstrip("#")[:6]))


def png(image: np.ndarray) -> bytes:
    """An 8-bit PNG of a grey, RGB or RGBA array."""
    kind = {2: 0, 3: 2, 4: 6}[2 if image.ndim == 2 else image.shape[2]]
    rows = np.ascontiguousarray(image, np.uint8).reshape(image.shape[0], -1)
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, kind, 0, 0, 0)
    body = zlib.compress(np.hstack([np.zeros((len(rows), 1), np.uint8), rows]).tobytes(), 6)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def crop_png(pixels: DataFrame, columns: list[str], row0: int, row1: int, col0: int, col1: int, most: int = 1024) -> bytes:
    """PNG of a crop of at most ``most`` pixels a side; only the crop reaches the driver."""
    if row1 - row0 > most or col1 - col0 > most:
        raise ValueError("the crop is too large")
    got = pixels.where(F.col("row").between(row0, row1 - 1) & F.col("col").between(col0, col1 - 1)).select("row", "col", *columns).toPandas()
    image = np.zeros((row1 - row0, col1 - col0, len(columns)), np.uint8)
    image[got["row"] - row0, got["col"] - col0] = got[columns].to_numpy()
    return png(image[:, :, 0] if len(columns) == 1 else image)
