"""Band measures, damage classes and attribute rules as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwise.params import CLASS_COLOURS, CLASSES, FOCUS_SIZES, NOT_STRUCTURES, OTHER_STOREY_FACTOR, SQFT_TO_M2, STOREY_FACTOR, Detector


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def index(a: Column, b: Column) -> Column:
    """Normalised difference, 0 where the sum is next to nothing; null if a band is missing."""
    total = a + b
    return F.when(total.isNull(), None).when(F.abs(total) > 1e-6, clip((a - b) / total, -1.0, 1.0)).otherwise(0.0)


def ndvi(nir: Column, red: Column) -> Column:
    return index(nir, red)


def ndwi(green: Column, nir: Column) -> Column:
    return index(green, nir)


def brightness(blue: Column, green: Column, red: Column) -> Column:
    return (red + green + blue) / 3.0


def damage_class(score: Column, detector: Detector = Detector()) -> Column:
    """Null and not-a-number are none."""
    out = F.when(score.isNull() | F.isnan(score) | (F.abs(score) == float("inf")), CLASSES[0])
    for limit, name in zip(detector.class_breaks, CLASSES):
        out = out.when(score < limit, name)
    return out.otherwise(CLASSES[-1])


def class_rank(name: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(c) for c in CLASSES]), name) - 1).cast("int")


def confidence(pixels: Column, approximate: Column, gsd: Column, footprint_m2: Column) -> Column:
    spanned = F.coalesce(footprint_m2, F.lit(0.0)) / (gsd * gsd)
    guessed = F.when((pixels >= 12) & (spanned >= 4), "medium").otherwise("low")
    mapped = F.when((pixels >= 20) & (spanned >= 12), "high").when((pixels >= 6) & (spanned >= 2), "medium").otherwise("low")
    return F.when(pixels <= 0, "low").when(approximate, guessed).otherwise(mapped)


def focus_size(area_m2: Column, gsd: Column) -> Column:
    """Odd window about as wide as the structure, one of the fixed sizes."""
    side = F.rint(F.sqrt(F.greatest(area_m2, F.lit(25.0))) / F.greatest(gsd, F.lit(1e-6))).cast("int")
    target = F.greatest(F.lit(3), side.bitwiseOR(F.lit(1)))
    sizes = F.array(*[F.lit(s) for s in FOCUS_SIZES])
    return F.coalesce(F.array_min(F.filter(sizes, lambda s: s >= target)), F.lit(FOCUS_SIZES[-1]))


def is_structure(description: Column) -> Column:
    words = F.array(*[F.lit(w) for w in NOT_STRUCTURES])
    return F.when(F.coalesce(description, F.lit("")) == "", False).otherwise(~F.exists(words, lambda w: F.contains(F.upper(description), w)))


def roof_m2(living_sqft: Column, style: Column) -> Column:
    factors = F.create_map(*[F.lit(x) for kv in STOREY_FACTOR.items() for x in kv])
    factor = F.coalesce(F.try_element_at(factors, F.upper(F.trim(F.coalesce(style, F.lit(""))))), F.lit(OTHER_STOREY_FACTOR))
    return F.greatest(F.lit(20.0), living_sqft * SQFT_TO_M2 / factor)


def jitter(seed: Column, spread: float) -> tuple[Column, Column, Column]:
    """A fixed offset (dx, dy) and angle for an integer seed."""
    h = F.pmod(F.pmod(seed, F.lit(2**32)) * F.lit(2654435761), F.lit(2**32))
    part = lambda k: F.shiftright(h, k).bitwiseAND(F.lit(255)) / 255.0
    return (part(0) - 0.5) * 2 * spread, (part(8) - 0.5) * 2 * spread, part(16) * 180.0


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the joined parts' SHA-256."""
    head = F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % 1000003).cast("double") / 1000003.0


def label(address: Column, pin: Column, parid: Column, key: Column) -> Column:
    full = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(full(address), full(pin), full(parid), F.concat(F.lit("parcel "), key.cast("string")))


def finite(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def ramp(score: Column, valid: Column, detector: Detector = Detector(), alpha: int = 200) -> Column:
    """Colour of a score as a struct (r, g, b, a); transparent where there is no damage or no data."""
    colours = CLASS_COLOURS
    kind = damage_class(score, detector)
    out = F.struct(F.lit(0).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"), F.lit(0).alias("a"))
    for name, (r, g, b) in colours.items():
        out = F.when(valid & (kind == name), F.struct(F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b"), F.lit(alpha).alias("a"))).otherwise(out)
    return out
