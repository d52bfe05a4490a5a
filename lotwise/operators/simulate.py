"""A simulated event: intensity, flooding, damage, and noise that depends on world coordinates only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwise.functions.measures import clip, unit_hash


def swath(x: Column, y: Column, x0: float, y0: float, heading: float, half_width: float, severity: float, noise: Column) -> Column:
    """Intensity across a track through (x0, y0): bell-shaped, roughened by noise, 0 to 1."""
    from math import cos, radians, sin

    across = (x - x0) * cos(radians(heading)) - (y - y0) * sin(radians(heading))
    return clip(F.exp(-F.pow(across / half_width, 2)) * (0.60 + 0.75 * noise) * severity, 0.0, 1.0)


def flood(y: Column, channel: Column, width: float, intensity: Column) -> Column:
    return (F.abs(y - channel) < width) & (intensity > 0.15)


def damage(key: Column, salt: str, intensity: Column, severity: float) -> Column:
    """State of a structure drawn from its id: destroyed, major, minor or intact."""
    roll, p = unit_hash(F.lit(salt), key), clip(intensity, 0.0, 1.0) * severity
    return F.when(roll < p * 0.32, "destroyed").when(roll < p * 0.62, "major").when(roll < p * 0.92, "minor").otherwise("intact")


def phenology(day: Column) -> Column:
    return 0.55 + 0.45 * (0.5 - 0.5 * F.cos(2 * 3.141592653589793 * (F.dayofyear(day) - 20) / 365.25))


def _corner(i: Column, j: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(i, j, F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0


def lattice_noise(x: Column, y: Column, scale: float, seed: int = 1, octaves: int = 3) -> Column:
    """Value noise in 0 to 1: hashed corners of a world lattice, blended linearly, in octaves."""
    total, weight = F.lit(0.0), 0.0
    for o in range(octaves):
        s, w = scale / 2**o, 0.5**o
        i, j = F.floor(x / s), F.floor(y / s)
        u, v = x / s - i, y / s - j
        c = lambda a, b, i=i, j=j, o=o: _corner(i + a, j + b, seed + o)
        total = total + w * ((1 - u) * (1 - v) * c(0, 0) + u * (1 - v) * c(1, 0) + (1 - u) * v * c(0, 1) + u * v * c(1, 1))
        weight += w
    return total / weight
