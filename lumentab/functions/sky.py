"""Sky positions, distances and stellar quantities as expressions.  Angles in degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: CODATA Stefan-Boltzmann constant, km/s per (mas/yr * kpc)
SIGMA_SB = 5.670374419e-8
KMS_PER_MASYR_KPC = 4.74047


def hms_to_degrees(h: Column, m: Column, s: Column) -> Column:
    return (h + m / 60 + s / 3600) * 15


def dms_to_degrees(d: Column, m: Column, s: Column) -> Column:
    """``d`` is the degree field as text, so that the sign of "-00" is kept."""
    text = F.trim(d)
    sign = F.when(text.startswith("-"), -1.0).otherwise(1.0)
    return sign * (F.abs(text.cast("double")) + m / 60 + s / 3600)


def angular_distance(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Haversine distance in degrees; the argument of asin is clamped at 1."""
    d1, d2 = F.radians(dec1), F.radians(dec2)
    a = F.pow(F.sin(F.abs(d1 - d2) / 2), F.lit(2.0))
    b = F.cos(d1) * F.cos(d2) * F.pow(F.sin(F.abs(F.radians(ra1) - F.radians(ra2)) / 2), F.lit(2.0))
    return F.degrees(2 * F.asin(F.sqrt(F.least(a + b, F.lit(1.0)))))


def parallax_distance_pc(parallax_mas: Column) -> Column:
    """1000 / parallax; no distance for parallaxes that are not positive."""
    return F.when(parallax_mas > 0, 1000 / parallax_mas)


def luminosity_watt(radius_m: Column, t_eff_k: Column) -> Column:
    return F.lit(4 * math.pi * SIGMA_SB) * F.pow(radius_m, F.lit(2.0)) * F.pow(t_eff_k, F.lit(4.0))


def colour_indices(u: Column, g: Column, r: Column, i: Column, z: Column) -> dict[str, Column]:
    return {"u_g": u - g, "g_r": g - r, "r_i": r - i, "i_z": i - z}


def concentration(r50: Column, r90: Column) -> Column:
    return F.try_divide(r50, r90)


def ra_window(dec: Column, radius: Column | float) -> Column:
    """Half width in right ascension that holds all points within ``radius``.

    asin(sin r / cos dec); the whole circle when the pole is within reach.
    """
    radius = F.lit(float(radius)) if isinstance(radius, (int, float)) else radius
    ratio = F.sin(F.radians(radius)) / F.cos(F.radians(dec))
    return F.when(F.abs(dec) + radius >= 90, 180.0).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))))
