"""Coordinate and velocity transforms, rotation of star clusters by shell.

Input columns are x, y, z, vx, vy, vz and, where it counts, mass.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lumentab.functions.sky import KMS_PER_MASYR_KPC
from lumentab.operators.windows import filled_steps, running_totals
from lumentab.session import ensure_checkpoint_dir

c = F.col


def spherical_to_xyz(ra: Column, dec: Column, dist: Column) -> tuple[Column, Column, Column]:
    a, d = F.radians(ra), F.radians(dec)
    return dist * F.cos(d) * F.cos(a), dist * F.cos(d) * F.sin(a), dist * F.sin(d)


def xyz_to_spherical(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """ra in [0, 360), dec, distance; dec is NULL at the origin."""
    r = F.sqrt(x * x + y * y + z * z)
    ra = F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))
    return ra, F.degrees(F.asin(F.least(F.greatest(F.try_divide(z, r), F.lit(-1.0)), F.lit(1.0)))), r


def space_velocity(ra: Column, dec: Column, dist_kpc: Column, pm_ra_cosdec: Column, pm_dec: Column,
                   rv: Column) -> tuple[Column, Column, Column]:
    """Cartesian km/s from proper motion (mas/yr, RA part already times cos dec) and radial velocity."""
    a, d = F.radians(ra), F.radians(dec)
    ta, td = pm_ra_cosdec * dist_kpc * KMS_PER_MASYR_KPC, pm_dec * dist_kpc * KMS_PER_MASYR_KPC
    return (
        rv * F.cos(d) * F.cos(a) - ta * F.sin(a) - td * F.sin(d) * F.cos(a),
        rv * F.cos(d) * F.sin(a) + ta * F.cos(a) - td * F.sin(d) * F.sin(a),
        rv * F.sin(d) + td * F.cos(d),
    )


@dataclass(frozen=True)
class GalacticFrame:
    """Parameters of the Galactocentric frame (published values, replaceable)."""

    ra_deg: float = 266.4051
    dec_deg: float = -28.936175
    roll_deg: float = 58.5986320306
    distance_kpc: float = 8.122
    z_sun_kpc: float = 0.0208
    sun_kms: tuple[float, float, float] = (12.9, 245.6, 7.78)

    def rotation(self) -> np.ndarray:
        """Turn x towards the centre, roll to the plane, tilt by the height of the Sun."""
        a, d, e = (math.radians(v) for v in (self.ra_deg, self.dec_deg, self.roll_deg))
        towards = np.array([
            [math.cos(d) * math.cos(a), math.cos(d) * math.sin(a), math.sin(d)],
            [-math.sin(a), math.cos(a), 0.0],
            [-math.sin(d) * math.cos(a), -math.sin(d) * math.sin(a), math.cos(d)]])
        roll = np.array([[1, 0, 0], [0, math.cos(e), math.sin(e)], [0, -math.sin(e), math.cos(e)]])
        return self.tilt() @ roll @ towards

    def tilt(self) -> np.ndarray:
        t = math.asin(self.z_sun_kpc / self.distance_kpc)
        return np.array([[math.cos(t), 0, math.sin(t)], [0, 1, 0], [-math.sin(t), 0, math.cos(t)]])

    def offset(self) -> np.ndarray:
        return self.tilt() @ np.array([-self.distance_kpc, 0.0, 0.0])


def _rotate(matrix: np.ndarray, v: Sequence[Column], shift: Sequence[float]) -> list[Column]:
    return [
        F.lit(float(row[0])) * v[0] + F.lit(float(row[1])) * v[1] + F.lit(float(row[2])) * v[2] + F.lit(float(s))
        for row, s in zip(matrix, shift)
    ]


def to_galactocentric(xyz_kpc: Sequence[Column], v_kms: Sequence[Column],
                      frame: GalacticFrame = GalacticFrame()) -> tuple[list[Column], list[Column]]:
    """Position (kpc) and velocity (km/s) in the Galactocentric frame."""
    m = frame.rotation()
    return _rotate(m, xyz_kpc, frame.offset()), _rotate(m, v_kms, frame.sun_kms)


def radius() -> Column:
    return F.sqrt(c("x") * c("x") + c("y") * c("y") + c("z") * c("z"))


def _cross() -> tuple[Column, Column, Column]:
    return (c("y") * c("vz") - c("z") * c("vy"), c("z") * c("vx") - c("x") * c("vz"), c("x") * c("vy") - c("y") * c("vx"))


def with_moments(df: DataFrame, weight: str | None = "mass") -> DataFrame:
    """Complete rows with radius r, weight w, r x v (hx, hy, hz), its length h and r^2."""
    needed = ["x", "y", "z", "vx", "vy", "vz"] + ([weight] if weight else [])
    hx, hy, hz = _cross()
    out = df.na.drop(subset=needed).withColumns({
        "r": radius(), "w": F.col(weight).cast("double") if weight else F.lit(1.0), "hx": hx, "hy": hy, "hz": hz})
    return out.withColumns({
        "h": F.sqrt(c("hx") * c("hx") + c("hy") * c("hy") + c("hz") * c("hz")), "r2": c("r") * c("r")})


def angular_velocity(df: DataFrame) -> DataFrame:
    """Per particle r x v / r^2; NULL at the origin."""
    m = with_moments(df, None)
    return m.withColumns({f"omega_{k}": F.try_divide(c(f"h{k}"), c("r2")) for k in "xyz"}).drop(
        "r", "w", "hx", "hy", "hz", "h", "r2")


def collective_rotation(df: DataFrame, weight: str | None = "mass") -> DataFrame:
    """Angular velocity L/I, its axis and the mean tangential speed, one row."""
    m = with_moments(df, weight)
    sums = m.agg(
        *[F.sum(c("w") * c(f"h{k}")).alias(f"l{k}") for k in "xyz"], F.sum(c("w") * c("r2")).alias("i"),
        F.sum(c("w") * F.try_divide(c("h"), c("r"))).alias("wt"), F.sum("w").alias("w"))
    om = {k: F.when(c("i") == 0, 0.0).otherwise(F.try_divide(c(f"l{k}"), c("i"))) for k in "xyz"}
    out = sums.select(*[om[k].alias(f"omega_{k}") for k in "xyz"], F.try_divide(c("wt"), c("w")).alias("tangential"))
    size = F.sqrt(sum((c(f"omega_{k}") * c(f"omega_{k}") for k in "yz"), c("omega_x") * c("omega_x")))
    return out.withColumns({f"axis_{k}": F.when(size == 0, 0.0).otherwise(F.try_divide(c(f"omega_{k}"), size)) for k in "xyz"})


def shell_rotation(df: DataFrame, weight: str | None = "mass", tiny: float = 1e-10) -> DataFrame:
    """Rotation per shell (s-1 < r <= s): one aggregation, empty shells absent.

    The angular velocity of a row is 0 where its moment of inertia is not above
    ``tiny``; the axis is the mean unit vector of rows whose angular momentum is.
    """
    m = with_moments(df, weight).where(c("r") > 0).withColumn("shell", F.ceil("r").cast("int"))
    spin = F.when(c("w") * c("r2") > tiny, c("h") / c("r2")).otherwise(0.0)
    turning = c("w") * c("h") > tiny
    shells = m.groupBy("shell").agg(
        F.avg(spin).alias("mean_omega"), F.avg(c("h") / c("r")).alias("mean_tangential"),
        *[F.avg(F.when(turning, c(f"h{k}") / c("h"))).alias(f"u{k}") for k in "xyz"],
        F.sum("w").alias("total_mass"), F.avg("w").alias("mean_mass"))
    size = F.sqrt(c("ux") * c("ux") + c("uy") * c("uy") + c("uz") * c("uz"))
    axis = {f"axis_{k}": F.coalesce(F.try_divide(c(f"u{k}"), size), F.lit(0.0)) for k in "xyz"}
    return shells.withColumns(axis).drop("ux", "uy", "uz")


def cumulative_shells(df: DataFrame, sums: dict[str, Column], step: float = 1.0, filled: bool = True) -> DataFrame:
    """Totals of all rows with r <= R for R = step, 2 step, .. up to the largest r.

    Rows are summed per shell first; only the shells that hold rows are
    accumulated, in two levels (see ``windows.running_totals``).  Shells between
    them repeat the totals of the last one that holds rows; without ``filled``
    they are left out, so a far-off row costs one row and not the way to it.
    Radii that enclose no row are absent.
    """
    ensure_checkpoint_dir(df.sparkSession)
    shell = F.greatest(F.ceil(c("r") / step), F.lit(1).cast("bigint"))
    per_shell = df.groupBy(shell.alias("shell")).agg(*[F.coalesce(F.sum(e), F.lit(0)).alias(n) for n, e in sums.items()]).where("shell is not null").checkpoint()
    out = running_totals(per_shell, "shell", list(sums), following="further")
    out = out.select("shell", F.coalesce(c("further") - 1, c("shell")).alias("until"), *[c(f"cum_{n}").alias(n) for n in sums])
    out = filled_steps(out, "shell", "until") if filled else out.drop("until")
    return out.select((c("shell") * step).alias("radius"), *sums)


def _axis_of(prefix: str) -> list[Column]:
    size = F.sqrt(sum((c(f"{prefix}{k}") * c(f"{prefix}{k}") for k in "yz"), c(f"{prefix}x") * c(f"{prefix}x")))
    return [F.try_divide(c(f"{prefix}{k}"), size).alias(f"axis_{k}") for k in "xyz"]


def _momentum_sums() -> dict[str, Column]:
    return {"n": F.lit(1), "mass": c("w"), **{f"l{k}": c("w") * c(f"h{k}") for k in "xyz"}}


def shell_tangential_rms(df: DataFrame, weight: str | None = "mass") -> DataFrame:
    """Weighted rms tangential speed within R, with the axis, mass and count."""
    m = with_moments(df, weight)
    speed2 = c("vx") * c("vx") + c("vy") * c("vy") + c("vz") * c("vz")
    along = c("x") * c("vx") + c("y") * c("vy") + c("z") * c("vz")
    vt2 = F.coalesce(speed2 - F.try_divide(along * along, c("r2")), speed2)
    out = cumulative_shells(m, {**_momentum_sums(), "wv": c("w") * vt2})
    return out.select("radius", F.sqrt(F.try_divide(c("wv"), c("mass"))).alias("rms_tangential"), *_axis_of("l"), "mass", "n")


def shell_tangential_signed(df: DataFrame, weight: str | None = "mass", sign: str = "reference") -> DataFrame:
    """Weighted mean of the signed speed across the overall axis, within R.

    ``sign="reference"`` follows r x axis, so prograde motion is negative;
    ``"prograde"`` turns the sign round.
    """
    if sign not in ("reference", "prograde"):
        raise ValueError("sign is 'reference' or 'prograde'")
    m = with_moments(df, weight)
    total = m.agg(*[F.sum(c("w") * c(f"h{k}")).alias(f"l{k}") for k in "xyz"])
    axis = total.select(F.struct(*_axis_of("l"))).scalar()
    m = m.withColumn("ax", axis)
    a = {k: c(f"ax.axis_{k}") for k in "xyz"}
    along = c("vx") * a["x"] + c("vy") * a["y"] + c("vz") * a["z"]
    m = m.withColumns({f"t{k}": c(f"v{k}") - along * a[k] for k in "xyz"})
    side = (c("tx") * (c("y") * a["z"] - c("z") * a["y"]) + c("ty") * (c("z") * a["x"] - c("x") * a["z"])
            + c("tz") * (c("x") * a["y"] - c("y") * a["x"]))
    size = F.sqrt(c("tx") * c("tx") + c("ty") * c("ty") + c("tz") * c("tz"))
    turn = F.sign(side) * size * (1.0 if sign == "reference" else -1.0)
    out = cumulative_shells(m, {**_momentum_sums(), "wv": c("w") * turn})
    return out.select("radius", F.try_divide(c("wv"), c("mass")).alias("mean_tangential"), *_axis_of("l"), "mass", "n")


@F.pandas_udf(ArrayType(DoubleType()))
def _leading_axis(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.Series:
    """Eigenvector of the largest eigenvalue of 3x3 symmetric matrices, largest part positive."""
    m = np.array([[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]], dtype=float).transpose(2, 0, 1)
    v = np.linalg.eigh(m)[1][:, :, -1]
    lead = np.take_along_axis(v, np.abs(v).argmax(axis=1)[:, None], axis=1)
    return pd.Series(list(v * np.where(lead < 0, -1.0, 1.0)))


def shell_axis_svd(df: DataFrame) -> DataFrame:
    """Best axis of all r x v within R: leading right singular vector of the rows.

    The rows enter as six sums of products per shell; the 3x3 eigenproblem is
    solved once per shell.  Means of |r x v|/r and |r x v|/r^2 come along.
    """
    m = with_moments(df, None).where(c("r") > 0)
    pairs = ["xx", "xy", "xz", "yy", "yz", "zz"]
    sums = {p: c(f"h{p[0]}") * c(f"h{p[1]}") for p in pairs}
    out = cumulative_shells(m, {"n": F.lit(1), **sums, "t": c("h") / c("r"), "o": c("h") / c("r2")})
    out = out.withColumn("axis", _leading_axis(*pairs))
    return out.select("radius", "n", *[F.get("axis", F.lit(i)).alias(f"axis_{k}") for i, k in enumerate("xyz")],
                      (c("t") / c("n")).alias("mean_tangential"), (c("o") / c("n")).alias("mean_omega"))


def centre_of_mass(df: DataFrame, weight: str = "mass") -> DataFrame:
    """Mass-weighted mean position, one row."""
    kept = df.na.drop(subset=["x", "y", "z", weight])
    return kept.agg(*[F.try_divide(F.sum(c(weight) * c(k)), F.sum(weight)).alias(f"{k}_com") for k in "xyz"])
