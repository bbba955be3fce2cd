"""Catalogue matching, coordinate transforms and cluster kinematics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumentab.operators import distribution as dist
from lumentab.operators import kinematics as kin
from lumentab.operators import ranking, sky
from lumentab.plans.registry import query
from lumentab.plans.statistics import r, rounded

c = F.col

_CAT = """cat AS (SELECT c_custkey AS id, (c_custkey * 137.507764::DOUBLE) % 360 AS ra,
 DEGREES(ASIN(((c_custkey * 0.618033988::DOUBLE) % 1) * 2 - 1)) AS dec, c_acctbal FROM customer),
cat2 AS (SELECT id + 1000000 AS id, ra + (id % 7) * 0.001::DOUBLE AS ra, dec + (id % 7) * 0.001::DOUBLE AS dec FROM cat WHERE id % 3 <> 0)"""

_DIST = """DEGREES(2 * ASIN(SQRT(LEAST(POW(SIN(ABS(RADIANS({d1}) - RADIANS({d2})) / 2), 2) + COS(RADIANS({d1})) * COS(RADIANS({d2}))
 * POW(SIN(ABS(RADIANS({r1}) - RADIANS({r2})) / 2), 2), 1.0::DOUBLE))))"""

_PAIRS = f"""{_CAT}, pairs AS (SELECT a.id AS id1, b.id AS id2, {_DIST.format(r1='a.ra', d1='a.dec', r2='b.ra', d2='b.dec')} AS dist
 FROM cat a, cat2 b), m AS (SELECT id1, FIRST(id2 ORDER BY dist, id2) AS id2, MIN(dist) AS dist FROM pairs WHERE dist <= 0.005 GROUP BY id1)"""

RADIUS = 0.005


def catalogue(t):
    k = c("c_custkey")
    return t.customer.select(k.alias("id"), (k * F.lit(137.507764) % 360).alias("ra"),
                             F.degrees(F.asin((k * F.lit(0.618033988) % 1) * 2 - 1)).alias("dec"), "c_acctbal")


def shifted(t):
    move = (c("id") % 7) * F.lit(0.001)
    return catalogue(t).where(c("id") % 3 != 0).select(
        (c("id") + 1_000_000).alias("id"), (c("ra") + move).alias("ra"), (c("dec") + move).alias("dec"))


@query("cone_search", "J10", f"""
WITH {_CAT} SELECT id, ROUND(d, 6) AS dist FROM (SELECT id, c_acctbal, {_DIST.format(r1='ra', d1='dec', r2='137.5::DOUBLE', d2='13.0::DOUBLE')} AS d FROM cat)
WHERE d < 15 AND c_acctbal > 1000""")
def cone_search(t):
    found = sky.cone_search(catalogue(t), "ra", "dec", 137.5, 13.0, 15.0, quality=c("c_acctbal") > 1000)
    return found.select("id", r(c("dist")).alias("dist"))


@query("crossmatch", "J11", f"WITH {_PAIRS} SELECT id1, id2, ROUND(dist, 6) AS dist FROM m")
def crossmatch(t):
    pairs = sky.crossmatch(catalogue(t).drop("c_acctbal"), shifted(t), RADIUS)
    return pairs.select("id1", "id2", r(c("dist")).alias("dist"))


@query("crossmatch_none", "J12", f"WITH {_PAIRS} SELECT id AS id1 FROM cat WHERE id NOT IN (SELECT id1 FROM m)")
def crossmatch_none(t):
    cat = catalogue(t).drop("c_acctbal")
    return sky.unmatched(cat, sky.crossmatch(cat, shifted(t), RADIUS), "id")


@query("find_closest", "J13", f"""
WITH {_CAT} SELECT id, ROUND({_DIST.format(r1='ra', d1='dec', r2='175.3::DOUBLE', d2='(-32.5::DOUBLE)')}, 6) AS dist FROM cat ORDER BY dist, id LIMIT 1""")
def find_closest(t):
    return rounded(sky.find_closest(catalogue(t), "id", "ra", "dec", 175.3, -32.5))


# --- transforms ------------------------------------------------------------

@query("radec_to_xyz", "V1", f"""
WITH {_CAT} SELECT id, ROUND(d * COS(RADIANS(dec)) * COS(RADIANS(ra)), 6) + 0.0 AS x, ROUND(d * COS(RADIANS(dec)) * SIN(RADIANS(ra)), 6) + 0.0 AS y,
 ROUND(d * SIN(RADIANS(dec)), 6) + 0.0 AS z FROM (SELECT *, 10.0::DOUBLE + id % 50 AS d FROM cat)""")
def radec_to_xyz(t):
    xyz = kin.spherical_to_xyz(c("ra"), c("dec"), 10.0 + c("id") % 50)
    return catalogue(t).select("id", *[r(v).alias(n) for n, v in zip("xyz", xyz)])


_P = """p AS (SELECT vec_id, e[1] * 20 AS x, e[2] * 20 AS y, e[3] * 20 AS z, e[4] AS vx, e[5] AS vy, e[6] AS vz, mass,
 SQRT((e[1] * 20)**2 + (e[2] * 20)**2 + (e[3] * 20)**2) AS r FROM
 (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CAST(label + 1 AS DOUBLE) AS mass FROM embeddings)),
q AS (SELECT *, y * vz - z * vy AS hx, z * vx - x * vz AS hy, x * vy - y * vx AS hz, SQRT((y * vz - z * vy)**2 + (z * vx - x * vz)**2 + (x * vy - y * vx)**2) AS h FROM p)"""


def particles(t):
    e = [F.get("embedding", F.lit(k)).cast("double") for k in range(6)]
    return t.embeddings.select("vec_id", (e[0] * 20).alias("x"), (e[1] * 20).alias("y"), (e[2] * 20).alias("z"),
                               e[3].alias("vx"), e[4].alias("vy"), e[5].alias("vz"), (c("label") + 1).cast("double").alias("mass"))


@query("xyz_to_radec", "V2", f"""
WITH {_P} SELECT vec_id, ROUND((DEGREES(ATAN2(y, x)) + 360) % 360, 6) AS ra, ROUND(DEGREES(ASIN(z / r)), 6) + 0.0 AS dec, ROUND(r, 6) AS dist FROM p""")
def xyz_to_radec(t):
    out = kin.xyz_to_spherical(c("x"), c("y"), c("z"))
    return particles(t).select("vec_id", *[r(v).alias(n) for n, v in zip(("ra", "dec", "dist"), out)])


_V = """s AS (SELECT id, RADIANS(ra) AS a, RADIANS(dec) AS d, 0.1::DOUBLE + id % 20 AS kpc, (id % 11 - 5)::DOUBLE AS pa, (id % 13 - 6)::DOUBLE AS pd, (id % 101 - 50)::DOUBLE AS rv FROM cat),
v AS (SELECT *, rv * COS(d) * COS(a) - 4.74047 * kpc * (pa * SIN(a) + pd * SIN(d) * COS(a)) AS vx,
 rv * COS(d) * SIN(a) + 4.74047 * kpc * (pa * COS(a) - pd * SIN(d) * SIN(a)) AS vy, rv * SIN(d) + 4.74047 * kpc * pd * COS(d) AS vz FROM s)"""


def motions(t):
    k = c("id")
    return catalogue(t).select("id", "ra", "dec", (F.lit(0.1) + k % 20).alias("kpc"), (k % 11 - 5).cast("double").alias("pa"),
                               (k % 13 - 6).cast("double").alias("pd"), (k % 101 - 50).cast("double").alias("rv"))


@query("space_velocity", "V3", f"WITH {_CAT}, {_V} SELECT id, ROUND(vx, 6) + 0.0 AS vx, ROUND(vy, 6) + 0.0 AS vy, ROUND(vz, 6) + 0.0 AS vz FROM v")
def space_velocity(t):
    v = kin.space_velocity(c("ra"), c("dec"), c("kpc"), c("pa"), c("pd"), c("rv"))
    return motions(t).select("id", *[r(x).alias(n) for n, x in zip(("vx", "vy", "vz"), v)])


def _galactic_sql():
    frame = kin.GalacticFrame()
    m, o = frame.rotation(), frame.offset()
    cells = []
    for i, n in enumerate("xyz"):
        dot = " + ".join(f"({m[i][j]!r}::DOUBLE) * {{p}}{k}" for j, k in enumerate("xyz")).replace("np.float64(", "(")
        cells.append(f"ROUND({dot.format(p='x')} + ({float(o[i])!r}::DOUBLE), 6) + 0.0 AS g{n}")
        cells.append(f"ROUND({dot.format(p='v')} + ({frame.sun_kms[i]!r}::DOUBLE), 6) + 0.0 AS v{n}")
        cells.append(f"ROUND({dot.format(p='w')} + ({frame.sun_kms[i]!r}::DOUBLE), 6) + 0.0 AS rv_only_{n}")
    return f"""WITH {_CAT}, {_V}, f AS (SELECT *, kpc * COS(d) * COS(a) AS xx, kpc * COS(d) * SIN(a) AS xy, kpc * SIN(d) AS xz,
 COS(d) * COS(a) AS wx, COS(d) * SIN(a) AS wy, SIN(d) AS wz FROM v) SELECT id, {', '.join(cells)} FROM f"""


@query("galactocentric", "V4, V5", _galactic_sql())
def galactocentric(t):
    xyz = kin.spherical_to_xyz(c("ra"), c("dec"), c("kpc"))
    v = kin.space_velocity(c("ra"), c("dec"), c("kpc"), c("pa"), c("pd"), c("rv"))
    # sensitivity run: radial velocity 1, no proper motion
    probe = kin.space_velocity(c("ra"), c("dec"), c("kpc"), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    pos, vel = kin.to_galactocentric(xyz, v)
    only = kin.to_galactocentric(xyz, probe)[1]
    return motions(t).select("id", *[r(x).alias(f"g{n}") for n, x in zip("xyz", pos)], *[r(x).alias(f"v{n}") for n, x in zip("xyz", vel)],
                             *[r(x).alias(f"rv_only_{n}") for n, x in zip("xyz", only)])


# --- cluster kinematics ----------------------------------------------------

@query("dist_centre", "V6", f"WITH {_P} SELECT vec_id, ROUND(r, 6) AS r FROM p")
def dist_centre(t):
    return particles(t).select("vec_id", r(kin.radius()).alias("r"))


@query("angular_velocity", "V7", f"WITH {_P} SELECT vec_id, ROUND(hx / r**2, 6) + 0.0 AS ox, ROUND(hy / r**2, 6) + 0.0 AS oy, ROUND(hz / r**2, 6) + 0.0 AS oz FROM q")
def angular_velocity(t):
    return kin.angular_velocity(particles(t)).select("vec_id", *[r(c(f"omega_{k}")).alias(f"o{k}") for k in "xyz"])


@query("collective_rotation", "V8", f"""
WITH {_P}, s AS (SELECT SUM(mass * hx) lx, SUM(mass * hy) ly, SUM(mass * hz) lz, SUM(mass * r**2) i, SUM(mass * h / r) / SUM(mass) AS tangential FROM q),
o AS (SELECT lx / i AS omega_x, ly / i AS omega_y, lz / i AS omega_z, tangential FROM s)
SELECT ROUND(omega_x, 9) AS omega_x, ROUND(omega_y, 9) AS omega_y, ROUND(omega_z, 9) AS omega_z, ROUND(tangential, 9) AS tangential,
 ROUND(omega_x / SQRT(omega_x**2 + omega_y**2 + omega_z**2), 9) AS axis_x, ROUND(omega_y / SQRT(omega_x**2 + omega_y**2 + omega_z**2), 9) AS axis_y,
 ROUND(omega_z / SQRT(omega_x**2 + omega_y**2 + omega_z**2), 9) AS axis_z FROM o""")
def collective_rotation(t):
    return rounded(kin.collective_rotation(particles(t)), 9)


@query("shell_rotation", "V9", f"""
WITH {_P}, s AS (SELECT CAST(CEIL(r) AS INTEGER) AS shell, AVG(CASE WHEN mass * r**2 > 1e-10 THEN h / r**2 ELSE 0 END) AS mean_omega, AVG(h / r) AS mean_tangential,
 AVG(CASE WHEN mass * h > 1e-10 THEN hx / h END) ux, AVG(CASE WHEN mass * h > 1e-10 THEN hy / h END) uy, AVG(CASE WHEN mass * h > 1e-10 THEN hz / h END) uz,
 SUM(mass) AS total_mass, AVG(mass) AS mean_mass FROM q WHERE r > 0 GROUP BY 1)
SELECT shell, ROUND(mean_omega, 9) AS mean_omega, ROUND(mean_tangential, 9) AS mean_tangential, total_mass, ROUND(mean_mass, 9) AS mean_mass,
 ROUND(ux / SQRT(ux**2 + uy**2 + uz**2), 9) AS axis_x, ROUND(uy / SQRT(ux**2 + uy**2 + uz**2), 9) AS axis_y, ROUND(uz / SQRT(ux**2 + uy**2 + uz**2), 9) AS axis_z FROM s""")
def shell_rotation(t):
    return rounded(kin.shell_rotation(particles(t)), 9)


_R = "rr AS (SELECT UNNEST(range(1, CAST(CEIL(MAX(r)) AS BIGINT) + 1)) AS big FROM p)"
_AXIS = ", ".join(f"ROUND(SUM(w * h{k}) / SQRT(SUM(w * hx)**2 + SUM(w * hy)**2 + SUM(w * hz)**2), 6) + 0.0 AS axis_{k}" for k in "xyz")


@query("cumulative_shells", "W5", f"""
WITH {_P}, {_R} SELECT CAST(big AS DOUBLE) AS radius, COUNT(*) AS n, SUM(mass) AS mass FROM q, rr WHERE r <= big GROUP BY big""")
def cumulative_shells(t):
    m = kin.with_moments(particles(t))
    return kin.cumulative_shells(m, {"n": F.lit(1), "mass": c("w")})


@query("shell_tangential_rms", "V10", f"""
WITH {_P}, {_R}, m AS (SELECT *, mass AS w, vx**2 + vy**2 + vz**2 - (x * vx + y * vy + z * vz)**2 / r**2 AS vt2 FROM q)
SELECT CAST(big AS DOUBLE) AS radius, ROUND(SQRT(SUM(w * vt2) / SUM(w)), 6) AS rms_tangential, {_AXIS}, SUM(w) AS mass, COUNT(*) AS n
FROM m, rr WHERE r <= big GROUP BY big""")
def shell_tangential_rms(t):
    return rounded(kin.shell_tangential_rms(particles(t)))


def _signed_sql(weight):
    return f"""WITH {_P}, {_R}, m AS (SELECT *, {weight} AS w FROM q),
l AS (SELECT SUM(w * hx) lx, SUM(w * hy) ly, SUM(w * hz) lz FROM m),
a AS (SELECT lx / SQRT(lx**2 + ly**2 + lz**2) ax, ly / SQRT(lx**2 + ly**2 + lz**2) ay, lz / SQRT(lx**2 + ly**2 + lz**2) az FROM l),
v AS (SELECT *, vx - (vx * ax + vy * ay + vz * az) * ax tx, vy - (vx * ax + vy * ay + vz * az) * ay ty, vz - (vx * ax + vy * ay + vz * az) * az tz FROM m, a),
s AS (SELECT *, SIGN(tx * (y * az - z * ay) + ty * (z * ax - x * az) + tz * (x * ay - y * ax)) * SQRT(tx**2 + ty**2 + tz**2) AS vt FROM v)
SELECT CAST(big AS DOUBLE) AS radius, ROUND(SUM(w * vt) / SUM(w), 6) + 0.0 AS mean_tangential, {_AXIS}, SUM(w) AS mass, COUNT(*) AS n
FROM s, rr WHERE r <= big GROUP BY big"""


@query("shell_tangential_signed", "V11", _signed_sql("mass"))
def shell_tangential_signed(t):
    return rounded(kin.shell_tangential_signed(particles(t)))


@query("shell_tangential_nomass", "V12", _signed_sql("1.0::DOUBLE"))
def shell_tangential_nomass(t):
    return rounded(kin.shell_tangential_signed(particles(t), weight=None))


@query("shell_axis_svd", "V13")
def shell_axis_svd(t):
    return kin.shell_axis_svd(particles(t))


@query("center_of_mass", "A22", f"""
WITH {_P} SELECT ROUND(SUM(mass * x) / SUM(mass), 6) AS x_com, ROUND(SUM(mass * y) / SUM(mass), 6) AS y_com, ROUND(SUM(mass * z) / SUM(mass), 6) AS z_com FROM p""")
def center_of_mass(t):
    return rounded(kin.centre_of_mass(particles(t)))


@query("mass_function", "A36", """
WITH m AS (SELECT o_totalprice AS m, MIN(o_totalprice) OVER () lo, MAX(o_totalprice) OVER () hi FROM orders WHERE o_totalprice > 0),
b AS (SELECT CAST(LEAST(FLOOR((m - lo) / (hi - lo) * 12), 11) AS INTEGER) AS bin, AVG(m) AS mean_mass, COUNT(*) AS n, MAX(hi - lo) / 12 AS dm FROM m GROUP BY 1),
g AS (SELECT LOG10(mean_mass) lx, LOG10(n / dm) ly FROM b),
f AS (SELECT REGR_SLOPE(ly, lx) AS slope, SQRT((1 - REGR_R2(ly, lx)) * REGR_SYY(ly, lx) / ((COUNT(*) - 2) * REGR_SXX(ly, lx))) AS err FROM g)
SELECT bin, ROUND(mean_mass, 4) AS mean_mass, n, ROUND(dm, 4) AS dm, ROUND(slope, 6) AS slope, ROUND(err, 6) AS slope_err FROM b, f""")
def mass_function(t):
    return rounded(dist.mass_function(t.orders, "o_totalprice", 12), 4, slope=6, slope_err=6)


@query("density_profile", "A37", f"""
WITH {_P} SELECT CAST(FLOOR(r) AS INTEGER) AS shell, SUM(mass) AS mass, COUNT(*) AS n,
 ROUND(SUM(mass) / (4.0::DOUBLE / 3 * PI() * ((FLOOR(r) + 1)**3 - FLOOR(r)**3)), 6) AS density FROM p GROUP BY FLOOR(r)""")
def density_profile(t):
    return rounded(dist.density_profile(particles(t), kin.radius(), c("mass")))


@query("half_mass_radius", "A38", f"""
WITH {_P}, s AS (SELECT r, SUM(mass) OVER (ORDER BY r) AS cum, SUM(mass) OVER () AS total FROM p)
SELECT ROUND(MIN(r) FILTER (cum >= total / 2), 6) AS r_half, ROUND(AVG(r), 6) AS r_mean FROM s""")
def half_mass_radius(t):
    m = particles(t).select(kin.radius().alias("r"), "mass")
    half = ranking.first_reaching(m, "r", "mass", 0.5, "r_half")
    return rounded(half.withColumn("r_mean", m.agg(F.avg("r")).scalar()))
