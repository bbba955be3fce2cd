import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumentab.operators import kinematics as kin


@pytest.fixture(scope="module")
def cluster():
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame(rng.normal(0, 2, (500, 6)), columns=["x", "y", "z", "vx", "vy", "vz"])
    pdf["mass"] = rng.uniform(1, 3, 500)
    return pdf


def parts(pdf):
    p, v, m = pdf[["x", "y", "z"]].to_numpy(), pdf[["vx", "vy", "vz"]].to_numpy(), pdf["mass"].to_numpy()
    return p, v, m, np.linalg.norm(p, axis=1), np.cross(p, v)


def test_cumulative_shells_equal_masks(spark, cluster):
    p, v, m, r, h = parts(cluster)
    axis = (m[:, None] * h).sum(0)
    axis /= np.linalg.norm(axis)
    t = v - (v @ axis)[:, None] * axis
    signed = np.sign((t * np.cross(p, axis)).sum(1)) * np.linalg.norm(t, axis=1)
    vt2 = (v**2).sum(1) - (p * v).sum(1) ** 2 / r**2
    df = spark.createDataFrame(cluster)
    rms = kin.shell_tangential_rms(df).toPandas().sort_values("radius")
    sgn = kin.shell_tangential_signed(df).toPandas().sort_values("radius")
    assert sgn["radius"].max() == np.ceil(r.max())
    for (_, a), (_, b) in zip(rms.iterrows(), sgn.iterrows()):
        k = r <= a["radius"]
        assert a["n"] == k.sum()
        assert a["rms_tangential"] == pytest.approx(np.sqrt(np.average(vt2[k], weights=m[k])))
        assert b["mean_tangential"] == pytest.approx(np.average(signed[k], weights=m[k]))


def test_shells_far_apart_cost_their_rows_only(spark):
    rows = [(float(r),) for r in (0.0, 0.5, 1.0, 1.5, 40.2, 1e9)]
    df = spark.createDataFrame(rows, "r double")
    one = {"n": F.lit(1), "s": F.col("r")}
    got = kin.cumulative_shells(df, one, filled=False).orderBy("radius").collect()
    assert [(x.radius, x.n) for x in got] == [(1.0, 3), (2.0, 4), (41.0, 5), (1e9, 6)]
    near = kin.cumulative_shells(df.where("r < 1000"), one).orderBy("radius").collect()
    assert [x.radius for x in near] == [float(i) for i in range(1, 42)]
    assert [x.n for x in near] == [3] + [4] * 39 + [5]
    assert kin.cumulative_shells(df.where("r < 0"), one).collect() == []
    # the way to a far row is made in pieces
    assert kin.cumulative_shells(df.where("r < 1000").union(spark.createDataFrame([(300_000.5,)], "r double")), one).count() == 300_001


def test_running_totals_in_slots(spark):
    from lumentab.operators.windows import running_totals

    rng = np.random.default_rng(3)
    at = np.unique(rng.integers(-10**6, 10**6, 3000))
    v = rng.integers(0, 100, len(at))
    df = spark.createDataFrame(pd.DataFrame({"at": at, "v": v})).repartition(7)
    got = running_totals(df, "at", ["v"], following="next").orderBy("at").toPandas()
    assert got["cum_v"].tolist() == np.cumsum(v).tolist()
    assert got["next"].dropna().tolist() == at[1:].tolist()


def test_prograde_motion_is_positive_on_request(spark):
    ring = pd.DataFrame([(np.cos(a), np.sin(a), 0.0, -np.sin(a), np.cos(a), 0.0, 1.0) for a in np.arange(0, 6, 0.5)],
                        columns=["x", "y", "z", "vx", "vy", "vz", "mass"])
    df = spark.createDataFrame(ring)
    assert kin.shell_tangential_signed(df).toPandas()["mean_tangential"].iloc[-1] == pytest.approx(-1)
    assert kin.shell_tangential_signed(df, sign="prograde").toPandas()["mean_tangential"].iloc[-1] == pytest.approx(1)


def test_svd_axis(spark, cluster):
    _, _, _, r, h = parts(cluster)
    for row in kin.shell_axis_svd(spark.createDataFrame(cluster)).collect():
        want = np.linalg.svd(h[r <= row.radius])[2][0]
        got = np.array([row.axis_x, row.axis_y, row.axis_z])
        assert abs(got @ want) == pytest.approx(1)


def test_rows_at_the_origin_raise_nothing(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0), (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 2.0)],
                               "x double, y double, z double, vx double, vy double, vz double, mass double")
    assert kin.angular_velocity(df).where("omega_z IS NULL").count() == 1
    assert kin.shell_rotation(df).first().total_mass == 2.0
    assert kin.collective_rotation(df).count() == 1


def test_galactic_rotation_is_orthogonal():
    m = kin.GalacticFrame().rotation()
    assert m @ m.T == pytest.approx(np.eye(3))
