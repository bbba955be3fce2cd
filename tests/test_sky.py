import numpy as np
import pytest

from lumentab.operators import sky


def distance(ra1, dec1, ra2, dec2):
    ra1, dec1, ra2, dec2 = map(np.radians, (ra1, dec1, ra2, dec2))
    a = np.sin(abs(dec1 - dec2) / 2) ** 2 + np.cos(dec1) * np.cos(dec2) * np.sin(abs(ra1 - ra2) / 2) ** 2
    return np.degrees(2 * np.arcsin(np.sqrt(np.minimum(a, 1))))


def brute(a, b, radius):
    out = {}
    for key, ra, dec in a:
        d = distance(ra, dec, b[:, 1], b[:, 2])
        best = np.lexsort((b[:, 0], d))[0]
        if d[best] <= radius:
            out[int(key)] = int(b[best, 0])
    return out


def points(rng, n, first, kind):
    ra = {"whole": rng.uniform(0, 360, n), "pole": rng.uniform(0, 360, n), "wrap": rng.uniform(-4, 4, n) % 360,
          "crowd": 10 + rng.normal(0, 0.05, n)}[kind]
    dec = {"whole": np.degrees(np.arcsin(rng.uniform(-1, 1, n))), "pole": 90 - rng.uniform(0, 6, n),
           "wrap": rng.uniform(-5, 5, n), "crowd": rng.normal(0, 0.05, n)}[kind]
    return np.column_stack([np.arange(n) + first, ra, dec])


def frame(spark, rows):
    return spark.createDataFrame([(int(i), float(r), float(d)) for i, r, d in rows], "id bigint, ra double, dec double")


# few rows a cell: the index is cut to several levels, also over the pole and the meridian
@pytest.mark.parametrize("kind,radius,cell_rows", [
    ("whole", 5, 4096), ("whole", 100, 4096), ("pole", 2, 4096), ("pole", 0.5, 20), ("wrap", 1, 4096), ("crowd", 1, 50), ("crowd", 1, 3),
    ("pole", 2, 4), ("wrap", 1, 4), ("whole", 100, 8), ("whole", 170, 8)])
def test_crossmatch_equals_brute_force(spark, kind, radius, cell_rows):
    rng = np.random.default_rng(11)
    a, b = points(rng, 200, 0, kind), points(rng, 300, 1000, kind)
    b = np.vstack([b, b[:150] + [5000, 0, 0]])  # copies of positions: the smallest id wins
    got = {r.id1: r.id2 for r in sky.crossmatch(frame(spark, a), frame(spark, b), radius, cell_rows=cell_rows).collect()}
    assert got == brute(a, b, radius)


def test_boundary_rule(spark):
    a, b = frame(spark, [(1, 0.0, 0.0)]), frame(spark, [(2, 0.0, 1.0)])
    d = sky.crossmatch(a, b, 2.0).first().dist
    assert sky.crossmatch(a, b, d, inclusive=True).count() == 1
    assert sky.crossmatch(a, b, d, inclusive=False).count() == 0


def test_unmatched_and_missing_positions(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 0.0), (3, None, 0.0)], "id bigint, ra double, dec double")
    m = sky.crossmatch(a, frame(spark, [(9, 0.001, 0.0)]), 0.01)
    assert [r.id1 for r in sky.unmatched(a, m, "id").orderBy("id1").collect()] == [2, 3]


def test_crossmatch_has_no_product_of_the_catalogues(spark):
    rng = np.random.default_rng(2)
    m = sky.crossmatch(frame(spark, points(rng, 50, 0, "whole")), frame(spark, points(rng, 50, 0, "whole")), 1)
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_cone_search_over_the_meridian_and_the_pole(spark):
    rng = np.random.default_rng(8)
    rows = np.vstack([points(rng, 400, 0, "wrap"), points(rng, 400, 1000, "pole")])
    df = frame(spark, rows)
    for ra0, dec0, radius in [(0.5, 0.0, 2.0), (120.0, 88.0, 4.0)]:
        want = {int(i) for i, r, d in rows if distance(r, d, ra0, dec0) < radius}
        assert {r.id for r in sky.cone_search(df, "ra", "dec", ra0, dec0, radius).collect()} == want


def test_rows_beside_a_crowded_cell_open_few_leaves(spark):
    rng = np.random.default_rng(5)
    crowd = points(rng, 4000, 1000, "crowd")
    # a ring around the crowd, most of its rows in cells beside the crowd's; and rows inside it
    turn = np.linspace(0, 2 * np.pi, 60, endpoint=False)
    ring = np.column_stack([np.arange(60), 10 + 0.6 * np.cos(turn), 0.6 * np.sin(turn)])
    a = np.vstack([ring, points(rng, 60, 100, "crowd")])
    left, right = frame(spark, a).toDF("id1", "ra1", "dec1"), frame(spark, crowd).toDF("id2", "ra2", "dec2")
    sky.ensure_checkpoint_dir(spark)
    indexed, depth = sky._index(right, 1.0, 64)
    assert depth > 1
    leaves = sky._opened(left.select("ra1", "dec1"), sky._tree(indexed, 1.0), 1.0, 1.0, depth)
    compared = sum(r.n for r in leaves.collect())
    assert compared < 0.1 * len(a) * len(crowd)
    got = {r.id1: r.id2 for r in sky.crossmatch(frame(spark, a), frame(spark, crowd), 1.0, cell_rows=64).collect()}
    assert got == brute(a, crowd, 1.0)


def test_copies_of_one_position_end_the_index(spark):
    same = np.column_stack([np.arange(50), np.full(50, 10.0), np.full(50, 5.0)])
    same[25:, 1] += 1e-12  # nearer to each other than any cell is wide
    got = sky.crossmatch(frame(spark, [(1, 10.0, 5.0)]), frame(spark, same), 1.0, cell_rows=1).collect()
    assert [(r.id1, r.id2, r.dist) for r in got] == [(1, 0, 0.0)]


def test_empty_catalogues(spark):
    none, some = frame(spark, []), frame(spark, [(1, 10.0, 5.0)])
    assert sky.crossmatch(none, some, 1.0).count() == 0
    assert sky.crossmatch(some, none, 1.0).count() == 0
