"""Alignment from several starts at once, warps as a user calls them, clicks."""

import numpy as np
import pytest

from lumispan.functions.vectors import euler
from lumispan.operators import clouds as C
from lumispan.operators import octree
from lumispan.operators import register as R


def frame(spark, x):
    return C.cloud(spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "point_id long, x double, y double, z double").repartition(3))


def angular(n=300, seed=2):
    """A cloud without symmetry: an L of three unequal arms."""
    rng = np.random.default_rng(seed)
    arms = [np.outer(rng.uniform(0, s, n), e) for s, e in ((60, [1, 0, 0]), (30, [0, 1, 0]), (12, [0, 0, 1]))]
    return np.concatenate(arms) + rng.normal(size=(3 * n, 3)) * 0.3


@pytest.mark.parametrize("few", [True, False])
def test_starts_at_once_equal_one_by_one(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(octree, "ONE", 100)
        monkeypatch.setattr(octree, "LEAF", 100)
    x = angular(60 if few else 50)
    y = x @ euler(0, 0, 0, 8, 3, -5)[:3, :3].T + [1.0, -0.5, 0.3]
    a, b = frame(spark, x), frame(spark, y)
    first = [np.eye(4), euler(1, 0, 0, 4, 0, 0), euler(500, 500, 0, 90, 0, 0)]
    steps = 3
    both = R.icp_starts(a, b, first, steps=steps, reach=20.0)
    for m, got in zip(first, both, strict=True):
        want = np.array(m, float)
        for _ in range(steps):
            at = x @ want[:3, :3].T + want[:3, 3]
            d = np.sqrt(((at[:, None] - y[None]) ** 2).sum(2))
            near, j = d.min(axis=1), d.argmin(axis=1)
            ok = near < 20.0
            if ok.sum() < 4:
                break
            s, t = at[ok] - at[ok].mean(axis=0), y[j][ok] - y[j][ok].mean(axis=0)
            u, _, vt = np.linalg.svd(s.T @ t)
            r = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T
            step = np.eye(4)
            step[:3, :3], step[:3, 3] = r, y[j][ok].mean(axis=0) - r @ at[ok].mean(axis=0)
            want = step @ want
        assert np.abs(got["matrix"] - want).max() < 1e-6
    assert both[2]["n"] == 0 and both[2]["mean_distance"] is None
    with pytest.raises(ValueError, match="64"):
        R.icp_starts(a, b, [np.eye(4)] * 65)


def test_a_quarter_turn_comes_back(spark):
    x = angular()
    move = euler(40, -25, 10, 90, 0, 0)
    y = x @ move[:3, :3].T + move[:3, 3]
    found = R.align(frame(spark, x), frame(spark, y), voxel=1.0, start=euler(40, -25, 10, 0, 0, 0), probe=8, steps=30)
    assert np.abs(found["matrix"][:3, :3] - move[:3, :3]).max() < 0.05
    assert np.abs(x @ found["matrix"][:3, :3].T + found["matrix"][:3, 3] - y).max() < 2.0


def test_sweep(spark):
    x = angular(150)
    move = euler(12, 7, -4, 130, 0, 0)
    y = x @ move[:3, :3].T + move[:3, 3]
    found = R.sweep_align(frame(spark, x), frame(spark, y), voxel=1.0, sweep=12, probe=6, steps=30, wide=6.0, narrow=4.0)
    assert np.abs(x @ found["matrix"][:3, :3].T + found["matrix"][:3, 3] - y).max() < 1.5


def test_warps(spark):
    x = angular(60)
    cloud, move = frame(spark, x), euler(3, 0, 0, 20, 0, 0)
    at = x @ move[:3, :3].T + move[:3, 3]
    rows = lambda n, pts: spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "idx int, x double, y double, z double")  # noqa: E731, ARG005
    pairs = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, 3), (4, 4)], "p_idx int, s_idx int")
    pick = [0, 40, 70, 100, 150]
    goal = at[pick] + [[0.5, 0, 0], [0, 0.5, 0], [0, 0, 0.5], [0.2, 0.2, 0], [0, 0, 0]]
    warped = R.anchor_warp(cloud, move, pairs, rows("p", goal), rows("s", x[pick])).orderBy("point_id").select("x", "y", "z").toPandas().to_numpy(float)
    assert np.abs(warped[pick] - goal).max() < 0.05
    still = R.anchor_warp(cloud, move, pairs.limit(0), rows("p", goal), rows("s", x[pick])).orderBy("point_id").select("x", "y", "z").toPandas().to_numpy(float)
    assert np.abs(still - at).max() < 1e-4
    goal = frame(spark, at + 0.4)
    drifted = R.drift_aligned(cloud, goal, move, schedule=[20.0], steps=3, rank=40).orderBy("point_id").select("x", "y", "z").toPandas().to_numpy(float)
    whole = R.coherent_drift(C.transform(cloud, move), goal, schedule=[20.0], steps=3, rank=40)[1].orderBy("point_id").select("x", "y", "z").toPandas().to_numpy(float)
    assert np.allclose(drifted, whole) and np.abs(drifted - at).max() > 0.1


def test_clicks(spark):
    d = spark.createDataFrame([(1, True, True), (2, True, False), (3, False, True)], "point_id long, alive boolean, selected boolean")
    click = lambda hit, add: {r.point_id for r in C.click_select(d, spark.createDataFrame([(h,) for h in hit], "point_id long"), add).where("selected").collect()}
    assert click([2], False) == {2} and click([2], True) == {1, 2, 3} and click([1], True) == {3}
    assert click([], False) == set() and click([], True) == {1, 3}
    assert click([3], False) == set() and click([9], True) == {1, 3}  # dead or unknown: a miss
    at = lambda rows: spark.createDataFrame(rows, "point_id long, sx double, sy double")
    hit = lambda p, s: [tuple(r) for r in C.hit_anchor(at(p), at(s), 10.0, 10.0).collect()]
    assert hit([(1, 10.0, 12.0)], [(2, 12.0, 10.0)]) == [("primary", 1)] and hit([(1, 10.0, 12.0)], [(2, 10.0, 11.0)]) == [("secondary", 2)]
    assert hit([(1, 25.0, 10.0)], []) == [] and hit([(1, 24.9, 10.0)], []) == [("primary", 1)]
