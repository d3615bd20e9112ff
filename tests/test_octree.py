"""Joins over the octree against all pairs, on clouds with outliers, dense balls, copies and bad points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumispan.operators import features, octree, spatial


def uneven(n=400, seed=0):
    """A dense ball far from a sparse cloud, outliers at several scales, copies of two places; bad points come later."""
    rng = np.random.default_rng(seed)
    ball = rng.normal(size=(n, 3)) * 1e-6 + 3.0
    wide = rng.normal(size=(n // 2, 3)) * 10
    far = rng.normal(size=(6, 3)) * 10.0 ** np.arange(2, 8)[:, None]
    grid = np.stack(np.meshgrid(*[np.arange(5.0)] * 3), axis=-1).reshape(-1, 3)  # many ties
    return np.concatenate([ball, wide, far, grid, np.repeat(wide[:1], 40, axis=0), np.repeat(ball[:1], 25, axis=0)])


def frame(spark, x, name, kind="double", start=0):
    rows = [(start + i, *map(float, v)) for i, v in enumerate(x)]
    bad = [(10**9 + start, None, 1.0, 1.0), (10**9 + 1 + start, float("nan"), 1.0, 1.0), (10**9 + 2 + start, float("inf"), 0.0, 0.0)]
    return spark.createDataFrame(rows + bad, f"{name} long, x {kind}, y {kind}, z {kind}").repartition(5)


def distances(a, b):
    d = [a[:, None, c] - b[None, :, c] for c in range(3)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def top(d, k, own=False):
    out = set()
    for i, row in enumerate(d):
        order = [j for j in np.lexsort((np.arange(len(row)), row)) if not (own and i == j)][:k]
        out |= {(i, int(j), float(row[j]), r + 1) for r, j in enumerate(order)}
    return out


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(octree, "LEAF", 24)
    monkeypatch.setattr(octree, "ONE", 24)
    monkeypatch.setattr(octree, "CHUNK", 3)


def test_nearest_of_itself(spark, small):
    x = uneven()
    got = {tuple(r) for r in spatial.knn_join(frame(spark, x, "q"), frame(spark, x, "p"), 5, self_join=True).select("q", "p", "d2", "rank").collect()}
    assert got == top(distances(x, x), 5, own=True)


def test_nearest_of_others(spark, small, k=7):
    x = uneven()
    rng = np.random.default_rng(5)
    q = np.concatenate([x[::9], rng.normal(size=(60, 3)) * 1e5, rng.normal(size=(50, 3)) * 1e-3 + 3, x[:1], x[:1]]).astype(np.float32)
    got = {tuple(r) for r in spatial.knn_join(frame(spark, q, "q", "float"), frame(spark, x, "p"), k).select("q", "p", "d2", "rank").collect()}
    assert got == top(distances(q.astype(float), x), k)


def test_nearest_within(spark, small):
    x = uneven(300)
    d = distances(x, x)
    got = {tuple(r) for r in spatial.range_join(frame(spark, x, "q"), frame(spark, x, "p"), 2e-6, 4).select("q", "p", "d2").collect()}
    assert got == {t[:3] for t in top(d, 4) if t[2] <= 2e-6 * 2e-6}


@pytest.mark.parametrize("radius", [1e-6, 30.0])
def test_within(spark, small, radius):
    x = uneven(200)
    d = distances(x, x)
    got = [tuple(r) for r in spatial.range_join(frame(spark, x, "q"), frame(spark, x, "p"), radius).select("q", "p", "d2").collect()]
    i, j = np.nonzero(d <= radius * radius)
    assert len(got) == len(set(got)) and set(got) == set(zip(i.tolist(), j.tolist(), d[i, j].tolist(), strict=True))


def clusters(x, eps, least):
    near = distances(x, x) <= eps * eps
    core = near.sum(axis=1) >= least
    label = np.where(core, np.arange(len(x)), -1)
    while True:
        low = np.array([label[near[i] & core].min() if core[i] else -1 for i in range(len(x))])
        if (low == label).all():
            break
        label = low
    return {(i, int(label[i]) if core[i] else int(label[near[i] & core].min()) if (near[i] & core).any() else -1, bool(core[i])) for i in range(len(x))}


@pytest.mark.parametrize(("eps", "least"), [(1e-6, 5), (4.0, 9)])
def test_density_clusters(spark, small, eps, least):
    x = uneven(250, 3)
    points = frame(spark, x, "point_id")
    got = {tuple(r) for r in features.dbscan(points, eps, least).collect()}
    assert {g for g in got if g[0] < 10**9} == clusters(x, eps, least)
    assert {g for g in got if g[0] >= 10**9} == {(10**9 + i, -1, False) for i in range(3)}


def test_pairs_follow_the_points(spark, small):
    """One far outlier and a dense ball: leaves meet a bounded number of others, and no leaf is over-full."""
    rng = np.random.default_rng(2)
    sizes = {}
    for n in (500, 2000):
        x = np.concatenate([rng.normal(size=(n, 3)) * 1e-4, [[1e9, 1e9, 1e9]]])
        cube, places, _, leafed, _ = octree._sides(*[frame(spark, x, "q").withColumn("p", F.col("q"))] * 2, "q", "p")
        leaves = octree.packed(octree.with_leaf(places, n + 1)).cache()
        assert leaves.agg(F.max("n")).first()[0] <= 24
        sizes[n] = octree._bounded(leaves, leaves, cube, 5, None).count()
        leaves.unpersist()
    assert sizes[2000] < 6 * sizes[500] and sizes[2000] * 24 < 2000 * 200


def test_few_points(spark):
    """Without smaller limits these go to every task whole."""
    x = uneven(100, 7)
    d = distances(x, x)
    points = frame(spark, x, "point_id")
    q, p = points.withColumnRenamed("point_id", "q"), points.withColumnRenamed("point_id", "p")
    assert {tuple(r) for r in spatial.knn_join(q, p, 6, self_join=True).select("q", "p", "d2", "rank").collect()} == top(d, 6, own=True)
    assert {tuple(r) for r in spatial.range_join(q, p, 2.0, 3).select("q", "p", "d2").collect()} == {t[:3] for t in top(d, 3) if t[2] <= 4.0}
    assert spatial.range_join(q, p, 2.0).count() == (d <= 4.0).sum()
    assert {tuple(r) for r in features.dbscan(points, 4.0, 9).where(F.col("point_id") < 10**9).collect()} == clusters(x, 4.0, 9)


def test_empty_and_tiny(spark):
    none, one = frame(spark, [], "q"), frame(spark, [[1.0, 2.0, 3.0]], "q")
    p = lambda d: d.withColumnRenamed("q", "p")
    assert spatial.knn_join(none, p(one), 2).count() == spatial.knn_join(one, p(none), 2).count() == spatial.knn_join(one, p(one), 0).count() == 0
    assert [tuple(r) for r in spatial.knn_join(one, p(one), 3).select("q", "p", "d2", "rank").collect()] == [(0, 0, 0.0, 1)]
    assert spatial.knn_join(one, p(one), 3, self_join=True).count() == 0
    assert spatial.range_join(none, p(one), 1.0).count() == 0 and spatial.range_join(one, p(one), -1.0).count() == 0
    assert [tuple(r)[1:] for r in features.dbscan(one.withColumnRenamed("q", "point_id"), 1.0).collect()] == [(-1, False)] * 4


@pytest.mark.parametrize("radius", [0.5, 0.02])
def test_dense_cells_count_as_one_place(spark, monkeypatch, radius):
    """Dense balls, some near enough to touch, a thin line, copies and noise: as distances between all pairs say, by few of them."""
    rng = np.random.default_rng(13)
    x = np.concatenate([rng.normal(size=(150, 3)) * 0.1, rng.normal(size=(80, 3)) * 0.05 + [0.7, 0, 0], rng.normal(size=(60, 3)) * 0.05 + [3, 3, 3], np.stack([np.linspace(-2, 2, 30), np.ones(30), np.zeros(30)], axis=1), np.repeat([[5.0, 5.0, 5.0], [5.01, 5.0, 5.0]], 3, axis=0), rng.uniform(-4, 4, (20, 3))])
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= radius * radius
    core = d.sum(axis=1) >= 5
    label = np.where(core, np.arange(len(x)), len(x))
    for _ in x:
        label = np.where(core, np.where(d & core[None], label[None], len(x)).min(axis=1), label)
    label = np.where(core, label, np.where(d & core[None], label[None], len(x)).min(axis=1))
    want = {i: (-1 if l == len(x) else int(l), bool(c)) for i, (l, c) in enumerate(zip(label, core, strict=True))}
    monkeypatch.setattr(octree, "ONE", 10)
    monkeypatch.setattr(octree, "LEAF", 16)
    asked = []
    pairs = octree.leaf_pairs
    monkeypatch.setattr(octree, "leaf_pairs", lambda a, b, c, r: asked.append(a) or pairs(a, b, c, r))
    cloud = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "point_id long, x double, y double, z double")
    assert {r.point_id: (r.label, r.core) for r in octree.density_clusters(cloud, radius, 5).collect()} == want
    counted = sum(r.n for r in asked[0].select("n").collect())
    assert counted < (150 if radius == 0.5 else 400)


def test_pairs_in_reach_pass_no_join_even_of_copies(spark):
    rng = np.random.default_rng(12)
    x = np.vstack([rng.normal(0, 1, (4500, 3)), np.zeros((300, 3))])
    found = spatial.range_join(frame(spark, x, "q"), frame(spark, x, "p"), 0.3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan.split("MapInArrow")[0]
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert {(r.q, r.p) for r in found.select("q", "p").collect()} == set(zip(*np.nonzero(d <= 0.3 * 0.3), strict=True))


def test_points_are_sent_for_groups_and_not_for_each_leaf_in_reach(spark, monkeypatch):
    rng = np.random.default_rng(14)
    x, y = np.vstack([rng.uniform(0, 1, (1500, 3)), np.full((150, 3), 0.5)]), rng.uniform(0, 1, (700, 3))
    for name, value in (("ONE", 10), ("LEAF", 16), ("WIDE", 16), ("GROUP", 400), ("SHARE", 10**5)):
        monkeypatch.setattr(octree, name, value)
    seen, send = [], octree.sent

    def spy(pairs, mine, theirs):
        n = lambda d, s: d.groupBy(F.col("leaf").alias(s + "leaf")).agg(F.sum(F.size("pos")).alias(s + "n"), F.count("*").alias(s + "rows"))
        for d in (mine, theirs):
            held = d.groupBy("group").agg(F.sum(F.size("pos")).alias("n"))
            assert held.agg(F.max("n")).first()[0] <= 400 + 60 and held.count() >= 4
        each = pairs.join(n(mine, "q"), "qleaf").join(n(theirs, "p"), "pleaf").agg(F.sum(F.col("qn") * F.col("prows") + F.col("pn") * F.col("qrows"))).first()[0]
        out = send(pairs, mine, theirs)
        seen.append((each, out.agg(F.sum(F.size("pos"))).first()[0]))
        return out

    monkeypatch.setattr(octree, "sent", spy)
    for a, b in ((x, x), (y, x)):
        found = spatial.range_join(frame(spark, a, "q"), frame(spark, b, "p"), 0.3)
        got = [(r.q, r.p) for r in found.select("q", "p").collect()]
        d = ((a[:, None] - b[None]) ** 2).sum(axis=2)
        assert len(got) == len(set(got)) and set(got) == set(zip(*np.nonzero(d <= 0.3 * 0.3), strict=True))
    assert len(seen) == 2 and all(now < each / 4 for each, now in seen), seen


def test_leaves_may_be_wide_from_a_level_down(spark):
    placed = spark.range(5000).select(F.lpad(F.conv((F.col("id") * 7919).cast("string"), 10, 8), octree.DEPTH, "0").alias("code"))
    assert octree.with_leaf(placed, 5000, level=0).groupBy("leaf").count().count() < octree.with_leaf(placed, 5000).groupBy("leaf").count().count()


@pytest.mark.parametrize(("radius", "most"), [(0.05, 100), (0.0, 0)])
def test_thin_clusters_take_few_leaves(spark, monkeypatch, radius, most):
    """Lines and copies without full cells: leaves are as wide as their number of positions lets them; at radius 0 there are none."""
    x = np.concatenate([np.stack([np.full(200, i), np.arange(200) * 0.04, np.zeros(200)], axis=1) for i in range(3)] + [np.repeat([[0.0, 9.0, 9.0]], 6, axis=0), np.repeat([[0.0, 9.5, 9.0]], 4, axis=0)])
    monkeypatch.setattr(octree, "ONE", 10)
    monkeypatch.setattr(octree, "LEAF", 32)
    asked = []
    pairs = octree.leaf_pairs
    monkeypatch.setattr(octree, "leaf_pairs", lambda a, b, c, r: asked.append(a) or pairs(a, b, c, r))
    points = frame(spark, x, "point_id")
    got = {tuple(r) for r in features.dbscan(points, radius, 3 if radius else 5).collect()}
    assert {g for g in got if g[0] < 10**9} == clusters(x, radius, 3 if radius else 5)
    assert {g for g in got if g[0] >= 10**9} == {(10**9 + i, -1, False) for i in range(3)}
    assert sum(a.count() for a in asked[:1]) <= most and (radius > 0) == bool(asked)
