import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumispan.functions import vectors as V
from lumispan.operators import clouds as C
from lumispan.operators import spatial as S


def points(spark, rows, extra=""):
    return spark.createDataFrame(rows, "point_id long, x float, y float, z float" + extra)


def masks(spark):
    return points(spark, [(0, 0.0, 0.0, 0.0, True, True), (1, 1.0, 0.0, 0.0, True, False), (2, 2.0, 0.0, 0.0, False, True)], ", alive boolean, selected boolean")


def chosen(df):
    return [r.selected for r in df.orderBy("point_id").collect()]


def test_voxels_start_at_the_smallest_point(spark):
    got = S.voxel_downsample(points(spark, [(0, 0.0, 0.0, 0.0), (1, 0.4, 0.0, 0.0), (2, 1.2, 0.0, 0.0)]), 1.0, colors=False).orderBy("kx").collect()
    assert [(round(r.x, 5), r.n) for r in got] == [(0.2, 2), (1.2, 1)]
    assert S.voxel_downsample(points(spark, [(0, 5.0, 5.0, 5.0), (1, 5.9, 5.0, 5.0)]), 1.0, colors=False).count() == 1
    with pytest.raises(ValueError):
        S.voxel_downsample(points(spark, []), 0, colors=False)
    assert S.voxel_downsample(points(spark, []), 1.0, colors=False).count() == 0


def test_points_that_are_not_finite_go(spark):
    got = C.cloud(points(spark, [(0, 1.0, 1.0, 1.0), (1, math.nan, 0.0, 0.0), (2, math.inf, 0.0, 0.0)])).collect()
    assert len(got) == 1 and abs(got[0].r - 0.7) < 1e-6 and got[0].a == 1 and got[0].alive and not got[0].selected


def test_selection(spark):
    ids = spark.createDataFrame([(1,), (1,)], "point_id long")
    assert chosen(C.invert_selection(masks(spark))) == [False, True, True]
    assert chosen(C.select_ids(masks(spark), ids)) == [False, True, False]
    assert chosen(C.select_ids(masks(spark), ids, add=True)) == [True, True, True]
    assert C.counts(masks(spark)).first()[:] == (3, 2, 1)
    gone = C.delete_ids(masks(spark), spark.createDataFrame([(0,)], "point_id long")).orderBy("point_id").collect()
    assert [(r.alive, r.selected) for r in gone] == [(False, False), (True, False), (False, True)]


def test_polygon_and_box(spark):
    d = spark.createDataFrame([(2.0, 2.0), (5.0, 2.0), (4.0, 4.0)], "sx double, sy double")
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    assert [r[0] for r in d.select(V.inside_polygon(F.col("sx"), F.col("sy"), square)).collect()][:2] == [True, False]
    assert [r[0] for r in d.select(C.in_box(4, 4, 0, 0)).collect()] == [True, False, True]
    assert C.in_box(0, 0, 2, 2) is None
    assert C.decimate([(0, 0), (1, 1), (3, 0), (3, 5)]) == [(0, 0), (3, 0), (3, 5)]


def test_colours(spark):
    d = spark.createDataFrame([(0x00FF8000,)], "c int")
    assert d.select(*V.unpack_rgb(F.col("c"))).first()[:] == (1.0, 128 / 255, 0.0, 1.0)
    assert d.select(V.unpack_rgb(F.lit(-16777216), alpha=True)[3]).first()[0] == 1.0
    assert spark.createDataFrame([(1.0, 0.5, 0.0)], "r double, g double, b double").select(V.pack_rgb(F.col("r"), F.col("g"), F.col("b"))).first()[0] == 0xFF7F00
    t = C.tint(C.cloud(points(spark, [(0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0)], ", r float, g float, b float, a float"))).first()
    assert np.allclose((t.r, t.g, t.b, t.a), (0.6425, 0.7525, 0.8625, 0.55))
    assert spark.range(3).select(C.pick_id(*C.pick_code(F.col("id")))).collect() == [(0,), (1,), (2,)]


def test_transforms():
    assert np.allclose(V.euler(0, 0, 0, 90, 0, 0) @ [1, 0, 0, 1], [0, 1, 0, 1])
    m = V.about(V.rotation("y", 30), (1, 2, 3))
    assert np.allclose(m @ [1, 2, 3, 1], [1, 2, 3, 1])


def test_projection_drops_what_is_behind(spark):
    camera = V.view_projection((0, 0, 0), 0, 0, 1.0)
    d = C.cloud(points(spark, [(0, 0.0, 0.0, -10.0), (1, 0.0, 0.0, 10.0), (2, 1.0, 2.0, -10.0)]))
    got = C.project(d, camera, 100, 100).collect()
    got = {r.point_id: r for r in got}
    assert set(got) == {0, 2} and abs(got[0].sx - 50) < 1e-6 and abs(got[0].sy - 50) < 1e-6
    assert got[2].sx > 50 > got[2].sy  # x goes right and y up
    assert np.allclose(V.view_projection((1, 2, 3), 90, 0, 1.0) @ [9, 2, 3, 1], [0, 0, (10000.1 * 8 - 2000) / 9999.9, 8])  # looks along x
    assert np.isfinite(V.view_projection((0, 0, 0), 0, 90, 1.0)).all()
    assert C.project_anchors(d, camera, 100, 100).orderBy("point_id").collect()[1].sx == -1000


def test_knn_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(120, 3)), rng.normal(size=(3, 3)) * 50]).astype("float32")
    d = points(spark, [(i, *map(float, r)) for i, r in enumerate(x)])
    got = S.knn_join(d.withColumnRenamed("point_id", "q"), d.withColumnRenamed("point_id", "p"), 3, self_join=True).collect()
    near = ((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(2)
    np.fill_diagonal(near, np.inf)
    want = {(i, int(j)) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), near[i]))[:3]}
    assert {(r.q, r.p) for r in got} == want
    pairs = S.range_join(d.withColumnRenamed("point_id", "q"), d.withColumnRenamed("point_id", "p"), 0.5)
    np.fill_diagonal(near, 0)
    assert {(r.q, r.p) for r in pairs.collect()} == {(int(i), int(j)) for i, j in zip(*np.nonzero(near <= 0.25), strict=True)}


def test_anchor_pairs_stay_one_to_one(spark):
    pairs = spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "p_idx int, s_idx int")
    assert {tuple(r) for r in C.upsert_pair(pairs, 1, 4).collect()} == {(5, 6), (1, 4)}
