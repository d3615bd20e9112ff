"""Queries on clouds, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumispan.functions import derived as D
from lumispan.functions.vectors import about, affine, euler, finite, inside_polygon, pack_rgb, rotation, unpack_rgb, view_projection, xyz
from lumispan.operators import clouds as C
from lumispan.operators import spatial as S

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 4, *names: str) -> DataFrame:
    """Doubles to so many places, as sums over partitions differ in their last bits."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c, t in df.dtypes if t in ("float", "double") and (not names or c in names)})


EYE, YAW, PITCH = (150.0, 40.0, 400.0), 10.0, -5.0
CAMERA = view_projection(EYE, YAW, PITCH, 4 / 3)
POLYGON = [(250.0, 120.0), (560.0, 160.0), (500.0, 420.0), (380.0, 260.0), (240.0, 400.0)]
MOVE = euler(10.0, -5.0, 2.5, 30.0, 20.0, 10.0, (1.0, 2.0, 3.0))


def _row(matrix: np.ndarray, i: int, p: str = "") -> str:
    v = [repr(float(x)) + "::DOUBLE" for x in matrix[i]]
    return f"({v[0]} * CAST({p}x AS DOUBLE) + {v[1]} * CAST({p}y AS DOUBLE) + {v[2]} * CAST({p}z AS DOUBLE) + {v[3]})"


def _camera() -> list[str]:
    """px, py, pz and w of a point in SQL, from the camera's eye, yaw and pitch: y is up, yaw 0 looks along -z."""
    x, y, z = (f"(CAST({c} AS DOUBLE) - ({e}::DOUBLE))" for c, e in zip("xyz", EYE, strict=True))
    sy, cy, sp, cp = (f"{f}(radians({a}::DOUBLE))" for a in (YAW, PITCH) for f in ("sin", "cos"))
    w = f"({cp} * {sy} * {x} + {sp} * {y} - {cp} * {cy} * {z})"
    lens = "(1 / tan(radians(30.0::DOUBLE)))"  # 60 degrees up and down; near and far are 0.1 and 10000
    return [f"({lens} * 3 / 4 * ({cy} * {x} + {sy} * {z}))", f"({lens} * ({cp} * {y} - {sy} * {sp} * {x} + {cy} * {sp} * {z}))", f"((10000.1::DOUBLE * {w} - 2000.0::DOUBLE) / 9999.9::DOUBLE)", w]


PX, PY, PZ, PW = _camera()
SCREEN = f"(SELECT *, (px / w + 1) / 2 * 800.0::DOUBLE AS sx, (1 - py / w) / 2 * 600.0::DOUBLE AS sy, pz / w AS depth FROM (SELECT *, {PX} AS px, {PY} AS py, {PZ} AS pz, {PW} AS w FROM {D.CLOUD_ORD} WHERE alive) WHERE w > 0)"


def _screen(s, d):
    return C.project(D.cloud_ord(s, d), CAMERA, 800, 600)


def _polygon_sql() -> str:
    out = "false"
    for (xi, yi), (xj, yj) in zip(POLYGON, [POLYGON[-1], *POLYGON[:-1]], strict=True):
        out = f"({out} <> (({yi}::DOUBLE > sy) <> ({yj}::DOUBLE > sy) AND sx < {xj - xi}::DOUBLE * (sy - {yi}::DOUBLE) / {yj - yi}::DOUBLE + {xi}::DOUBLE))"
    return out


@query("cloud_stats", f"SELECT count(*) AS total, count(*) FILTER (alive) AS alive, count(*) FILTER (alive AND selected) AS selected FROM {D.CLOUD_ORD}")
def cloud_stats(s, d):
    return C.counts(D.cloud_ord(s, d))


@query("extent_bbox", f"SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS extent FROM {D.CLOUD_LI}")
def extent_bbox(s, d):
    return S.bbox(D.cloud_li(s, d)).withColumn("extent", F.greatest(*[F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"]))


@query("centroid", f"SELECT round(avg(CAST(x AS DOUBLE)), 4) AS x, round(avg(CAST(y AS DOUBLE)), 4) AS y, round(avg(CAST(z AS DOUBLE)), 4) AS z FROM {D.CLOUD_ORD} WHERE alive")
def centroid(s, d):
    return rounded(D.cloud_ord(s, d).where("alive").agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in "xyz"]))


def _voxel_sql(source: str, size: float, colors: bool, shift: float = 0.0) -> str:
    low = f" - CAST({size * shift} AS FLOAT)" if shift else ""
    key = ", ".join(f"CAST(floor(CAST(CAST(x.{c} - (m.{c}{low}) AS DOUBLE) / {size}::DOUBLE AS FLOAT)) AS BIGINT) AS k{c}" for c in "xyz")
    tail = ", ".join(f"round(least(1.0, greatest(0.0, avg(CAST({c} AS DOUBLE)))), 4) AS {c}" for c in "rgba") if colors else ""
    return f"WITH c AS {source}, m AS (SELECT min(x) AS x, min(y) AS y, min(z) AS z FROM c), v AS (SELECT x.*, {key} FROM c x, m) SELECT kx, ky, kz, count(*) AS n, round(avg(CAST(x AS DOUBLE)), 4) AS x, round(avg(CAST(y AS DOUBLE)), 4) AS y, round(avg(CAST(z AS DOUBLE)), 4) AS z{', ' + tail if tail else ''} FROM v GROUP BY kx, ky, kz"


@query("voxel_downsample", _voxel_sql(D.CLOUD_LI, 4.0, True))
def voxel_downsample(s, d):
    return rounded(S.voxel_downsample(D.cloud_li(s, d), 4.0))


@query("voxel_centroids", _voxel_sql(f"(SELECT * FROM {D.CLOUD_ORD} WHERE alive)", 12.5, False))
def voxel_centroids(s, d):
    return rounded(S.voxel_downsample(D.cloud_ord(s, d).where("alive"), 12.5, colors=False))


@query("mask_counts", f"SELECT alive, selected, count(*) AS n, CAST(sum(CASE WHEN alive THEN 1 ELSE 0 END) AS BIGINT) AS alive_sum FROM {D.CLOUD_ORD} GROUP BY alive, selected")
def mask_counts(s, d):
    return D.cloud_ord(s, d).groupBy("alive", "selected").agg(F.count("*").alias("n"), F.sum(F.col("alive").cast("int")).alias("alive_sum"))


@query("select_add", f"SELECT point_id, selected OR point_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) AS selected FROM {D.CLOUD_ORD}")
def select_add(s, d):
    ids = D.table(s, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("point_id"))
    return C.select_ids(D.cloud_ord(s, d), ids, add=True).select("point_id", "selected")


@query("select_replace", f"SELECT point_id, point_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) AS selected FROM {D.CLOUD_ORD}")
def select_replace(s, d):
    ids = D.table(s, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("point_id"))
    return C.select_ids(D.cloud_ord(s, d), ids).select("point_id", "selected")


@query("invert_selection", f"SELECT point_id, CASE WHEN alive THEN NOT selected ELSE selected END AS selected FROM {D.CLOUD_ORD}")
def invert_selection(s, d):
    return C.invert_selection(D.cloud_ord(s, d)).select("point_id", "selected")


@query("voxel_half_origin", _voxel_sql(D.CLOUD_LI, 4.0, True, 0.5))
def voxel_half_origin(s, d):
    return rounded(S.voxel_downsample(D.cloud_li(s, d), 4.0, shift=0.5))


_LIVING = f"(SELECT * FROM {D.CLOUD_ORD} WHERE alive)"


@query("thinned_cloud", f"WITH c AS {_LIVING}, m AS (SELECT min(x) AS x, min(y) AS y, min(z) AS z, greatest(CAST(max(x) AS DOUBLE) - min(x), CAST(max(y) AS DOUBLE) - min(y), CAST(max(z) AS DOUBLE) - min(z), 1e-9) / 100 AS v FROM c), k AS (SELECT c.*, {', '.join(f'floor(CAST(CAST(c.{a} - m.{a} AS DOUBLE) / m.v AS FLOAT)) AS k{a}' for a in 'xyz')} FROM c, m) SELECT {', '.join(f'round(CAST(CAST(avg(CAST({a} AS DOUBLE)) AS FLOAT) AS DOUBLE), 2) AS {a}' for a in 'xyz')}, true AS alive, false AS selected FROM k GROUP BY kx, ky, kz")
def thinned_cloud(s, d):
    return rounded(S.thinned(D.cloud_ord(s, d)).select("x", "y", "z", "alive", "selected"), 2)


@query("deselect_all", f"SELECT point_id, false AS selected FROM {D.CLOUD_ORD}")
def deselect_all(s, d):
    return C.select_all(D.cloud_ord(s, d), False).select("point_id", "selected")


@query("select_all", f"SELECT point_id, true AS selected FROM {D.CLOUD_PART}")
def select_all(s, d):
    return C.select_all(D.cloud_part(s, d)).select("point_id", "selected")


@query("region_add", f"SELECT point_id, (alive AND x > 150) OR selected AS selected FROM {D.CLOUD_ORD}")
def region_add(s, d):
    return C.select_where(D.cloud_ord(s, d), F.col("x") > 150, add=True).select("point_id", "selected")


@query("selected_alive", f"SELECT point_id FROM {D.CLOUD_ORD} WHERE alive AND selected")
def selected_alive(s, d):
    return D.cloud_ord(s, d).where("alive AND selected").select("point_id")


@query("finite_filter", "SELECT event_id, value FROM events WHERE isfinite(value / nullif(event_id % 5, 0)) AND value IS NOT NULL")
def finite_filter(s, d):
    return D.table(s, d, "events").withColumn("v", F.when(F.col("event_id") % 5 == 0, float("nan")).otherwise(F.col("value") / (F.col("event_id") % 5))).where(finite(F.col("v"))).select("event_id", "value")


@query("screen_project", f"SELECT point_id, round(sx, 4) AS sx, round(sy, 4) AS sy, round(depth, 6) AS depth FROM {SCREEN}")
def screen_project(s, d):
    return rounded(rounded(_screen(s, d).select("point_id", "sx", "sy", "depth"), 4, "sx", "sy"), 6, "depth")


@query("box_select", f"SELECT point_id FROM {SCREEN} WHERE sx BETWEEN 200.0::DOUBLE AND 420.5::DOUBLE AND sy BETWEEN 150.0::DOUBLE AND 390.25::DOUBLE")
def box_select(s, d):
    return _screen(s, d).where(C.in_box(420.5, 150.0, 200.0, 390.25)).select("point_id")


@query("lasso_select", f"SELECT point_id FROM {SCREEN} WHERE {_polygon_sql()}")
def lasso_select(s, d):
    return _screen(s, d).where(inside_polygon(F.col("sx"), F.col("sy"), POLYGON)).select("point_id")


_COVER = f"(SELECT s.point_id, s.depth, floor(s.sx) + i.i AS px, floor(s.sy) + j.i AS py FROM {SCREEN} s, (SELECT unnest([-2, -1, 0, 1]) AS i) i, (SELECT unnest([-2, -1, 0, 1]) AS i) j)"


@query("pick_click", f"SELECT point_id FROM {_COVER} WHERE px = 400 AND py = 300 ORDER BY depth, point_id LIMIT 1")
def pick_click(s, d):
    return C.pick(_screen(s, d), 400, 300)


@query("id_buffer", f"SELECT CAST(px AS BIGINT) AS px, CAST(py AS BIGINT) AS py, arg_min(point_id, (depth, point_id)) AS point_id FROM {_COVER} WHERE px BETWEEN 0 AND 799 AND py BETWEEN 0 AND 599 GROUP BY px, py")
def id_buffer(s, d):
    return C.id_buffer(_screen(s, d), 800, 600)


@query("region_pick", f"SELECT DISTINCT point_id FROM (SELECT px, py, arg_min(point_id, (depth, point_id)) AS point_id FROM {_COVER} WHERE px BETWEEN 0 AND 799 AND py BETWEEN 0 AND 599 GROUP BY px, py) WHERE px BETWEEN 300 AND 450 AND py BETWEEN 200 AND 380")
def region_pick(s, d):
    return C.id_buffer(_screen(s, d), 800, 600).where("px BETWEEN 300 AND 450 AND py BETWEEN 200 AND 380").select("point_id").distinct()


_HIT = f"(SELECT point_id FROM {_COVER} WHERE px = 400 AND py = 300 ORDER BY depth, point_id LIMIT 1)"
_CLICKED = f"(SELECT c.point_id, c.selected, c.alive AND c.point_id IS NOT DISTINCT FROM (SELECT point_id FROM {_HIT}) AS hit FROM {D.CLOUD_ORD} c)"


@query("click_select", f"SELECT point_id, hit AS selected FROM {_CLICKED}")
def click_select(s, d):
    return C.click_select(D.cloud_ord(s, d), C.pick(_screen(s, d), 400, 300)).select("point_id", "selected")


@query("click_toggle", f"SELECT point_id, CASE WHEN hit THEN NOT selected ELSE selected END AS selected FROM {_CLICKED}")
def click_toggle(s, d):
    return C.click_select(D.cloud_ord(s, d), C.pick(_screen(s, d), 400, 300), add=True).select("point_id", "selected")


@query("node_click", f"SELECT point_id, CASE WHEN point_id IS NOT DISTINCT FROM (SELECT point_id FROM (SELECT point_id, (sx - 400.0::DOUBLE) * (sx - 400.0::DOUBLE) + (sy - 300.0::DOUBLE) * (sy - 300.0::DOUBLE) AS d2 FROM {SCREEN} ORDER BY d2, point_id LIMIT 1) WHERE d2 <= 225) THEN NOT selected ELSE selected END AS selected FROM {D.CLOUD_ORD}")
def node_click(s, d):
    return C.click_select(D.cloud_ord(s, d).drop("alive"), C.pick_near(_screen(s, d), 400.0, 300.0), add=True).select("point_id", "selected")


_ANCHORS = f"(SELECT point_id, CASE WHEN w > 0 THEN (px / w + 1) / 2 * 800.0::DOUBLE ELSE -1000 END AS sx, CASE WHEN w > 0 THEN (1 - py / w) / 2 * 600.0::DOUBLE ELSE -1000 END AS sy FROM (SELECT *, {PX} AS px, {PY} AS py, {PW} AS w FROM {D.CLOUD_PART}))"


@query("anchor_hit", f"WITH a AS {_ANCHORS}, m AS (SELECT avg(sx) AS x, avg(sy) AS y FROM (SELECT sx, sy FROM a WHERE sx <> -1000 ORDER BY point_id LIMIT 1)) SELECT kind, point_id FROM (SELECT CASE WHEN point_id % 2 = 0 THEN 'primary' ELSE 'secondary' END AS kind, point_id, (sx - m.x - 2) * (sx - m.x - 2) + (sy - m.y) * (sy - m.y) AS d2 FROM a, m) WHERE d2 < 225 ORDER BY d2, kind, point_id LIMIT 1")
def anchor_hit(s, d):
    at = C.project_anchors(D.cloud_part(s, d), CAMERA, 800, 600)
    near = at.where("sx != -1000").orderBy("point_id").first()
    x, y = (near.sx + 2, near.sy) if near else (0.0, 0.0)
    return C.hit_anchor(at.where("point_id % 2 = 0"), at.where("point_id % 2 = 1"), x, y)


@query("node_pick", f"SELECT point_id, round(d2, 4) AS d2 FROM (SELECT point_id, (sx - 400.0::DOUBLE) * (sx - 400.0::DOUBLE) + (sy - 300.0::DOUBLE) * (sy - 300.0::DOUBLE) AS d2 FROM {SCREEN} ORDER BY d2, point_id LIMIT 1) WHERE d2 <= 225")
def node_pick(s, d):
    return rounded(C.pick_near(_screen(s, d), 400.0, 300.0).select("point_id", "d2"))


@query("anchor_project", f"SELECT point_id, round(CASE WHEN w > 0 THEN (px / w + 1) / 2 * 800.0::DOUBLE ELSE -1000 END, 4) AS sx, round(CASE WHEN w > 0 THEN (1 - py / w) / 2 * 600.0::DOUBLE ELSE -1000 END, 4) AS sy FROM (SELECT *, {PX} AS px, {PY} AS py, {PW} AS w FROM {D.CLOUD_PART})")
def anchor_project(s, d):
    return rounded(C.project_anchors(D.cloud_part(s, d), CAMERA, 800, 600).select("point_id", "sx", "sy"))


@query("affine_apply", f"SELECT point_id, round({_row(MOVE, 0)}, 4) AS x, round({_row(MOVE, 1)}, 4) AS y, round({_row(MOVE, 2)}, 4) AS z FROM {D.CLOUD_ORD}")
def affine_apply(s, d):
    x, y, z = affine(MOVE[:3], xyz())
    return rounded(D.cloud_ord(s, d).select("point_id", x.alias("x"), y.alias("y"), z.alias("z")))


@query("euler_rotate", "SELECT point_id, round(cos(a) * cos(b) * x + (cos(a) * sin(b) * sin(c) - sin(a) * cos(c)) * y + (cos(a) * sin(b) * cos(c) + sin(a) * sin(c)) * z + 1, 4) AS x, round(sin(a) * cos(b) * x + (sin(a) * sin(b) * sin(c) + cos(a) * cos(c)) * y + (sin(a) * sin(b) * cos(c) - cos(a) * sin(c)) * z + 2, 4) AS y, round(-sin(b) * x + cos(b) * sin(c) * y + cos(b) * cos(c) * z + 3, 4) AS z FROM (SELECT point_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, radians(40) AS a, radians(25) AS b, radians(-15) AS c FROM " + D.CLOUD_EMB + ")")
def euler_rotate(s, d):
    x, y, z = affine(euler(1, 2, 3, 40, 25, -15)[:3], xyz())
    return rounded(D.cloud_emb(s, d).select("point_id", x.alias("x"), y.alias("y"), z.alias("z")))


@query("axis_rotation", f"SELECT point_id, CAST(x AS DOUBLE) AS x, round(1 + cos(radians(90)) * (y - 1) - sin(radians(90)) * (z - 2), 4) AS y, round(2 + sin(radians(90)) * (y - 1) + cos(radians(90)) * (z - 2), 4) AS z FROM (SELECT point_id, round(CAST(x AS DOUBLE), 4) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM {D.CLOUD_EMB})")
def axis_rotation(s, d):
    x, y, z = affine(about(rotation("x", 90), (0.0, 1.0, 2.0))[:3], xyz())
    return rounded(D.cloud_emb(s, d).select("point_id", x.alias("x"), y.alias("y"), z.alias("z")))


@query("manual_transform", f"WITH c AS (SELECT point_id, alive, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM {D.CLOUD_PART}), p AS (SELECT avg(x) AS px, avg(y) AS py, avg(z) AS pz FROM c WHERE alive) SELECT point_id, round(px + cos(radians(30)) * (x - px) - sin(radians(30)) * (y - py) + 5, 4) AS x, round(py + sin(radians(30)) * (x - px) + cos(radians(30)) * (y - py), 4) AS y, round(z, 4) AS z FROM c, p")
def manual_transform(s, d):
    from lumispan.operators.register import centroid

    points = D.cloud_part(s, d)
    x, y, z = affine(euler(5, 0, 0, 30, 0, 0, centroid(points.where("alive")))[:3], xyz())
    return rounded(points.select("point_id", x.alias("x"), y.alias("y"), z.alias("z")))


@query("merge_clouds", f"SELECT 0 AS cloud_no, point_id, round(CAST(x AS DOUBLE), 3) AS x, round(CAST(y AS DOUBLE), 3) AS y, round(CAST(z AS DOUBLE), 3) AS z FROM {D.CLOUD_ORD} WHERE alive UNION ALL SELECT 1, point_id, round(CAST(CAST({_row(MOVE, 0)} AS FLOAT) AS DOUBLE), 3), round(CAST(CAST({_row(MOVE, 1)} AS FLOAT) AS DOUBLE), 3), round(CAST(CAST({_row(MOVE, 2)} AS FLOAT) AS DOUBLE), 3) FROM {D.CLOUD_EMB} WHERE alive")
def merge_clouds(s, d):
    return rounded(C.merge(D.cloud_ord(s, d), D.cloud_emb(s, d), MOVE).select("cloud_no", "point_id", "x", "y", "z"), 3)


@query("recolor", f"SELECT point_id, CASE WHEN alive AND selected THEN CAST(0.25 AS FLOAT) ELSE r END AS r, CASE WHEN alive AND selected THEN CAST(0.5 AS FLOAT) ELSE g END AS g, CASE WHEN alive AND selected THEN CAST(0.75 AS FLOAT) ELSE b END AS b FROM {D.CLOUD_ORD}")
def recolor(s, d):
    return C.recolor(D.cloud_ord(s, d), F.col("alive") & F.col("selected"), (0.25, 0.5, 0.75, 1.0)).select("point_id", "r", "g", "b")


@query("soft_delete", f"SELECT point_id, alive AND point_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AS alive, selected AND point_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AS selected FROM {D.CLOUD_ORD}")
def soft_delete(s, d):
    ids = D.table(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("point_id"))
    return C.delete_ids(D.cloud_ord(s, d), ids).select("point_id", "alive", "selected")


@query("rgb_pack", f"SELECT point_id, CAST(trunc(CAST(r AS DOUBLE) * 255) AS INT) * 65536 + CAST(trunc(CAST(g AS DOUBLE) * 255) AS INT) * 256 + CAST(trunc(CAST(b AS DOUBLE) * 255) AS INT) AS rgb FROM {D.CLOUD_ORD} WHERE alive")
def rgb_pack(s, d):
    return D.cloud_ord(s, d).where("alive").select("point_id", pack_rgb(F.col("r"), F.col("g"), F.col("b")).alias("rgb"))


@query("rgb_unpack", "SELECT o_orderkey AS point_id, ((o_orderkey * 7919 % 16777216) >> 16 & 255) / 255.0::DOUBLE AS r, ((o_orderkey * 7919 % 16777216) >> 8 & 255) / 255.0::DOUBLE AS g, ((o_orderkey * 7919 % 16777216) & 255) / 255.0::DOUBLE AS b FROM orders")
def rgb_unpack(s, d):
    packed = (F.col("o_orderkey") * 7919 % 16777216).cast("int")
    r, g, b, _ = unpack_rgb(packed)
    return D.table(s, d, "orders").select(F.col("o_orderkey").alias("point_id"), r.alias("r"), g.alias("g"), b.alias("b"))


@query("color_scale", "SELECT p_partkey AS point_id, (p_partkey % 256) / (CASE WHEN m > 1 THEN 255.0::DOUBLE ELSE 1 END) AS r, (p_size % 256) / (CASE WHEN m > 1 THEN 255.0::DOUBLE ELSE 1 END) AS g FROM part, (SELECT max(p_partkey % 256) AS m FROM part)")
def color_scale(s, d):
    raw = D.table(s, d, "part").select(F.col("p_partkey").alias("point_id"), (F.col("p_partkey") % 256).cast("double").alias("r"), (F.col("p_size") % 256).cast("double").alias("g"), F.lit(0.0).alias("b"))
    return C.scaled_colors(raw).select("point_id", "r", "g")


@query("tint", f"SELECT point_id, round(least(1, greatest(0, CAST(r AS DOUBLE) * 0.45::DOUBLE + 0.35::DOUBLE * 0.55::DOUBLE)), 4) AS r, round(least(1, greatest(0, CAST(g AS DOUBLE) * 0.45::DOUBLE + 0.55::DOUBLE * 0.55::DOUBLE)), 4) AS g, round(least(1, greatest(0, CAST(b AS DOUBLE) * 0.45::DOUBLE + 0.75::DOUBLE * 0.55::DOUBLE)), 4) AS b, 0.55::DOUBLE AS a FROM {D.CLOUD_ORD} WHERE alive")
def tint(s, d):
    return rounded(C.tint(D.cloud_ord(s, d)).select("point_id", "r", "g", "b", "a"))


@query("display_colors", f"SELECT point_id, round(CASE WHEN selected THEN 1 ELSE CAST(r AS DOUBLE) END, 4) AS r, round(CASE WHEN selected THEN 0.5 ELSE CAST(g AS DOUBLE) END, 4) AS g, round(CASE WHEN selected THEN 0 ELSE CAST(b AS DOUBLE) END, 4) AS b FROM {D.CLOUD_ORD} WHERE alive")
def display_colors(s, d):
    return rounded(C.display(D.cloud_ord(s, d)).select("point_id", "r", "g", "b"))


@query("default_colors", "SELECT p_partkey AS point_id, CAST(0.7 AS FLOAT) AS r, CAST(1 AS FLOAT) AS a, true AS alive, false AS selected FROM part")
def default_colors(s, d):
    return C.cloud(D.cloud_part(s, d).select("point_id", "x", "y", "z")).select("point_id", "r", "a", "alive", "selected")


@query("pick_codes", f"SELECT point_id, (point_id + 1) >> 16 & 255 AS r, (point_id + 1) >> 8 & 255 AS g, (point_id + 1) & 255 AS b, point_id AS decoded FROM {D.CLOUD_ORD} WHERE point_id < 16777215")
def pick_codes(s, d):
    r, g, b = C.pick_code(F.col("point_id"))
    coded = D.cloud_ord(s, d).where("point_id < 16777215").select("point_id", r.alias("r"), g.alias("g"), b.alias("b"))
    return coded.withColumn("decoded", C.pick_id(F.col("r"), F.col("g"), F.col("b")))


@query("ply_quantize", f"SELECT point_id, CAST(trunc(least(1, greatest(0, CAST(r AS DOUBLE) * 1.5 - 0.2)) * 255) AS INT) AS red FROM {D.CLOUD_ORD} WHERE alive")
def ply_quantize(s, d):
    from lumispan.functions.vectors import clip01

    return D.cloud_ord(s, d).where("alive").select("point_id", (clip01(F.col("r").cast("double") * 1.5 - 0.2) * 255).cast("int").alias("red"))


@query("text_points", "SELECT o_orderkey AS point_id, printf('%.6f', CAST(o_custkey % 50 AS DOUBLE) / 8) AS line FROM orders")
def text_points(s, d):
    return D.table(s, d, "orders").select(F.col("o_orderkey").alias("point_id"), F.format_string("%.6f", (F.col("o_custkey") % 50) / 8.0).alias("line"))
