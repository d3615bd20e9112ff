"""Clouds: point_id, x, y, z, r, g, b, a, alive, selected. Deleting is a mask; every step gives a new DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumispan.functions.vectors import GRAY, SELECTED, TINT, affine, clip01, dist2, finite, screen, xyz


def cloud(df: DataFrame) -> DataFrame:
    """Fill in missing colours (gray; alpha 1 where r, g, b are given) and masks, and drop points that are not finite."""
    if not {"r", "g", "b"} <= set(df.columns):
        df = df.withColumns({c: F.lit(v).cast("float") for c, v in zip("rgba", GRAY, strict=True)})
    for c, v in (("a", F.lit(1.0).cast("float")), ("alive", F.lit(True)), ("selected", F.lit(False))):
        if c not in df.columns:
            df = df.withColumn(c, v)
    return df.where(finite(*xyz()))


def counts(points: DataFrame) -> DataFrame:
    return points.agg(F.count("*").alias("total"), F.count_if("alive").alias("alive"), F.count_if(F.col("alive") & F.col("selected")).alias("selected"))


def select_ids(points: DataFrame, ids: DataFrame, add: bool = False) -> DataFrame:
    """Replace the selection by ``ids`` (point_id), or add them to it."""
    hit = ids.select(F.col("point_id").alias("__hit")).distinct()
    found = points.join(hit, points.point_id == F.col("__hit"), "left")
    chosen = F.col("__hit").isNotNull()
    return found.withColumn("selected", chosen | F.col("selected") if add else chosen).drop("__hit")


def select_where(points: DataFrame, predicate: Column, add: bool = False) -> DataFrame:
    """As :func:`select_ids` for living points by a predicate, without a join."""
    hit = F.col("alive") & F.coalesce(predicate, F.lit(False))
    return points.withColumn("selected", hit | F.col("selected") if add else hit)


def invert_selection(points: DataFrame) -> DataFrame:
    return points.withColumn("selected", F.when(F.col("alive"), ~F.col("selected")).otherwise(F.col("selected")))


def select_all(points: DataFrame, chosen: bool = True) -> DataFrame:
    """All points, or none, selected; for graphs too."""
    return points.withColumn("selected", F.lit(chosen))


def click_select(points: DataFrame, hit: DataFrame, add: bool = False, key: str = "point_id") -> DataFrame:
    """The selection after a click on ``hit`` (``key``; no row, or a point that is not alive, is a miss).

    A hit alone is selected, or toggled with ``add``; a miss clears the selection, or leaves it with ``add``. Works for nodes as
    well, which have no ``alive``.
    """
    living = points.where("alive") if "alive" in points.columns else points
    found = hit.select(F.col(key).alias("__hit")).join(living.select(F.col(key).alias("__hit")), "__hit", "left_semi").limit(1)
    joined = points.join(F.broadcast(found), points[key] == F.col("__hit"), "left")  # one row at most
    on = F.col("__hit").isNotNull()
    return joined.withColumn("selected", F.when(on, ~F.col("selected")).otherwise(F.col("selected")) if add else on).drop("__hit")


def delete_ids(points: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select(F.col("point_id").alias("__hit")).distinct()
    found, gone = points.join(hit, points.point_id == F.col("__hit"), "left"), F.col("__hit").isNotNull()
    return found.withColumn("alive", F.col("alive") & ~gone).withColumn("selected", F.col("selected") & ~gone).drop("__hit")


def recolor(points: DataFrame, where: Column, rgba: Sequence[float]) -> DataFrame:
    return points.withColumns({c: F.when(where, F.lit(float(v)).cast("float")).otherwise(F.col(c)) for c, v in zip("rgba", rgba, strict=True)})


def transform(points: DataFrame, matrix: np.ndarray) -> DataFrame:
    x, y, z = affine(matrix[:3], xyz())
    return points.withColumns({"x": x.cast("float"), "y": y.cast("float"), "z": z.cast("float")})


def merge(primary: DataFrame, secondary: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Living points of both, the second transformed, with fresh masks; ``cloud_no`` and ``point_id`` name a point."""
    both = [d.where("alive").select(F.lit(i).alias("cloud_no"), "point_id", "x", "y", "z", "r", "g", "b", "a") for i, d in enumerate((primary, transform(secondary, matrix)))]
    return both[0].unionByName(both[1]).withColumns({"alive": F.lit(True), "selected": F.lit(False)})


def tint(points: DataFrame) -> DataFrame:
    """Reference look of the living points: colours mixed with a tint, alpha fixed."""
    mixed = {c: clip01(F.col(c).cast("double") * 0.45 + F.lit(t) * 0.55) for c, t in zip("rgb", TINT[:3], strict=True)}
    return points.where("alive").withColumns(mixed | {"a": F.lit(TINT[3])})


def display(points: DataFrame) -> DataFrame:
    """Colours as drawn: the selection colour for selected points; dead points are not drawn."""
    return points.where("alive").withColumns({c: F.when(F.col("selected"), F.lit(v)).otherwise(F.col(c).cast("double")) for c, v in zip("rgba", SELECTED, strict=True)})


def project(points: DataFrame, matrix: np.ndarray, width: int, height: int, living: bool = True) -> DataFrame:
    """sx, sy and depth of the points in front of the camera."""
    sx, sy, depth, w = screen(matrix, xyz(), width, height)
    shown = points.where("alive") if living else points
    return shown.withColumn("w", w).where("w > 0").withColumns({"sx": sx, "sy": sy, "depth": depth})


def project_anchors(points: DataFrame, matrix: np.ndarray, width: int, height: int) -> DataFrame:
    """As :func:`project`, but a point behind the camera goes off the screen instead of away."""
    sx, sy, _, w = screen(matrix, xyz(), width, height)
    return points.withColumn("w", w).withColumns({"sx": F.when(F.col("w") > 0, sx).otherwise(-1000.0), "sy": F.when(F.col("w") > 0, sy).otherwise(-1000.0)})


def in_box(x1: float, y1: float, x2: float, y2: float, drag: float = 3.0) -> Column | None:
    """Inclusive box on the screen; None for a drag that is too short."""
    if abs(x2 - x1) < drag and abs(y2 - y1) < drag:
        return None
    return F.col("sx").between(min(x1, x2), max(x1, x2)) & F.col("sy").between(min(y1, y2), max(y1, y2))


def decimate(vertices: Sequence[tuple[float, float]], least: float = 2.0) -> list[tuple[float, float]]:
    """Lasso vertices that moved more than ``least`` pixels in x or y from the one kept before."""
    out: list[tuple[float, float]] = []
    for v in vertices:
        if not out or abs(v[0] - out[-1][0]) > least or abs(v[1] - out[-1][1]) > least:
            out.append(v)
    return out


def id_buffer(projected: DataFrame, width: int, height: int, size: int = 4) -> DataFrame:
    """(px, py, point_id): the nearest point that covers each pixel, ties to the smallest id."""
    half = size // 2
    px, py = F.floor("sx"), F.floor("sy")
    span = lambda c: F.explode(F.sequence(c - half, c + half - 1))
    spread = projected.where(F.col("sx").between(-size, width + size) & F.col("sy").between(-size, height + size)).select("point_id", "depth", py.alias("cy"), span(px).alias("px")).select("point_id", "depth", "px", span(F.col("cy")).alias("py"))
    return spread.where(F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1)).groupBy("px", "py").agg(F.min(F.struct("depth", "point_id")).alias("m")).select("px", "py", F.col("m.point_id").alias("point_id"))


def pick(projected: DataFrame, x: float, y: float, size: int = 4) -> DataFrame:
    """The nearest point whose square covers a pixel: no row for a miss."""
    half = size // 2
    over = (F.floor("sx") - half <= int(x)) & (int(x) <= F.floor("sx") + half - 1) & (F.floor("sy") - half <= int(y)) & (int(y) <= F.floor("sy") + half - 1)
    return projected.where(over).orderBy("depth", "point_id").limit(1).select("point_id")


def pick_near(projected: DataFrame, x: float, y: float, radius: float = 15.0) -> DataFrame:
    """The projected point next to a place, if it is within ``radius`` pixels."""
    d = dist2([F.col("sx"), F.col("sy")], [F.lit(x), F.lit(y)])
    return projected.withColumn("d2", d).orderBy("d2", "point_id").limit(1).where(F.col("d2") <= radius * radius)


def hit_anchor(primary: DataFrame, secondary: DataFrame, x: float, y: float, radius: float = 15.0) -> DataFrame:
    """(kind, point_id): the projected anchor nearest to a place, if nearer than ``radius``; the primary one of equal ones."""
    d = dist2([F.col("sx"), F.col("sy")], [F.lit(x), F.lit(y)])
    both = primary.select(F.lit("primary").alias("kind"), "point_id", d.alias("d2")).unionByName(secondary.select(F.lit("secondary").alias("kind"), "point_id", d.alias("d2")))
    return both.where(F.col("d2") < radius * radius).orderBy("d2", "kind", "point_id").limit(1).select("kind", "point_id")


def pick_code(point_id: Column) -> list[Column]:
    """id + 1 as three bytes; 0, 0, 0 is the background."""
    n = point_id.cast("long") + 1
    return [F.shiftright(n, 16).bitwiseAND(F.lit(255)), F.shiftright(n, 8).bitwiseAND(F.lit(255)), n.bitwiseAND(F.lit(255))]


def pick_id(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b) - 1


def scaled_colors(points: DataFrame) -> DataFrame:
    """Colours given in 0 to 255, which shows in the largest r of the whole cloud, come down to 0 to 1."""
    top = points.agg(F.max("r").alias("__top"))
    scale = F.when(F.col("__top") > 1, 255.0).otherwise(1.0)
    return points.join(F.broadcast(top)).withColumns({c: F.col(c) / scale for c in "rgb"}).drop("__top")  # one row


def upsert_pair(pairs: DataFrame, p_idx: int, s_idx: int) -> DataFrame:
    """Anchor pairs (p_idx, s_idx) stay one to one: a new pair displaces those that share either end."""
    new = pairs.sparkSession.createDataFrame([(p_idx, s_idx)], "p_idx int, s_idx int")
    return pairs.where((F.col("p_idx") != p_idx) & (F.col("s_idx") != s_idx)).unionByName(new)
