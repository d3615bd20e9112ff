"""Column expressions for points, colours, transforms and projections."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The colours of points without any, of selected ones, and of a second cloud.
GRAY = (0.7, 0.7, 0.7, 1.0)
SELECTED = (1.0, 0.5, 0.0, 1.0)
TINT = (0.35, 0.55, 0.75, 0.55)


def dist2(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Squared distance in double precision."""
    return functools.reduce(lambda p, q: p + q, [(x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")) for x, y in zip(a, b, strict=True)])


def xyz(prefix: str = "") -> list[Column]:
    return [F.col(prefix + c) for c in "xyz"]


def finite(*columns: Column) -> Column:
    """Neither NaN nor infinite; null counts as not finite."""
    return functools.reduce(lambda p, q: p & q, [c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in columns])


def affine(matrix: np.ndarray, point: Sequence[Column]) -> list[Column]:
    """Rows of a 4 x 4 matrix applied to (x, y, z, 1), as many as the matrix has beyond the last one, or all four."""
    p = [c.cast("double") for c in point]
    return [F.lit(float(r[0])) * p[0] + F.lit(float(r[1])) * p[1] + F.lit(float(r[2])) * p[2] + F.lit(float(r[3])) for r in np.asarray(matrix)]


def rotation(axis: str, degrees: float) -> np.ndarray:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    if axis == "x":
        return np.array([[1, 0, 0], [0, c, -s], [0, s, c]])
    if axis == "y":
        return np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]])
    return np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])


def about(linear: np.ndarray, centre: Sequence[float] | None = None, shift: Sequence[float] = (0, 0, 0)) -> np.ndarray:
    """4 x 4 transform that turns about ``centre`` and then shifts."""
    out, at = np.eye(4), np.zeros(3) if centre is None else np.asarray(centre, float)
    out[:3, :3] = linear
    out[:3, 3] = at - linear @ at + np.asarray(shift, float)
    return out


def euler(tx: float, ty: float, tz: float, yaw: float, pitch: float, roll: float, centre: Sequence[float] | None = None) -> np.ndarray:
    """Rz(yaw) Ry(pitch) Rx(roll) about ``centre``, then a translation."""
    return about(rotation("z", yaw) @ rotation("y", pitch) @ rotation("x", roll), centre, (tx, ty, tz))


def view_projection(eye: Sequence[float], yaw: float, pitch: float, aspect: float, fov: float = 60.0, near: float = 0.1, far: float = 10_000.0) -> np.ndarray:
    """Perspective of a camera that looks along its yaw (degrees from -z towards x) and pitch, y up."""
    cy, sy, cp, sp = math.cos(math.radians(yaw)), math.sin(math.radians(yaw)), math.cos(math.radians(pitch)), math.sin(math.radians(pitch))
    ahead = np.array([cp * sy, sp, -cp * cy])
    right = np.cross(ahead, [0.0, 1.0, 0.0])
    size = np.linalg.norm(right)
    right = right / size if size > 1e-6 else np.array([1.0, 0.0, 0.0])
    up = np.cross(right, ahead)
    view = np.eye(4)
    view[:3, :3] = [right, up, -ahead]
    view[:3, 3] = -view[:3, :3] @ np.asarray(eye, float)
    f = 1 / math.tan(math.radians(fov) / 2)
    lens = np.array([[f / aspect, 0, 0, 0], [0, f, 0, 0], [0, 0, (far + near) / (near - far), 2 * far * near / (near - far)], [0, 0, -1, 0]])
    return lens @ view


def screen(matrix: np.ndarray, point: Sequence[Column], width: int, height: int) -> tuple[Column, Column, Column, Column]:
    """Screen x, y, depth and w of a point; only w > 0 is in front of the camera."""
    x, y, z, w = affine(matrix, point)
    return (x / w + 1) / 2 * F.lit(float(width)), (1 - y / w) / 2 * F.lit(float(height)), z / w, w


def inside_polygon(x: Column, y: Column, polygon: Sequence[tuple[float, float]]) -> Column:
    """Even-odd rule over the polygon's edges as one expression; flat edges do not count."""
    out: Column = F.lit(False)
    for (xi, yi), (xj, yj) in zip(polygon, [polygon[-1], *polygon[:-1]], strict=True):
        if abs(yj - yi) < 1e-9:
            continue
        crosses = ((F.lit(yi) > y) != (F.lit(yj) > y)) & (x < F.lit(xj - xi) * (y - F.lit(yi)) / F.lit(yj - yi) + F.lit(xi))
        out = out != crosses
    return out


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    """Truncated, unclipped channels as 0xRRGGBB."""
    i = [(c.cast("double") * 255).cast("int") for c in (r, g, b)]
    return F.shiftleft(i[0], 16).bitwiseOR(F.shiftleft(i[1], 8)).bitwiseOR(i[2])


def unpack_rgb(packed: Column, alpha: bool = False) -> list[Column]:
    """r, g, b and alpha (1 unless packed in bits 24 to 31) in 0 to 1."""
    part = lambda n: F.shiftrightunsigned(packed, n).bitwiseAND(F.lit(255)) / 255.0
    return [part(16), part(8), part(0), part(24) if alpha else F.lit(1.0)]
