"""Local shape: covariance, principal axes, density clusters, contraction, growth, spread samples and point features."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumispan.functions.lineage import cut
from lumispan.functions.quantiles import exact_quantiles
from lumispan.functions.vectors import dist2, xyz
from lumispan.operators import octree
from lumispan.operators.spatial import knn_join, range_join, voxel_downsample


def farthest_points(points: DataFrame, n: int) -> DataFrame:
    """(turn, point_id, x, y, z): start at the smallest id, then ever the point farthest from those taken, ties to the smaller id.

    All points, if there are no more than ``n``. One pass over the points for each turn; the distances stay with the points.
    """
    base = points.select(F.col("point_id").cast("long").alias("point_id"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    if base.limit(n + 1).count() <= n:
        return base.select(F.row_number().over(W.orderBy("point_id")).alias("turn"), "point_id", "x", "y", "z")  # at most n rows
    first = base.agg(F.min(F.struct("point_id", "x", "y", "z")).alias("m")).first().m
    taken = [first]
    now = base
    for turn in range(1, n):
        last = taken[-1]
        d = dist2(xyz(), [F.lit(float(last[c])) for c in "xyz"])
        now = now.withColumn("near", d if turn == 1 else F.least("near", d))
        if turn % 16 == 0:
            now = cut(now)
        taken.append(now.agg(F.max_by(F.struct("point_id", "x", "y", "z"), F.struct("near", -F.col("point_id"))).alias("m")).first().m)
    return points.sparkSession.createDataFrame([(i + 1, r.point_id, r.x, r.y, r.z) for i, r in enumerate(taken)], "turn int, point_id long, x double, y double, z double")


BUCKET = 256
MOST_GROUP = 1_000_000  # points of a cluster that one task spreads, about 100 MB; larger ones take a job a turn


def farthest_rows(x: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``x`` as :func:`farthest_points` takes them, from row 0 on, ties to the smaller row.

    Rows lie in buckets of near ones. A bucket whose box is farther from the new point than all its rows are from those taken
    has nothing to change, so later turns touch few rows.
    """
    if n >= len(x):
        return np.arange(len(x))
    low, wide = x.min(axis=0), max(float(np.ptp(x, axis=0).max()), 1e-300)
    cells = max(1, int(np.ceil((len(x) / BUCKET) ** (1 / 3))))
    at = np.minimum(((x - low) / wide * cells).astype(np.int64), cells - 1)
    order = np.argsort((at[:, 0] * cells + at[:, 1]) * cells + at[:, 2], kind="stable")
    starts = np.arange(0, len(x), BUCKET)
    ends = np.append(starts[1:], len(x))
    y = x[order]
    lo, hi = np.minimum.reduceat(y, starts), np.maximum.reduceat(y, starts)
    near, best, row = np.full(len(x), np.inf), np.full(len(starts), np.inf), np.zeros(len(starts), np.int64)
    taken = [0]
    while len(taken) < n:
        c = x[taken[-1]]
        gap = np.maximum(np.maximum(lo - c, c - hi), 0.0)
        for b in np.flatnonzero((gap * gap).sum(axis=1) < best):
            part = slice(starts[b], ends[b])
            d = y[part] - c
            d = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
            near[part] = np.minimum(near[part], d)
            best[b] = near[part].max()
            row[b] = order[part][near[part] == best[b]].min()
        taken.append(int(row[best == best.max()].min()))
    return np.array(taken)


def spread_picks(points: DataFrame, share: float, k: int, least: int) -> DataFrame:
    """(label, point_id, x, y, z, near): spread points of each cluster (label, point_id, x, y, z), a ``share`` of it, one at least.

    ``near`` are the ``k`` nearest other picks of the cluster, none if it has fewer than ``least``. One grouped plan takes all
    clusters of at most MOST_GROUP points; larger ones, which are counted, come one by one from :func:`farthest_points`.
    """
    schema = "label long, point_id long, x double, y double, z double, near array<long>"
    sizes = cut(points.groupBy("label").agg(F.count("*").alias("n")))

    def pick(t: pa.Table) -> pa.Table:
        t = t.sort_by("point_id")
        x, ids = np.stack([t.column(c).to_numpy() for c in "xyz"], axis=1), t.column("point_id").to_numpy()
        rows = farthest_rows(x, max(1, int(len(x) * share)))
        x, ids = x[rows], ids[rows]
        lists: list[list[int]] = [[]] * len(x)
        if len(x) >= least:
            lists, most = [], min(k, len(x) - 1)
            for at, d in octree._blocks(x, x):
                d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
                lists += octree._best(d, ids, most, np.inf)[1].reshape(-1, most).tolist()  # ties to the smaller id
        return pa.table({"label": pa.array(np.full(len(x), t.column("label")[0].as_py(), np.int64)), "point_id": ids, **{c: np.ascontiguousarray(x[:, i]) for i, c in enumerate("xyz")}, "near": pa.array(lists, pa.list_(pa.int64()))})

    typed = points.select(F.col("label").cast("long").alias("label"), F.col("point_id").cast("long").alias("point_id"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    out = typed.join(sizes.where(F.col("n") <= MOST_GROUP).select("label"), "label", "left_semi").groupBy("label").applyInArrow(pick, schema)
    for r in sizes.where(F.col("n") > MOST_GROUP).collect():  # at most a millionth of the points
        few = cut(farthest_points(typed.where(F.col("label") == r.label), max(1, int(r.n * share))).select("point_id", "x", "y", "z"))
        found = knn_join(few.withColumnRenamed("point_id", "q"), few.withColumnRenamed("point_id", "p"), k, self_join=True) if few.count() >= least else few.limit(0).select(F.col("point_id").alias("q"), F.col("point_id").alias("p"))
        lists = found.groupBy("q").agg(F.collect_list("p").alias("near"))  # k
        out = out.unionByName(few.join(lists, F.col("point_id") == F.col("q"), "left").select(F.lit(r.label).cast("long").alias("label"), "point_id", "x", "y", "z", F.coalesce("near", F.array().cast("array<long>")).alias("near")))
    return cut(out)


def neighbours(points: DataFrame, radius: float, most: int) -> DataFrame:
    """(q, p, d2): up to ``most`` points within ``radius`` of each, itself among them."""
    return range_join(points.withColumnRenamed("point_id", "q"), points.withColumnRenamed("point_id", "p"), radius, most)


def covariances(points: DataFrame, near: DataFrame) -> DataFrame:
    """Population covariance of the neighbours (q, p) of each point."""
    at = points.select(F.col("point_id").alias("p"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    return near.join(at, "p").groupBy("q").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyz"], *[F.covar_pop(i, j).alias(f"c{i}{j}") for i, j in pairs])


def principal_axes(cov: DataFrame) -> DataFrame:
    """Eigenvalues l1 >= l2 >= l3, the first axis (ax, ay, az) and the last one, the normal (nx, ny, nz)."""
    names = ["l1", "l2", "l3", "ax", "ay", "az", "nx", "ny", "nz"]

    def run(parts):
        for part in parts:
            m = np.empty((len(part), 3, 3))
            for i, a in enumerate("xyz"):
                for j, b in enumerate("xyz"):
                    m[:, i, j] = part["c" + "".join(sorted((a, b)))]
            values, axes = np.linalg.eigh(m) if len(part) else (np.zeros((0, 3)), np.zeros((0, 3, 3)))
            yield part[["q"]].assign(**dict(zip(names, [values[:, 2], values[:, 1], values[:, 0], *axes[:, :, 2].T, *axes[:, :, 0].T], strict=True)))

    return cov.mapInPandas(run, "q long, " + ", ".join(f"{n} double" for n in names))


def density_eps(points: DataFrame, factor: float = 8.0) -> float:
    """Eight times the median distance to the nearest other point."""
    q, p = points.withColumnRenamed("point_id", "q"), points.withColumnRenamed("point_id", "p")
    return factor * (exact_quantiles(knn_join(q, p, 1, self_join=True), F.sqrt("d2"), [0.5])[0] or 0.0)


def dbscan(points: DataFrame, eps: float, least: int = 5) -> DataFrame:
    """(point_id, label, core): clusters are named by their smallest core point, -1 is noise; a border point takes the smallest label."""
    return octree.density_clusters(points, eps, least)


def contract(points: DataFrame, near: DataFrame, strength: float = 0.4, steps: int = 30) -> DataFrame:
    """Laplacian contraction towards the mean of fixed neighbours (q, p), ever more weakly."""
    now = points.select("point_id", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    for n in range(steps):
        mean = near.join(now.withColumnRenamed("point_id", "p"), "p").groupBy("q").agg(*[F.avg(c).alias("m" + c) for c in "xyz"])
        step = strength / (1 + 0.1 * n)
        moved = now.join(mean, now.point_id == mean.q, "left")
        now = moved.select("point_id", *[(F.col(c) + step * (F.coalesce(F.col("m" + c), F.col(c)) - F.col(c))).alias(c) for c in "xyz"])
        now = cut(now) if steps > 1 else now
    return now


def vote(points: DataFrame, radius: float = 20.0, steps: int = 5, size: float = 2.5) -> DataFrame:
    """New points (x, y, z) beyond the ends of lines: where neighbours lie along one axis and to one side."""
    axes = principal_axes(covariances(points, neighbours(points, radius, 30)))
    line = axes.where((F.col("l1") >= 1e-6) & ((F.col("l1") - F.col("l2")) / F.col("l1") > 0.8))
    q, p = points.withColumnRenamed("point_id", "q"), points.withColumnRenamed("point_id", "p")
    context = knn_join(q, p, 10).join(points.select(F.col("point_id").alias("p"), *[F.col(c).cast("double").alias(c) for c in "xyz"]), "p").groupBy("q").agg(*[F.avg(c).alias("m" + c) for c in "xyz"])
    at = line.join(context, "q").join(points.select(F.col("point_id").alias("q"), *[F.col(c).cast("double").alias(c) for c in "xyz"]), "q")
    at = at.where(F.sqrt(dist2(xyz("m"), xyz())) > 0.2 * radius)
    side = F.when(sum(((F.col("m" + c) - F.col(c)) * F.col("a" + c) for c in "xyz"), F.lit(0.0)) > 0, -1.0).otherwise(1.0)
    rays = at.withColumn("side", side).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    return rays.select(*[(F.col(c) + F.col("side") * F.col("a" + c) * F.col("step") * size).alias(c) for c in "xyz"])


def grow_skeleton(points: DataFrame, radius: float = 20.0, steps: int = 5, size: float = 2.5, strength: float = 0.4, iterations: int = 30, rounds: int = 8) -> DataFrame:
    """Clusters (noise counts as one), two in a hundred spread points of each, contracted, then grown along their ends.

    Picks of fewer than 15 points stay as they are. The number of jobs depends on the steps and rounds, not on the clusters.
    """
    base = cut(points.select(F.col("point_id").cast("long").alias("point_id"), *[F.col(c).cast("double").alias(c) for c in "xyz"]))
    if base.isEmpty():
        return base.select("x", "y", "z")
    labels = cut(dbscan(base, density_eps(base)).select("point_id", "label"))
    few = spread_picks(base.join(labels, "point_id"), 0.02, 7, 15)
    now = contract(few, few.select(F.col("point_id").alias("q"), F.explode("near").alias("p")), strength, iterations).select("x", "y", "z")
    grown, now = None, cut(now)
    for _ in range(rounds):
        both = cut((now if grown is None else now.unionByName(grown)).select(F.monotonically_increasing_id().alias("point_id"), "x", "y", "z"))
        new = vote(both, radius, steps, size)
        if new.isEmpty():
            break
        grown = cut(voxel_downsample(new if grown is None else new.unionByName(grown), 1.1, colors=False, shift=0.5).select("x", "y", "z"))
    return now if grown is None else now.unionByName(grown)


def point_features(points: DataFrame, normal_radius: float, radius: float) -> DataFrame:
    """(id, f): 33 bins of angles between normals, those of the neighbours mixed in by distance (Rusu et al., 2009)."""
    normals = principal_axes(covariances(points, neighbours(points, normal_radius, 30))).select(F.col("q").alias("id"), "nx", "ny", "nz")
    full = cut(points.select(F.col("point_id").alias("id"), *[F.col(c).cast("double").alias(c) for c in "xyz"]).join(normals, "id"))
    near = cut(neighbours(points, radius, 100).where("q != p"))
    side = lambda n: full.select(F.col("id").alias(n), *[F.col(c).alias(n + c) for c in ("x", "y", "z", "nx", "ny", "nz")])
    pairs = near.join(side("q"), "q").join(side("p"), "p").where("d2 > 0")

    def angles(parts):
        for t in parts:
            a, b = t[["qx", "qy", "qz"]].to_numpy(float), t[["px", "py", "pz"]].to_numpy(float)
            u, n = t[["qnx", "qny", "qnz"]].to_numpy(float), t[["pnx", "pny", "pnz"]].to_numpy(float)
            d = np.sqrt(t["d2"].to_numpy(float))[:, None]
            line = (b - a) / d
            v = np.cross(u, line)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            w = np.cross(u, v)
            # an eigenvector has no sign: fold what changes with it
            alpha, phi = np.abs((v * n).sum(1)), np.abs((u * line).sum(1))
            theta = np.abs(np.arctan2((w * n).sum(1), (u * n).sum(1)))
            theta = np.minimum(theta, np.pi - theta)
            bins = [np.clip((x * 11).astype(int), 0, 10) + 11 * i for i, x in enumerate((alpha, phi, theta / (np.pi / 2)))]
            yield pd.DataFrame({"q": t["q"], **{f"bin{i}": b.astype("int32") for i, b in enumerate(bins)}})

    # histograms are arrays: a row for each bin of each pair would be some twenty times the pairs
    counts = pairs.mapInPandas(angles, "q long, bin0 int, bin1 int, bin2 int").groupBy("q").agg(F.count("*").alias("of"), F.array(*[F.count_if(F.col(f"bin{i // 11}") == i) for i in range(33)]).alias("n"))
    simple = cut(counts.select("q", F.transform("n", lambda n: n * 100.0 / F.col("of")).alias("h")))
    of_p = simple.select(F.col("q").alias("p"), "h")
    weighed = near.where("d2 > 0").select("q", "p", F.sqrt("d2").alias("d")).join(of_p, "p", "left")
    mixed = weighed.groupBy("q").agg(F.count("*").alias("k"), F.array(*[F.sum(F.coalesce(F.get("h", F.lit(i)) / F.col("d"), F.lit(0.0))) for i in range(33)]).alias("m"))
    return simple.join(mixed, "q").select(F.col("q").alias("id"), F.zip_with("h", "m", lambda h, m: h + m / F.col("k")).alias("f"))
