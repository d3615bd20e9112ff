"""Extent, voxels, and nearest, k-nearest and range joins over the adaptive octree of :mod:`lumispan.operators.octree`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumispan.operators import octree


def bbox(points: DataFrame) -> DataFrame:
    return points.agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def extent(points: DataFrame) -> float:
    """The longest side of the box around the points, at least 1e-9."""
    r = bbox(points).first()
    return max([1e-9, *(r[f"max_{c}"] - r[f"min_{c}"] for c in "xyz" if r[f"min_{c}"] is not None)])


def voxel_keys(points: DataFrame, size: float, shift: float = 0.0) -> DataFrame:
    """kx, ky, kz counted from the smallest coordinates less ``shift`` sizes, with single precision as the coordinates have."""
    if size <= 0:
        raise ValueError("voxel size must be positive")
    low = points.agg(*[(F.min(c).cast("float") - F.lit(float(size * shift)).cast("float")).alias(f"__{c}") for c in "xyz"])
    key = lambda c: F.floor(((F.col(c).cast("float") - F.col(f"__{c}")).cast("double") / F.lit(float(size)).cast("double")).cast("float")).cast("long")
    return points.join(F.broadcast(low)).withColumns({f"k{c}": key(c) for c in "xyz"}).drop("__x", "__y", "__z")  # one row


def voxel_downsample(points: DataFrame, size: float, colors: bool = True, shift: float = 0.0) -> DataFrame:
    """Mean place and colour of the points in each voxel, and their number; a ``shift`` of 0.5 centres the first voxel."""
    names = [*"xyz", *("rgba" if colors else "")]
    mean = [F.avg(F.col(c).cast("double")).alias(c) for c in names]
    made = voxel_keys(points, size, shift).groupBy("kx", "ky", "kz").agg(F.count("*").alias("n"), *mean)
    return made.withColumns({c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) for c in "rgba"}) if colors else made


def thinned(points: DataFrame, size: float | None = None) -> DataFrame:
    """The living points by voxels, with ids of their own, alive and not selected; a hundredth of their extent where no size is given."""
    living = points.where("alive")
    made = voxel_downsample(living, size or max(extent(living) / 100, 1e-9))
    return made.select(F.monotonically_increasing_id().alias("point_id"), *[F.col(c).cast("float").alias(c) for c in "xyzrgba"], F.lit(True).alias("alive"), F.lit(False).alias("selected"))


def range_join(queries: DataFrame, points: DataFrame, radius: float, most: int | None = None) -> DataFrame:
    """(q, p, d2) for queries (q, x, y, z) and points (p, x, y, z) at most ``radius`` apart; the ``most`` nearest of each if given."""
    if radius < 0:
        return octree.none(queries.sparkSession).drop("rank")
    return octree.within(queries, points, radius) if most is None else octree.nearest(queries, points, most, radius).drop("rank")


def knn_join(queries: DataFrame, points: DataFrame, k: int, self_join: bool = False) -> DataFrame:
    """(q, p, d2, rank): the k nearest points of each query, ties to the smaller p; ``self_join`` has the same points on both sides and leaves q = p out."""
    if not self_join:
        return octree.nearest(queries, points, k)
    if k < 1:
        return octree.none(queries.sparkSession)
    found = octree.nearest(queries, queries, k + 1)
    own = found.where("q = p").select("q", F.col("rank").alias("own"))  # there are none where k others are at the same place
    kept = found.join(own, "q", "left").where("q != p").withColumn("rank", F.when(F.col("rank") > F.col("own"), F.col("rank") - 1).otherwise(F.col("rank")))
    return kept.where(F.col("rank") <= k).drop("own")


def nearest_join(queries: DataFrame, points: DataFrame) -> DataFrame:
    return knn_join(queries, points, 1).drop("rank")


def knn_edges(nodes: DataFrame, k: int) -> DataFrame:
    """Undirected edges (a, b, d) with a < b of nodes (node_id, x, y, z): the union of all k-nearest lists."""
    q, p = nodes.withColumnRenamed("node_id", "q"), nodes.withColumnRenamed("node_id", "p")
    found = knn_join(q, p, k, self_join=True)
    return found.groupBy(F.least("q", "p").alias("a"), F.greatest("q", "p").alias("b")).agg(F.sqrt(F.min("d2")).alias("d"))
