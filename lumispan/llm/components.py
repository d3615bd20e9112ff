"""Connected components of a graph given as edges, by alternating star contractions over local union-find.

The edges of every partition are first contracted with a union-find of its own. Forests of at most ``MOST_LOCAL`` edges in all,
counted first, are then joined by the same union-find in one task. Longer ones move neighbours to the smallest one (large star
and small star) until nothing changes. No round gathers a vertex's neighbours in one place: the smallest neighbour is an
aggregate that combines before the shuffle, joined back to the edges.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumispan.llm.common import materialize

MOST_LOCAL = 500_000  # edges that one task joins: at most 1 000 000 vertices, about 200 MB


def local_forest(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of each partition as stars around the smallest vertex of each of its components."""

    def run(batches):
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def stars():
            u = [x for x in parent if find(x) != x]
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array([find(x) for x in u], pa.int64())], names=["u", "v"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > 2_000_000:  # bounds the memory of a task; the stars so far say the same as their edges
                yield stars()
                parent.clear()
        if parent:
            yield stars()

    return edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).mapInArrow(run, "u long, v long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v; large: the larger neighbours of each vertex move to its smallest, small: the others do."""
    ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = ways.join(least, "u")
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def components(edges: DataFrame, rounds: int = 60, most_local: int = MOST_LOCAL) -> DataFrame:
    """(id, component) of each vertex of ``edges`` (u, v longs): the smallest vertex that edges reach; self-loops add nothing."""
    stars = materialize(local_forest(edges.where("u != v")), "edges")
    if stars.count() <= most_local:
        return _placed(materialize(local_forest(stars.coalesce(1)), "edges"))
    stars = materialize(stars.distinct(), "edges")
    mark = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    last = mark(stars)
    for _ in range(rounds):
        if not last.n:
            break
        stars = materialize(_star(_star(stars, True), False), "edges")
        now = mark(stars)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return _placed(stars)


def _placed(stars: DataFrame) -> DataFrame:
    """Each vertex of stars (u, v) and its component v."""
    vertices = stars.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return vertices.unionByName(stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
