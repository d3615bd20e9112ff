"""Lloyd's clustering of integer vectors by two trees.

Vectors are dealt to blocks of at most ``BLOCK`` as they come, and every block gets a cover tree once: a node covers its points
within a radius, the centres of its children are more than half of its level apart and cover half of it each. The blocks with
their trees are written as a table. Each round puts a tree of the same kind over the centroids and walks both from their roots,
the wider node of a pair first and all pairs of a step at once: a pair goes if its smallest distance exceeds the largest that the vectors' node can have to
some centroid. A node left with one centroid adds its sums as a whole; pairs of leaves are compared exactly, in integers.
Counts and sums of each task are added up by Spark, so a round brings k rows to the driver. Blocks don't depend on places,
so copies of one vector, however many, are spread like all others.

Vectors are kept with exactly ``width`` components, none null or non-finite. A component x counts as floor(scale * x). Starts
are the vectors with the smallest SHA-256 of "<seed>:<vec_id>" (equal ones by their components); rows without vec_id are
clustered but start nothing. Fewer starts than ``k`` make fewer centroids; with none there is no row. Repeated rows count
each. Integers beyond 2^27, whose distances don't fit a long, raise an error. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumispan.llm.common import materialize

BLOCK = 1024
LEAF = 16
MOST = 1 << 27  # of a component: 64 squares of twice that fit a long
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
BLOCKS = "ids array<bigint>, points binary, tree binary, radii binary"


class CoverTree:
    """Nodes in breadth-first order: centre (a row of ``points``), range of rows, range of children and radius of each."""

    def __init__(self, points: np.ndarray, nodes: np.ndarray, radii: np.ndarray):
        self.points, self.radii = points, radii
        self.centre, self.begin, self.end, self.first, self.last = nodes.T
        self.leaf = self.first == self.last
        self.sums: np.ndarray | None = None

    @classmethod
    def build(cls, x: np.ndarray, leaf: int = LEAF) -> tuple[CoverTree, np.ndarray]:
        """The tree of the rows of ``x``, and the order in which it holds them."""
        f = x.astype(np.float64)
        order = np.zeros(len(x), np.int64)
        nodes, radii = [], []
        line = deque([(0, np.arange(len(x)), np.sqrt(((f - f[0]) ** 2).sum(axis=1)), 0)])
        made = 1
        while line:
            p, rows, d, begin = line.popleft()
            radius = float(d.max())
            order[begin : begin + len(rows)] = rows
            first = made
            if len(rows) > leaf and radius > 0:
                half = 2.0 ** (np.ceil(np.log2(radius)) - 1)
                at, q, e = begin, p, d
                while len(rows):
                    mine = e <= half
                    line.append((q, rows[mine], e[mine], at))
                    at += int(mine.sum())
                    made += 1
                    rows = rows[~mine]
                    if len(rows):
                        q = int(rows[0])
                        e = np.sqrt(((f[rows] - f[q]) ** 2).sum(axis=1))
            nodes.append((p, begin, begin + len(d), first, made))
            radii.append(radius)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        table = np.array(nodes, np.int32)
        table[:, 0] = place[table[:, 0]]
        return cls(x[order], table, np.array(radii)), order

    def sum_of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        if self.sums is None:
            self.sums = np.concatenate([np.zeros((1, self.points.shape[1]), np.int64), self.points.astype(np.int64).cumsum(axis=0)])
        return self.sums[end] - self.sums[begin]


def _spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): all j in the range from begin[i] to end[i], for all i."""
    n = (end - begin).astype(np.int64)
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(n.cumsum() - n, n) + begin[i]


def walk(tree: CoverTree, over: CoverTree, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Nearest centroid of all points of ``tree``; ``over`` holds the centroids, ``numbers`` the number of each of its rows.

    Returns the number of the nearest centroid of each point (-1 where its node has it as a whole), the exact squared distances
    of those, and the wholes: their first points, ends and centroids.
    """
    n = len(tree.points)
    best, cluster = np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64)
    bound, touched = np.full(len(tree.radii), np.inf), np.zeros(len(tree.radii), bool)
    size = over.end - over.begin
    wholes, exact = [], []
    v, c = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(v):
        gap = tree.points[tree.centre[v]].astype(np.float64) - over.points[over.centre[c]]
        d = np.sqrt(np.einsum("nd,nd->n", gap, gap))
        np.minimum.at(bound, v, d + tree.radii[v])
        keep = d - tree.radii[v] - over.radii[c] <= bound[v] * (1 + 1e-9) + 1e-6
        v, c = v[keep], c[keep]
        alone = (np.bincount(v, minlength=len(bound))[v] == 1) & (size[c] == 1) & ~touched[v]
        if alone.any():
            wholes.append((tree.begin[v[alone]], tree.end[v[alone]], numbers[over.begin[c[alone]]]))
            v, c = v[~alone], c[~alone]
        ends = tree.leaf[v] & over.leaf[c]
        if ends.any():
            exact.append((v[ends], c[ends]))
            touched[v[ends]] = True
            v, c = v[~ends], c[~ends]
        # the wider one goes down to its children, with all pairs of a node of vectors alike; a leaf stands for itself
        widest = np.zeros(len(bound))
        np.maximum.at(widest, v, np.where(over.leaf[c], 0.0, over.radii[c]))
        down = ~tree.leaf[v] & (tree.radii[v] >= widest[v])
        i, below = _spread(np.where(down, tree.first[v], v), np.where(down, tree.last[v], v + 1))
        bound[below] = np.minimum(bound[below], bound[v[i]])
        stay = down[i] | over.leaf[c[i]]
        j, under = _spread(np.where(stay, c[i], over.first[c[i]]), np.where(stay, c[i] + 1, over.last[c[i]]))
        v, c = below[j], under
    if exact:
        v, c = (np.concatenate(x) for x in zip(*exact, strict=True))
        i, at = _spread(over.begin[c], over.end[c])
        for row in np.unique(at):
            nodes = v[i[at == row]]
            _, rows = _spread(tree.begin[nodes], tree.end[nodes])
            gap = tree.points[rows].astype(np.int64) - over.points[row].astype(np.int64)
            d = np.einsum("nd,nd->n", gap, gap)
            nearer = (d < best[rows]) | ((d == best[rows]) & (numbers[row] < cluster[rows]))
            best[rows[nearer]], cluster[rows[nearer]] = d[nearer], numbers[row]
    none = np.zeros(0, np.int64)
    return cluster, best, tuple(np.concatenate(x).astype(np.int64) for x in zip(*wholes, strict=True)) if wholes else (none, none, none)


def _blocks(batches, width: int):
    held: list[pa.RecordBatch] = []

    def made():
        both = pa.Table.from_batches(held).combine_chunks()
        x = both.column("x").combine_chunks().flatten().to_numpy().reshape(-1, width)
        if np.abs(x).max() > MOST or x.min() < -MOST:
            raise ValueError(f"components beyond {MOST} have no exact distances in a long")
        tree, order = CoverTree.build(x.astype(np.int32))
        nodes = np.stack([tree.centre, tree.begin, tree.end, tree.first, tree.last], axis=1).astype(np.int32)
        ids = pa.array([both.column("vec_id").combine_chunks().take(pa.array(order)).to_pylist()], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([ids, *(pa.array([b.tobytes()], pa.binary()) for b in (tree.points, nodes, tree.radii))], names=["ids", "points", "tree", "radii"])

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            take = min(batch.num_rows - at, BLOCK - sum(b.num_rows for b in held))
            held.append(batch.slice(at, take))
            at += take
            if sum(b.num_rows for b in held) == BLOCK:
                yield made()
                held.clear()
    if held:
        yield made()


def _trees(batches, width: int):
    """(ids, tree) of each block."""
    for batch in batches:
        for ids, points, nodes, radii in zip(*batch.columns, strict=True):
            yield ids.values, CoverTree(np.frombuffer(points.as_py(), np.int32).reshape(-1, width), np.frombuffer(nodes.as_py(), np.int32).reshape(-1, 5), np.frombuffer(radii.as_py()))


def dual_round(blocks: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sum of the vectors nearest to each centroid that has any."""
    width, k = len(centroids[0]), len(centroids)

    def run(batches):
        over, numbers = CoverTree.build(np.array(centroids, np.int64), 1)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for _, tree in _trees(batches, width):
            cluster, _, (begin, end, of) = walk(tree, over, numbers)
            np.add.at(counts, of, end - begin)
            np.add.at(sums, of, tree.sum_of(begin, end))
            for i in np.unique(cluster[cluster >= 0]):
                counts[i] += (cluster == i).sum()
                sums[i] += tree.points[cluster == i].sum(axis=0, dtype=np.int64)
        some = np.flatnonzero(counts)
        # the count stands beside the sums, as the last dimension
        both = np.concatenate([sums, counts[:, None]], axis=1)[some]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, width + 1).astype(np.int32)), pa.array(np.tile(np.arange(width + 1, dtype=np.int32), len(some))), pa.array(both.ravel())], names=["cluster", "i", "s"])

    rows = blocks.mapInArrow(run, "cluster int, i int, s long").groupBy("cluster", "i").agg(F.sum("s").alias("s"))
    found: dict[int, list[int]] = {}
    for r in rows.collect():  # k * (width + 1) rows
        found.setdefault(r.cluster, [0] * (width + 1))[r.i] = r.s
    return {c: (s[-1], s[:-1]) for c, s in found.items()}


def assign(blocks: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance) of each vector."""
    width = len(centroids[0])

    def run(batches):
        c = np.array(centroids, np.int64)
        over, numbers = CoverTree.build(c, 1)
        for ids, tree in _trees(batches, width):
            cluster, best, (begin, end, of) = walk(tree, over, numbers)
            i, rows = _spread(begin, end)
            cluster[rows] = of[i]
            gap = tree.points[rows].astype(np.int64) - c[of[i]]
            best[rows] = np.einsum("nd,nd->n", gap, gap)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(best)], names=["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, width: int = 64, seed: int = 3) -> DataFrame:
    """Cluster, exact squared distance and sums of distances of each vector (vec_id, embedding), and the digest of its centroid."""
    spark = vectors.sparkSession
    v = F.col("embedding").cast("array<double>")
    whole = (F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(F.coalesce(whole, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale)).alias("x"))
    starts = kept.where("vec_id IS NOT NULL").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256), "x").limit(k).collect()
    if not starts:
        return spark.createDataFrame([], RESULT)
    centroids = [list(r.x) for r in starts]
    blocks = materialize(kept.mapInArrow(lambda batches: _blocks(batches, width), BLOCKS), "blocks")
    for _ in range(rounds):
        sums = dual_round(blocks, centroids)
        moved = [[s // sums[i][0] for s in sums[i][1]] if i in sums else c for i, c in enumerate(centroids)]
        if moved == centroids:  # every further round gives the same
            break
        centroids = moved
    done = materialize(assign(blocks, centroids), "assigned")
    of = done.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows
    total = sum(r.cluster_inertia for r in of)
    facts = spark.createDataFrame([(r.cluster, r.cluster_inertia, total, hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()) for r in of], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(facts), "cluster").select(*[c.split()[0] for c in RESULT.split(", ")])
