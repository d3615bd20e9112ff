"""Joins in space over an adaptive octree: nearest, within a distance, and density counts, without one cell size for all.

Points at one place are one position, named by its smallest id. A position's code is its path in a cube around all, one octal
digit a level, 60 levels deep, so that a prefix is a cell. Cells are split until each holds at most ``LEAF`` positions, counted
by aggregates that combine before the shuffle: all cells a few levels below the last ones are counted at once, and only those
still too full go on. A leaf is one row with its positions and the tight box around them.

Leaves that come near another one are found by prefixes: the region to search is covered by few cells about as wide as itself,
and a leaf meets a cell if one's path begins with the other's. Of these, box distances keep what can matter. Distances are
then taken leaf by leaf. For k nearest, the first bound is the farthest corner of the smallest cell around the queries that
holds k positions, the second one comes from the leaf with the best such corner, by actual distances. Groups of at most
``CHUNK`` leaves meet a leaf of queries in one task; more of them are merged by rank.

So neither far outliers nor dense balls nor copies of one place make more than a leaf's share of pairs. Where there are at
most ``ONE`` points, which is counted, they go to the tasks of the queries as they are. Points with null, NaN or infinite coordinates take no part. Ids are keys:
an id at two places is two positions of one name, whose answers are mixed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumispan.functions.lineage import cut
from lumispan.functions.vectors import finite, xyz

LEAF = 256  # positions of a leaf
WIDE = 4096  # positions of a leaf no wider than the radius, where all within it are asked for; points of a row of it
ONE = 4096  # points that every task can hold
CHUNK = 32  # leaves that meet a leaf of queries at once
WORD, DEPTH = 15, 60  # levels that one long holds as decimal digits, levels in all
BLOCK = 1 << 20  # distances that are held at once
NEAR = 1 << 15  # those that stay in a core's cache
GROUP, GROUPS = 1 << 15, 16  # points of a group that a task of :func:`within` holds, but for a row; fewer where there were less than so many groups
SHARE, MOST_TASKS = 5 * 10**7, 20_000  # distances of a task of :func:`within`, up to so many tasks

_BOX = [f"{side}{c}" for side in ("lo", "hi") for c in "xyz"]


@dataclass
class Cube:
    """The smallest corner and the side, a power of two, of a cube around points."""

    low: tuple[float, float, float]
    side: float

    @classmethod
    def around(cls, *clouds: DataFrame) -> Cube:
        both = clouds[0].select("x", "y", "z")
        for c in clouds[1:]:
            both = both.unionByName(c.select("x", "y", "z"))
        r = both.agg(*[F.min(c).alias("lo" + c) for c in "xyz"], *[F.max(c).alias("hi" + c) for c in "xyz"]).first()
        if r.lox is None:
            return cls((0.0, 0.0, 0.0), 1.0)
        wide = max(r["hi" + c] - r["lo" + c] for c in "xyz")
        return cls(tuple(r["lo" + c] for c in "xyz"), 2.0 ** (math.frexp(wide)[1] if wide > 0 else 0))

    def code(self, place: list[Column]) -> Column:
        """Octal digits of the path to a place given in units of the side, each in [0, 1)."""
        bits = [F.lpad(F.bin(F.least(F.greatest(F.floor(p * float(1 << DEPTH)), F.lit(0)), F.lit((1 << DEPTH) - 1))), DEPTH, "0") for p in place]
        # binary digits read as decimal ones add up to octal ones without a carry
        word = lambda b, at: F.substring(b, at, WORD).cast("long")
        return F.concat(*[F.lpad((word(bits[0], at) * 4 + word(bits[1], at) * 2 + word(bits[2], at)).cast("string"), WORD, "0") for at in range(1, DEPTH, WORD)])

    def unit(self, column: Column, axis: int) -> Column:
        return (column - F.lit(self.low[axis])) / F.lit(self.side)


def positions(points: DataFrame, name: str, cube: Cube | None = None) -> DataFrame:
    """(pos, x, y, z, weight[, code]): distinct places of points (``name``, x, y, z), with the number of points there."""
    typed = points.where(finite(*xyz())).select(F.col(name).cast("long").alias("id"), *[(F.col(c).cast("double") + 0.0).alias(c) for c in "xyz"])
    out = typed.groupBy("x", "y", "z").agg(F.min("id").alias("pos"), F.count("*").alias("weight"))
    return out if cube is None else out.withColumn("code", cube.code([cube.unit(F.col(c), i) for i, c in enumerate("xyz")]))


def _prefixes(code: Column, lowest: int = 0, strict: bool = False) -> Column:
    top = F.length(code) - (1 if strict else 0)
    return F.when(top >= lowest, F.transform(F.sequence(F.lit(lowest), F.greatest(top, F.lit(lowest))), lambda i: F.substring(code, F.lit(1), i))).otherwise(F.array().cast("array<string>"))


def with_leaf(placed: DataFrame, total: int, bound: int | None = None, level: int | None = None) -> DataFrame:
    """``placed`` (code, ...) with the path of the leaf that holds each position; ``total`` is their number.

    Cells from ``level`` down, if given, are leaves with up to WIDE positions.
    """
    bound = bound or LEAF
    many = F.lit(bound) if level is None else F.when(F.length("up") >= level, max(bound, WIDE)).otherwise(bound)
    if total <= bound:
        return placed.withColumn("leaf", F.lit(""))
    parts, left, above = [], placed, 0
    depth = min(DEPTH, math.ceil(math.log(total / bound, 8)) + 2)
    while True:
        prefix = F.substring("code", 1, depth)
        cells = cut(left.groupBy(prefix.alias("cell")).agg(F.count("*").alias("n")))
        sums = cells.select(F.explode(_prefixes(F.col("cell"), above + 1)).alias("up"), "n").groupBy("up").agg(F.sum("n").alias("n"))
        # the first cell on the way down that is not too full
        fits = sums.where((F.col("n") <= many) | F.lit(depth == DEPTH) & (F.length("up") == DEPTH)).select("up")
        to = cells.select("cell", F.explode(_prefixes(F.col("cell"), above + 1)).alias("up")).join(fits, "up").groupBy("cell").agg(F.min_by("up", F.length("up")).alias("leaf"))
        to = cut(to)
        parts.append(left.withColumn("cell", prefix).join(to, "cell").drop("cell"))
        heavy = cells.join(to, "cell", "left_anti").select("cell")
        if depth == DEPTH or heavy.isEmpty():
            break
        left = cut(left.withColumn("cell", prefix).join(heavy, "cell", "left_semi").drop("cell"))
        above, depth = depth, min(DEPTH, depth + 4)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def packed(leafed: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """A row for each leaf: its number of positions, box and positions; arrays of the columns in ``extra`` stand beside them."""
    extra = extra or []
    rows = leafed.groupBy("leaf").agg(
        F.count("*").alias("n"), *[F.min(c).alias("lo" + c) for c in "xyz"], *[F.max(c).alias("hi" + c) for c in "xyz"],
        F.collect_list(F.struct("pos", "x", "y", "z", *extra)).alias("rows"),  # at most LEAF positions
    )
    return rows.select("leaf", "n", *_BOX, F.col("rows.pos").alias("pos"), *[F.col(f"rows.{c}").alias(c + "s") for c in "xyz"], *[F.col(f"rows.{c}").alias(c) for c in extra])


def _gap2(far: bool) -> Column:
    """Squared smallest or largest distance of the boxes of a query leaf (q...) and a leaf (p...), summed as distances are."""
    total = None
    for c in "xyz":
        if far:
            d = F.greatest(F.col(f"phi{c}") - F.col(f"qlo{c}"), F.col(f"qhi{c}") - F.col(f"plo{c}"))
        else:
            d = F.greatest(F.col(f"plo{c}") - F.col(f"qhi{c}"), F.col(f"qlo{c}") - F.col(f"phi{c}"), F.lit(0.0))
        total = d * d if total is None else total + d * d
    return total


def _boxes(leaves: DataFrame, prefix: str, *more: str) -> DataFrame:
    return leaves.select(F.col("leaf").alias(f"{prefix}leaf"), F.col("n").alias(f"{prefix}n"), *[F.col(b).alias(prefix + b) for b in _BOX], *more)


def candidates(queries: DataFrame, leaves: DataFrame, cube: Cube) -> DataFrame:
    """Pairs of a query leaf (from :func:`_boxes`, with its ``reach``) and a leaf whose boxes are at most ``reach`` apart."""
    p = _boxes(leaves, "p")
    wide = F.greatest(F.col("reach"), *[F.col(f"qhi{c}") - F.col(f"qlo{c}") for c in "xyz"])
    finest = 50  # a double holds 53 bits of a place
    around = queries.withColumn("level", F.greatest(F.lit(0), F.floor(F.log2(F.lit(cube.side) / F.greatest(wide, F.lit(cube.side * 0.5**finest)))).cast("int")))
    pad = F.col("reach") * (1 + 1e-12) + cube.side * 0.5**finest
    for i, c in enumerate("xyz"):
        cells = F.pow(F.lit(2.0), "level")
        at = lambda column, i=i: F.least(F.greatest(F.floor(cube.unit(column, i) * cells), F.lit(0)), cells.cast("long") - 1)  # noqa: E731, B023
        around = around.withColumn("i" + c, F.explode(F.sequence(at(F.col(f"qlo{c}") - pad), at(F.col(f"qhi{c}") + pad))))
    code = F.substring(cube.code([(F.col("i" + c) + 0.5) * F.pow(F.lit(2.0), -F.col("level")) for c in "xyz"]), F.lit(1), F.col("level"))
    around = around.withColumn("cell", code).drop("ix", "iy", "iz", "level")
    below = around.join(p.withColumn("cell", F.explode(_prefixes(F.col("pleaf")))), "cell")
    above = around.withColumn("up", F.explode(_prefixes(F.col("cell"), strict=True))).join(p, F.col("up") == F.col("pleaf")).drop("up")
    near = below.unionByName(above).drop("cell").withColumn("near2", _gap2(False)).where(F.col("near2") <= F.col("reach") * F.col("reach"))
    return near.dropDuplicates(["qleaf", "pleaf"])


def _arrays(row: dict, prefix: str) -> np.ndarray:
    return np.stack([row[f"{prefix}{c}s"].values.to_numpy() for c in "xyz"], axis=1)


def _rows(batch: pa.RecordBatch | pa.Table):
    for i in range(batch.num_rows):
        yield {name: batch.column(name)[i] for name in batch.schema.names}


def _distances(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    d = q[:, None, 0] - p[None, :, 0]
    total = d * d
    for c in (1, 2):
        d = q[:, None, c] - p[None, :, c]
        total += d * d
    return total


def _blocks(q: np.ndarray, p: np.ndarray, most: int | None = None):
    """(first query, distances) by blocks of queries."""
    step = max(1, (most or BLOCK) // max(1, len(p)))
    for at in range(0, len(q), step):
        yield at, _distances(q[at : at + step], p)


def _few(points: DataFrame, name: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids and places of points of checked number; None if there are more than ONE."""
    held = _typed(points, name).limit(ONE + 1).toArrow()
    if held.num_rows > ONE:
        return None
    return held.column(0).to_numpy(), np.stack([held.column(c).to_numpy() for c in "xyz"], axis=1)


def _typed(points: DataFrame, name: str) -> DataFrame:
    return points.where(finite(*xyz())).select(F.col(name).cast("long").alias(name), *[(F.col(c).cast("double") + 0.0).alias(c) for c in "xyz"])


def _best(d: np.ndarray, ids: np.ndarray, k: int, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, id, distance and rank of the k smallest of each row of ``d`` up to ``most``, ties to the smaller id."""
    m = min(k, d.shape[1])
    edge = np.partition(d, m - 1, axis=1)[:, m - 1 : m]
    i, j = np.nonzero((d <= edge) & (d <= most))
    order = np.lexsort((ids[j], d[i, j], i))
    i, j = i[order], j[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    i, j, rank = i[rank < k], j[rank < k], rank[rank < k]
    return i, ids[j], d[i, j], (rank + 1).astype(np.int32)


def _over_batches(queries: DataFrame, place: np.ndarray, of, schema: str) -> DataFrame:
    """``of(ids, first, distances)`` for blocks of queries (q, x, y, z) and the few points at ``place``."""

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy() for c in ("x", "y", "z")], axis=1)
            ids = batch.column("q").to_numpy()
            for at, d in _blocks(x, place):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in of(ids, at, d)], names=[c.split()[0] for c in schema.split(", ")])

    return _typed(queries, "q").mapInArrow(run, schema)


def _sides(queries: DataFrame, points: DataFrame, q: str, p: str) -> tuple[Cube, DataFrame, DataFrame, DataFrame, DataFrame]:
    cube = Cube.around(queries.where(finite(*xyz())), points.where(finite(*xyz())))
    places = cut(positions(points, p, cube))
    mine = places if queries is points else cut(positions(queries, q, cube))
    leafed = with_leaf(places, places.count())
    asking = leafed if mine is places else with_leaf(mine, mine.count())
    return cube, places, mine, leafed, asking


def none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "q long, p long, d2 double, rank int")


class Tree:
    """Points (p, x, y, z) made ready for many searches: held whole if they are few, else as leaves."""

    def __init__(self, points: DataFrame):
        self.few, self._leaves = _few(points, "p"), {}
        if self.few is None:
            self.cube = Cube.around(points.where(finite(*xyz())))
            self.places = cut(positions(points, "p", self.cube))
            self.total = self.places.count()
            self.leafed = cut(with_leaf(self.places, self.total))
            self.ids = cut(_typed(points, "p"))

    def leaves(self, k: int) -> DataFrame:
        """Leaves whose positions have the ids of at most ``k`` points each, the smallest."""
        if k not in self._leaves:
            many = self.places.where("weight > 1").select("x", "y", "z")
            leafed = self.leafed.withColumn("ids", F.array("pos"))
            if not many.isEmpty():
                ranked = self.ids.join(many, ["x", "y", "z"], "left_semi").withColumn("copy", F.row_number().over(W.partitionBy("x", "y", "z").orderBy("p"))).where(F.col("copy") <= k)
                few = ranked.groupBy("x", "y", "z").agg(F.sort_array(F.collect_list("p")).alias("ids"))  # at most k
                leafed = self.leafed.join(few, ["x", "y", "z"], "left").withColumn("ids", F.coalesce("ids", F.array("pos")))
            self._leaves[k] = cut(packed(leafed, ["ids"]))
        return self._leaves[k]


def nearest(queries: DataFrame, points: DataFrame | Tree, k: int, radius: float | None = None) -> DataFrame:
    """(q, p, d2, rank): the k nearest points (p, x, y, z) of each query (q, x, y, z), a point at its place included.

    Ties go to the smaller p. With ``radius`` only points at most that far count.
    """
    same = queries is points
    if k < 1:
        return none(queries.sparkSession)
    most = math.inf if radius is None else radius * radius
    tree = points if isinstance(points, Tree) else Tree(points.withColumn("p", F.col("q")) if same else points)
    if tree.few is not None:
        held, place = tree.few

        def of(ids, at, d):
            i, p, d2, rank = _best(d, held, k, most)
            return ids[at + i], p, d2, rank

        return _over_batches(queries, place, of, "q long, p long, d2 double, rank int") if len(place) else none(queries.sparkSession)
    leaves, mine = tree.leaves(k), tree.places
    if same:
        askers = leaves.drop("ids")
    else:
        mine = cut(positions(queries, "q", tree.cube))
        n = mine.count()
        if not n:
            return none(queries.sparkSession)
        askers = cut(packed(with_leaf(mine, n)))
    pairs = cut(_bounded(askers, leaves, tree.cube, min(k, tree.total), radius).withColumn("n", F.count("*").over(W.partitionBy("qleaf"))).select("qleaf", "pleaf", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")).withColumn("chunk", F.pmod(F.xxhash64("pleaf"), F.col("chunks")).cast("int")))

    def meet(q: pa.Table, p: pa.Table) -> pa.Table:
        names, rows, got = [], [], []
        if q.num_rows and p.num_rows:
            sides = list(_rows(p))
            place = np.concatenate([_arrays(r, "") for r in sides])
            counts = np.concatenate([r["ids"].values.value_lengths().to_numpy() for r in sides])
            flat = np.concatenate([r["ids"].values.flatten().to_numpy() for r in sides])
            place = np.repeat(place, counts, axis=0)
            for mine in _rows(q):
                own = mine["q_pos"].values.to_numpy()
                for at, d in _blocks(_arrays(mine, "q_"), place):
                    i, ids, d2, rank = _best(d, flat, k, most)
                    names.append(own[at + i])
                    rows.append(ids)
                    got.append(np.stack([d2, rank.astype(float)]))
        both = np.concatenate(got, axis=1) if got else np.zeros((2, 0))
        whole = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        chunks = int(p.column("chunks")[0].as_py()) if p.num_rows else 1
        return pa.table({"q": pa.array(whole(names), pa.int64()), "p": pa.array(whole(rows), pa.int64()), "d2": pa.array(both[0]), "rank": pa.array(both[1].astype(np.int32)), "chunks": pa.array(np.full(both.shape[1], chunks, np.int32))})

    # rows of points are merged: a broadcast would pass them through the driver, in each step of a registration
    left = pairs.select("qleaf", "chunk").distinct().join(askers.withColumnRenamed("leaf", "qleaf").hint("merge"), "qleaf").select(*[F.col(c).alias(f"q_{c}") for c in ("qleaf", "chunk", "pos", "xs", "ys", "zs")])
    right = pairs.join(leaves.withColumnRenamed("leaf", "pleaf").hint("merge"), "pleaf").select("qleaf", "chunk", "chunks", "ids", "xs", "ys", "zs")
    found = cut(left.groupBy("q_qleaf", "q_chunk").cogroup(right.groupBy("qleaf", "chunk")).applyInArrow(meet, "q long, p long, d2 double, rank int, chunks int"))
    merged = found.where("chunks > 1").withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("d2", "p"))).where(F.col("rank") <= k)
    out = found.where("chunks = 1").unionByName(merged).drop("chunks")
    return _expanded(out, mine, queries, "q") if not mine.where("weight > 1").isEmpty() else out


def _expanded(found: DataFrame, places: DataFrame, points: DataFrame, name: str) -> DataFrame:
    """Answers of positions (``name``) for all points that are there."""
    ids = points.where(finite(*xyz())).select(F.col(name).cast("long").alias("__id"), *[(F.col(c).cast("double") + 0.0).alias(c) for c in "xyz"])
    members = ids.join(places.where("weight > 1").select("pos", "x", "y", "z"), ["x", "y", "z"]).select("pos", "__id")
    single = places.where("weight = 1").select("pos", F.col("pos").alias("__id"))
    return found.withColumnRenamed(name, "pos").join(members.unionByName(single), "pos").drop("pos").withColumnRenamed("__id", name).select(*found.columns)


def _bounded(askers: DataFrame, leaves: DataFrame, cube: Cube, need: int, radius: float | None) -> DataFrame:
    """(qleaf, pleaf): leaves that can hold one of the ``need`` nearest positions of a query leaf."""
    nodes = leaves.select(F.explode(_prefixes(F.col("leaf"))).alias("cell"), "n", *_BOX).groupBy("cell").agg(F.sum("n").alias("n"), *[F.min(b).alias(b) if b.startswith("lo") else F.max(b).alias(b) for b in _BOX]).where(F.col("n") >= need)
    q = _boxes(askers, "q")
    homes = q.withColumn("cell", F.explode(_prefixes(F.col("qleaf")))).join(nodes.select("cell", *[F.col(b).alias("p" + b) for b in _BOX]), "cell")
    reach = F.sqrt(_gap2(True)) * (1 + 1e-12)
    homes = homes.groupBy("qleaf").agg(F.max_by(reach, F.length("cell")).alias("reach"))
    if radius is not None:
        homes = homes.withColumn("reach", F.least("reach", F.lit(float(radius))))
    near = cut(candidates(q.join(homes, "qleaf"), leaves, cube).withColumn("far2", _gap2(True)).select("qleaf", "pleaf", "pn", "near2", "far2", "reach"))
    order = W.partitionBy("qleaf").orderBy("far2", "pleaf").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = near.withColumn("sum", F.sum("pn").over(order))
    first = ranked.groupBy("qleaf").agg(F.min_by("pleaf", "sum").alias("pleaf"), F.min_by("pn", "sum").alias("pn"), F.min(F.when(F.col("sum") >= need, F.col("far2"))).alias("far2"))

    def kth(batches):
        for batch in batches:
            best = []
            for r in _rows(batch):
                worst = 0.0
                for _, d in _blocks(_arrays(r, "q"), _arrays(r, "p")):
                    worst = max(worst, float(np.partition(d, need - 1, axis=1)[:, need - 1].max()))
                best.append(worst)
            yield pa.RecordBatch.from_arrays([batch.column("qleaf"), pa.array(best, pa.float64())], names=["qleaf", "known2"])

    side = lambda d, s: d.select(F.col("leaf").alias(f"{s}leaf"), *[F.col(f"{c}s").alias(f"{s}{c}s") for c in "xyz"])
    tried = first.where(F.col("pn") >= need).select("qleaf", "pleaf").join(side(askers, "q").hint("merge"), "qleaf").join(side(leaves, "p").hint("merge"), "pleaf").drop("pleaf").mapInArrow(kth, "qleaf string, known2 double")
    bounds = first.select("qleaf", "far2").join(tried, "qleaf", "left").select("qleaf", F.least(F.coalesce("far2", F.lit(float("inf"))), F.coalesce("known2", F.lit(float("inf")))).alias("bound"))
    return near.join(bounds, "qleaf").where(F.col("near2") <= F.col("bound")).select("qleaf", "pleaf")


def leaf_pairs(askers: DataFrame, leaves: DataFrame, cube: Cube, radius: float) -> DataFrame:
    """(qleaf, pleaf) whose boxes are at most ``radius`` apart."""
    return candidates(_boxes(askers, "q").withColumn("reach", F.lit(float(radius))), leaves, cube).select("qleaf", "pleaf")


def _met(pairs: DataFrame, askers: DataFrame, leaves: DataFrame) -> DataFrame:
    """Pairs of leaves with the arrays of both sides."""
    side = lambda d, s: d.select(*[F.col(c).alias(s + c) for c in ("leaf", "pos", "xs", "ys", "zs")])
    return pairs.join(side(askers, "q"), "qleaf").join(side(leaves, "p"), "pleaf")


def within(queries: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """(q, p, d2) for queries (q, x, y, z) and points (p, x, y, z) at most ``radius`` apart."""
    same = queries is points
    if same:
        queries = points = points.withColumn("p", F.col("q"))
    most = radius * radius
    few = _few(points, "p")
    if few is not None:
        held, place = few

        def of(ids, at, d):
            i, j = np.nonzero(d <= most)
            return ids[at + i], held[j], d[i, j]

        return _over_batches(queries, place, of, "q long, p long, d2 double")
    cube = Cube.around(queries.where(finite(*xyz())), points.where(finite(*xyz())))
    level = min(DEPTH, max(0, math.ceil(math.log2(cube.side / radius)))) if radius > 0 else DEPTH
    boxes, rows = _dealt(points, "p", cube, level)
    asking, asked = (boxes, rows) if same else _dealt(queries, "q", cube, level)
    pairs = cut(candidates(_boxes(asking, "q").withColumn("reach", F.lit(float(radius))), boxes, cube).select("qleaf", "pleaf", (F.col("qn") * F.col("pn")).alias("work")))
    tasks = min(MOST_TASKS, 1 + (pairs.agg(F.sum("work")).first()[0] or 0) // SHARE)
    theirs = _grouped(rows)
    both = sent(pairs, theirs if same else _grouped(asked), theirs)

    def meet(batches):
        key, held = None, []
        for batch in batches:
            for r in _rows(batch):
                ids, x = r["pos"].values.to_numpy(), _arrays(r, "")
                low, high = x.min(axis=0), x.max(axis=0)
                if key != (now := (r["qgroup"].as_py(), r["pgroup"].as_py())):
                    key, held = now, []
                if not r["turn"].as_py():
                    held.append((ids, x, low, high))
                    continue
                for b, place, lo, hi in held:
                    gap = np.maximum(np.maximum(lo - high, low - hi), 0.0)
                    if gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2] > most:
                        continue
                    for at, d in _blocks(x, place, NEAR):
                        hit = np.flatnonzero(d <= most)
                        ends = np.searchsorted(hit, np.arange(len(d) + 1) * len(b))
                        lists = lambda v, ends=ends: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(v))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + len(d)]), lists(b[hit - np.repeat(np.arange(len(d)) * len(b), np.diff(ends))]), lists(d.ravel()[hit])], names=["q", "ps", "ds"])

    # a task holds the rows of one group of points and reads those of the queries' one after the other, so what is sent is a row for
    # each group that it meets and not for each row; a query's answers are one row up to here, as rows are slow to leave Python
    found = both.repartition(tasks, "qgroup", "pgroup").sortWithinPartitions("qgroup", "pgroup", "turn").mapInArrow(meet, "q long, ps array<long>, ds array<double>")
    return found.select("q", F.posexplode("ps").alias("at", "p"), "ds").select("q", "p", F.get("ds", F.col("at")).alias("d2"))


def sent(pairs: DataFrame, mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """(qgroup, pgroup, turn, pos, xs, ys, zs): each row of points for every group of the other side that its leaf meets, points first."""

    def side(own: DataFrame, other: DataFrame, this: str, that: str, turn: int) -> DataFrame:
        met = pairs.join(other.select(F.col("leaf").alias(f"{that}leaf"), F.col("group").alias(f"{that}group")).distinct(), f"{that}leaf")
        to = met.groupBy(F.col(f"{this}leaf").alias("leaf")).agg(F.collect_set(f"{that}group").alias("to"))
        named = own.withColumnRenamed("group", f"{this}group").join(to, "leaf").withColumn(f"{that}group", F.explode("to"))
        return named.select("qgroup", "pgroup", F.lit(turn).alias("turn"), "pos", "xs", "ys", "zs")

    return side(theirs, mine, "p", "q", 0).unionByName(side(mine, theirs, "q", "p", 1))


def _grouped(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`_dealt` with a ``group``: rows that follow each other along the paths, of about GROUP points in all."""
    ordered = rows.select("leaf", "part", F.size("pos").alias("n")).repartitionByRange("leaf", "part")
    sizes = cut(ordered.withColumn("task", F.spark_partition_id().cast("long")))
    size = min(GROUP, max(1, (sizes.agg(F.sum("n")).first()[0] or 0) // GROUPS))
    to = F.sum("n").over(W.partitionBy("task").orderBy("leaf", "part").rowsBetween(W.unboundedPreceding, W.currentRow))
    group = F.col("task") * F.lit(1 << 32) + F.floor((to - 1) / size)
    return rows.join(sizes.select("leaf", "part", group.alias("group")), ["leaf", "part"])


def _dealt(points: DataFrame, name: str, cube: Cube, level: int) -> tuple[DataFrame, DataFrame]:
    """Leaves (leaf, n, box) of points, and rows of about WIDE points of a leaf at most; copies of a place are points like others.

    Points of a row follow each other along the paths, so answers of neighbours are much alike and files of them are small.
    """
    places = cut(positions(points, name, cube))
    leafed = cut(with_leaf(places, places.count(), level=level))
    box = [f(c).alias(n + c) for n, f in (("lo", F.min), ("hi", F.max)) for c in "xyz"]
    boxes = cut(leafed.groupBy("leaf").agg(F.sum("weight").alias("n"), *box))
    each = leafed.select("leaf", "code", "pos", "x", "y", "z")
    if not leafed.where("weight > 1").isEmpty():
        each = _typed(points, name).withColumnRenamed(name, "pos").join(each.drop("pos"), ["x", "y", "z"])
    parts = boxes.select("leaf", F.ceil(F.col("n") / WIDE).alias("parts"))
    held = each.join(parts, "leaf").groupBy("leaf", F.pmod(F.xxhash64("pos"), "parts").alias("part")).agg(F.sort_array(F.collect_list(F.struct("code", "pos", "x", "y", "z"))).alias("rows"))  # about WIDE
    return boxes, cut(held.select("leaf", "part", F.col("rows.pos").alias("pos"), *[F.col(f"rows.{c}").alias(c + "s") for c in "xyz"]))


def _labels(linked: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches by links, from a symmetric matrix with a true diagonal."""
    n = len(linked)
    label = np.arange(n)
    while True:
        low = np.where(linked, label[None, :], n).min(axis=1)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def density_clusters(points: DataFrame, radius: float, least: int) -> DataFrame:
    """(point_id, label, core) of points (point_id, x, y, z): see :func:`lumispan.operators.features.dbscan`.

    Pairs of points are never written. Cells as narrow as the radius that hold ``least`` points are core as a whole and count as one
    place, so their number is bounded by the space and not by the points; distances are taken for the points outside of them, and
    for pairs of cells whose boxes leave open whether they join different parts.
    """
    from lumispan.operators.graphs import connected_components

    few = _few(points, "point_id")
    if few is not None:
        held, place = few
        spark = points.sparkSession
        found = spark.range(1, numPartitions=1).mapInArrow(lambda batches: _clustered(held, place, radius * radius, least), "pos long, component long, core boolean")
        return points.select("point_id").join(found, F.col("point_id") == F.col("pos"), "left").select("point_id", F.coalesce("component", F.lit(-1)).alias("label"), F.coalesce("core", F.lit(False)).alias("core"))
    named = points.select(F.col("point_id").cast("long").alias("q"), "x", "y", "z").withColumn("p", F.col("q"))
    if radius == 0:  # only copies of a place are near each other
        held = positions(named, "p").where(F.col("weight") >= least).select("x", "y", "z", F.col("pos").alias("component"), F.lit(True).alias("core"))
        return _at_places(points, held)
    cube, places, _, leafed, _ = _sides(named, named, "q", "p")
    most = radius * radius
    level = min(DEPTH, max(0, math.ceil(math.log2(cube.side * math.sqrt(3) / radius)))) if radius > 0 else DEPTH
    leafed = cut(leafed.withColumn("cell", F.substring("code", 1, level)))
    # cells in which all are within the radius of each other and that hold enough: each one is a part of a cluster, all core
    box = [f(c).alias(n + c) for n, f in (("lo", F.min), ("hi", F.max)) for c in "xyz"]
    wide = [F.col("hi" + c) - F.col("lo" + c) for c in "xyz"]
    full = cut(leafed.groupBy("cell").agg(F.sum("weight").alias("n"), F.min("pos").alias("rep"), *box).where((F.col("n") >= least) & (wide[0] * wide[0] + wide[1] * wide[1] + wide[2] * wide[2] <= most)))
    loose = cut(leafed.join(full.select("cell"), "cell", "left_anti"))
    # a full cell is a leaf of its own; others stay as wide as LEAF lets them, as a row of few positions costs Python as much as one of many
    solid = cut(leafed.join(full.select("cell", "rep"), "cell").withColumn("leaf", F.expr(f"substring(code, 1, greatest({level}, length(leaf)))")))
    leaves, asking, firm = cut(packed(leafed, ["weight"])), cut(packed(loose)), cut(packed(solid, ["rep"]))

    def counts(batches):
        for batch in batches:
            for r in _rows(batch):
                weight = r["weight"].values.to_numpy()
                n = np.concatenate([(d <= most) @ weight for _, d in _blocks(_arrays(r, "q"), _arrays(r, "p"))])
                yield pa.RecordBatch.from_arrays([r["qpos"].values, pa.array(n.astype(np.int64))], names=["pos", "n"])

    side = lambda d, s, *more: d.select(*[F.col(c).alias(s + c) for c in ("leaf", "pos", "xs", "ys", "zs")], *more)
    meet = lambda pairs, a, b, *more: pairs.join(side(a, "q"), "qleaf").join(side(b, "p", *more), "pleaf")
    dense = cut(meet(leaf_pairs(asking, leaves, cube, radius), asking, leaves, "weight").mapInArrow(counts, "pos long, n long").groupBy("pos").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("pos"))
    cores = cut(packed(loose.join(dense, "pos", "left_semi")))

    # full cells: sure links by boxes first, then what still joins different parts by distances
    cells = full.withColumnRenamed("cell", "leaf")
    near = cut(candidates(_boxes(cells, "q", F.col("rep").alias("src")).withColumn("reach", F.lit(float(radius))), cells, cube).where("qleaf < pleaf").join(cells.select(F.col("leaf").alias("pleaf"), F.col("rep").alias("dst")), "pleaf").select("src", "dst", (_gap2(True) <= most).alias("sure")))
    sure = near.where("sure").select("src", "dst")
    named = cut(connected_components(full.select(F.col("rep").alias("node_id")), sure))
    part = lambda n: named.select(F.col("node_id").alias(n), F.col("component").alias("of_" + n))
    open_ = cut(near.where("NOT sure").join(part("src"), "src").join(part("dst"), "dst").where("of_src != of_dst").select("src", "dst"))

    def touches(batches):
        for batch in batches:
            for r in _rows(batch):
                hit = any(bool((d <= most).any()) for _, d in _blocks(_arrays(r, "q"), _arrays(r, "p")))
                yield pa.RecordBatch.from_arrays([pa.array([r["src"].as_py()] if hit else [], pa.int64()), pa.array([r["dst"].as_py()] if hit else [], pa.int64())], names=["src", "dst"])

    of = lambda p, n: firm.select(F.element_at("rep", 1).alias(n), *[F.col(c).alias(p + c) for c in (*_BOX, "xs", "ys", "zs")])
    some = open_.join(of("q", "src"), "src").join(of("p", "dst"), "dst").where(_gap2(False) <= most)
    linked = named.where("node_id != component").select(F.col("node_id").alias("src"), F.col("component").alias("dst")).unionByName(some.mapInArrow(touches, "src long, dst long").distinct())

    def hangs(batches):
        for batch in batches:
            for r in _rows(batch):
                hit = np.concatenate([(d <= most).any(axis=1) for _, d in _blocks(_arrays(r, "q"), _arrays(r, "p"))])
                u = r["qpos"].values.to_numpy()[hit]
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(np.full(len(u), r["rep"].as_py(), np.int64))], names=["src", "dst"])

    hung = meet(leaf_pairs(cores, firm, cube, radius), cores, firm, F.element_at("rep", 1).alias("rep")).mapInArrow(hangs, "src long, dst long").distinct()

    def links(batches):
        for batch in batches:
            for r in _rows(batch):
                own, other = r["qpos"].values.to_numpy(), r["ppos"].values.to_numpy()
                a, b = _arrays(r, "q"), _arrays(r, "p")
                one = _labels(_linked(a, a, most))
                if r["qleaf"].as_py() == r["pleaf"].as_py():
                    star = np.flatnonzero(one != np.arange(len(one)))
                    u, v = own[star], own[one[star]]
                else:  # what both leaves say of themselves comes from their own pairs; here the sets of one meet those of the other
                    two = _labels(_linked(b, b, most))
                    s, t = np.unique(one), np.unique(two)
                    touch = np.zeros((len(one), len(t)), bool)
                    for at, d in _blocks(a, b):
                        i, j = np.nonzero(d <= most)
                        touch[at + i, np.searchsorted(t, two[j])] = True
                    met = np.zeros((len(s), len(t)), bool)
                    np.logical_or.at(met, np.searchsorted(s, one), touch)
                    i, j = np.nonzero(met)
                    u, v = own[s[i]], other[t[j]]
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["src", "dst"])

    loops = leaf_pairs(cores, cores, cube, radius).where("qleaf <= pleaf")
    edges = cut(_met(loops, cores, cores).mapInArrow(links, "src long, dst long").unionByName(hung).unionByName(linked))
    nodes = dense.select(F.col("pos").alias("node_id")).unionByName(full.select(F.col("rep").alias("node_id")))
    found = cut(connected_components(nodes, edges))
    parts = cut(dense.join(found, F.col("pos") == F.col("node_id")).select("pos", "component").unionByName(solid.join(found, F.col("rep") == F.col("node_id")).select("pos", "component")))
    labelled = cut(packed(leafed.join(parts, "pos"), ["component"]))
    rest = cut(packed(loose.join(dense, "pos", "left_anti")))

    def border(batches):
        top = np.iinfo(np.int64).max
        for batch in batches:
            for r in _rows(batch):
                c = r["component"].values.to_numpy()
                low = np.concatenate([np.where(d <= most, c[None, :], top).min(axis=1) for _, d in _blocks(_arrays(r, "q"), _arrays(r, "p"))])
                some = low < top
                yield pa.RecordBatch.from_arrays([pa.array(r["qpos"].values.to_numpy()[some]), pa.array(low[some])], names=["pos", "component"])

    reach = meet(leaf_pairs(rest, labelled, cube, radius), rest, labelled, "component").mapInArrow(border, "pos long, component long").groupBy("pos").agg(F.min("component").alias("component"))
    found = parts.withColumn("core", F.lit(True)).unionByName(reach.withColumn("core", F.lit(False)))
    return _at_places(points, places.select("pos", "x", "y", "z").join(found, "pos").drop("pos"))


def _at_places(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(point_id, label, core) of points from the places (x, y, z, component, core) that are in a cluster."""
    at = points.select(F.col("point_id"), *[(F.col(c).cast("double") + 0.0).alias(c) for c in "xyz"])
    return at.join(labels, ["x", "y", "z"], "left").select("point_id", F.coalesce("component", F.lit(-1)).alias("label"), F.coalesce("core", F.lit(False)).alias("core"))


def _clustered(ids: np.ndarray, x: np.ndarray, most: float, least: int):
    """Clusters of few points in one task: up from the smallest ids, so that rows reach the smallest core."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    core = np.concatenate([(d <= most).sum(axis=1) >= least for _, d in _blocks(x, x)]) if len(x) else np.zeros(0, bool)
    hard = np.flatnonzero(core)
    if not len(hard):
        return
    label = ids[hard][_labels(_linked(x[hard], x[hard], most))]
    top = np.iinfo(np.int64).max
    low = np.concatenate([np.where(d <= most, label[None, :], top).min(axis=1) for _, d in _blocks(x, x[hard])])
    low[hard] = label
    some = low < top
    yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(low[some]), pa.array(core[some])], names=["pos", "component", "core"])


def _linked(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate([d <= most for _, d in _blocks(a, b)])
