"""Graphs of noisy clouds by discrete Morse theory: a weighted Rips filtration, its persistence, and what is left of its edges.

After Dey, Wang and Wang (2018), on k-nearest graphs: every point has the root mean square distance to its k nearest (Anai et
al., 2020) as its value, so dense places come first. Points are joined to the older side by edges in the order of their values
(elder rule); other edges close loops, which triangles fill later. Edges that join or close something for longer than a
threshold stay, with the paths that lead from them down to the densest places. Later steps drop loops with short ways around,
tie loose ends that point at each other, and drop the longest edges.

Persistence runs as rounds of joins or grouped reductions; no round holds more than ``COLUMNS`` columns in one task, on average,
and graphs of a checked number of edges end in one task.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumispan.functions.lineage import cut
from lumispan.functions.quantiles import exact_quantiles
from lumispan.functions.vectors import dist2, finite, xyz
from lumispan.operators.graphs import _in_one_task, _Sets, _small, compact_ids, connected_components, edge_lengths, trimmed
from lumispan.operators.spatial import knn_join, range_join, voxel_downsample

COLUMNS = 200_000  # columns of about four entries that a task of a round reduces


def weighted_rips(points: DataFrame, k: int = 15) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices (v, f), edges (rank, u, w, value), triangles (r1, r2, r3) of points (node_id, x, y, z).

    An edge has the value at which the balls of its ends, growing from their values on, touch; a triangle comes with its last
    edge. Ranks count edges from 0 in the order (value, u, w); those of a triangle fall.
    """
    q, p = points.withColumnRenamed("node_id", "q"), points.withColumnRenamed("node_id", "p")
    near = cut(knn_join(q, p, k, self_join=True))
    value = near.groupBy("q").agg(F.sqrt(F.sum("d2") / (F.count("*") + 1)).alias("value"))
    good = points.where(finite(*xyz())).select(F.col("node_id").cast("long").alias("v"))
    vertices = cut(good.join(value, F.col("v") == F.col("q"), "left").select("v", F.coalesce("value", F.lit(0.0)).alias("f")))
    pairs = near.groupBy(F.least("q", "p").alias("u"), F.greatest("q", "p").alias("w")).agg(F.sqrt(F.min("d2")).alias("d"))
    at = lambda n, f: vertices.select(F.col("v").alias(n), F.col("f").alias(f))
    fu, fw, d = F.col("fu"), F.col("fw"), F.col("d")
    meet = F.when(d <= F.abs(fu - fw), F.greatest(fu, fw)).otherwise(F.greatest(fu, fw, (fu + fw + d) / 2))
    valued = cut(pairs.join(at("u", "fu"), "u").join(at("w", "fw"), "w").select(meet.alias("value"), "u", "w"))
    edges = cut(compact_ids(valued.select(F.struct("value", "u", "w").alias("node_id"))).select(F.col("new_id").alias("rank"), "node_id.u", "node_id.w", "node_id.value"))
    side = lambda a, b, r: edges.select(F.col("u").alias(a), F.col("w").alias(b), F.col("rank").alias(r))
    three = side("a", "b", "i").join(side("a", "c", "j"), "a").where("b < c").join(side("b", "c", "k"), ["b", "c"])
    ordered = F.sort_array(F.array("i", "j", "k"), asc=False)
    return vertices, edges, three.select(*[ordered[n].alias(f"r{n + 1}") for n in range(3)])


def elder_pairs(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(rank, v): edges that join two parts, and the younger one's oldest vertex, by the order (f, v)."""
    full = edges.select("rank", "u", "w").join(vertices.select(F.col("v").alias("u"), F.col("f").alias("fu")), "u").join(vertices.select(F.col("v").alias("w"), F.col("f").alias("fw")), "w")
    full = cut(full.select("rank", "u", "fu", "w", "fw"))
    return _in_one_task(full, _elders, "rank long, v long") if _small(full) else _spread_elder(vertices, full.select("rank", "u", "w"))


def _elders(rows: list[tuple]) -> list[tuple]:
    s, born, out = _Sets(), {}, []
    for rank, u, fu, w, fw in sorted(rows):
        a, b = s.find(u), s.find(w)
        x, y = born.setdefault(a, (fu, u)), born.setdefault(b, (fw, w))
        if s.join(a, b):
            out.append((rank, max(x, y)[1]))
            born[s.find(a)] = min(x, y)
    return out


def _spread_elder(vertices: DataFrame, live: DataFrame) -> DataFrame:
    """Rounds in which every part whose first edge outwards leads to an older one ends there.

    At that edge the part is complete, and what lies behind the edge is at least as old as its part is known to be; the younger
    side of the first edge of all ends in every round. What is small enough ends in one task.
    """
    pairs = None
    while not live.isEmpty():
        f = lambda n: vertices.select(F.col("v").alias(n), F.col("f").alias("f" + n))
        full = live.join(f("u"), "u").join(f("w"), "w")
        if _small(live):
            last = _in_one_task(full.select("rank", "u", "fu", "w", "fw"), _elders, "rank long, v long")
            return last if pairs is None else pairs.unionByName(last)
        ways = full.select(F.col("u").alias("c"), F.col("fu").alias("fc"), F.col("w").alias("o"), F.col("fw").alias("fo"), "rank").unionByName(full.select(F.col("w").alias("c"), F.col("fw").alias("fc"), F.col("u").alias("o"), F.col("fu").alias("fo"), "rank"))
        first = ways.groupBy("c").agg(F.min(F.struct("rank", "o", "fo", "fc")).alias("m"))
        ends = cut(first.where(F.struct("m.fo", "m.o") < F.struct("m.fc", "c")).select("c", "m.o", "m.rank"))
        found = ends.select("rank", F.col("c").alias("v"))
        pairs = found if pairs is None else pairs.unionByName(found)
        to = ends.select("c", "o")
        while True:  # parts whose new part ends as well
            on = cut(to.join(to.select(F.col("c").alias("o"), F.col("o").alias("next")), "o", "left").select("c", F.coalesce("next", "o").alias("o"), F.col("next").isNotNull().alias("moved")))
            to = on.select("c", "o")
            if on.where("moved").isEmpty():
                break
        name = lambda n: to.select(F.col("c").alias(n), F.col("o").alias("new" + n))
        moved = live.join(name("u"), "u", "left").join(name("w"), "w", "left").select("rank", F.coalesce("newu", "u").alias("u"), F.coalesce("neww", "w").alias("w")).where("u != w")
        live = cut(moved.groupBy(F.least("u", "w").alias("u"), F.greatest("u", "w").alias("w")).agg(F.min("rank").alias("rank")).select("rank", "u", "w"))
    return vertices.sparkSession.createDataFrame([], "rank long, v long") if pairs is None else pairs


def _reduce(columns: list[tuple[tuple, list[int]]], low: int) -> list[tuple[tuple, set[int]]]:
    """Columns (name, rows) with different pivots (largest rows), as far as pivots stay at ``low`` or above.

    Only columns of smaller names are added to others, so pairs of pivots and names are those of the whole reduction, in whatever
    order columns come; empty ones go.
    """
    owner: dict[int, tuple[tuple, set[int]]] = {}
    out = []
    for name, rows in sorted((n, r) for n, r in columns):
        mine = set(rows)
        while mine:
            pivot = max(mine)
            if pivot < low:
                out.append((name, mine))
                break
            other = owner.get(pivot)
            if other is None:
                owner[pivot] = (name, mine)
                break
            if other[0] > name:  # it came earlier but stands later
                owner[pivot] = (name, mine)
                name, mine, other = other[0], set(other[1]), owner[pivot]
            mine = mine ^ other[1]
    return out + list(owner.values())


def loop_columns(positive: DataFrame, triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rank, rows), (at, death): the triangles of each edge that closes a loop, and the last edge of each triangle.

    Triangles are numbered in the order in which they come; ``rows`` holds the negative numbers, as later ones are smaller.
    """
    signs = positive.select(F.col("rank").alias("r"))
    numbered = cut(compact_ids(triangles.select(F.struct("r1", "r2", "r3").alias("node_id"))).select(F.col("new_id").alias("at"), "node_id.*"))
    sides = numbered.select("at", F.explode(F.array("r1", "r2", "r3")).alias("r")).join(signs, "r", "left_semi")
    columns = sides.groupBy("r").agg(F.collect_list(-F.col("at")).alias("rows"))  # at most the neighbours of an edge's end
    return cut(columns.withColumnRenamed("r", "rank")), numbered.select("at", F.col("r1").alias("death"))


def cycle_pairs(positive: DataFrame, triangles: DataFrame, most: int = COLUMNS) -> DataFrame:
    """(rank, death): loops that edges of rank ``rank`` close, and the rank of the last edge of the triangle that fills them.

    ``positive`` (rank) are the edges that close something. Their coboundaries are reduced, later edges first, with the earliest
    triangle as pivot: the pairs are those of the triangles' boundaries (de Silva, Morozov and Vejdemo-Johansson, 2011), but there
    is a column for each loop and not one for each triangle, and most have a pivot of their own from the start. Columns are dealt
    by ranges of their pivots. A round reduces the ranges to which something came, each by itself, and passes on what has left it.
    """
    state, ends = loop_columns(positive, triangles)
    n = state.agg(F.sum(F.size("rows"))).first()[0] or 0
    parts = -(-n // (4 * most))
    edges = sorted(set(state.select(F.array_max("rows").cast("double").alias("p")).approxQuantile("p", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    lows = [-(1 << 62), *(int(e) for e in edges)]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        at = int(part["part"].iloc[0])
        done = _reduce([((-r,), list(rows)) for r, rows in zip(part["rank"], part["rows"], strict=True)], lows[at])
        return pd.DataFrame({"rank": [-name[0] for name, _ in done], "rows": [sorted(r) for _, r in done], "was": at})

    place = F.size(F.filter(F.array(*[F.lit(x) for x in lows]), lambda x: x <= F.array_max("rows"))) - 1
    rest, state, turn = None, state.withColumn("part", place), 0
    while True:
        new = cut(state.groupBy("part").applyInPandas(run, "rank long, rows array<long>, was int").withColumn("part", place))
        into = [r.part for r in new.where("part != was").select("part").distinct().collect()]  # at most ``parts`` numbers
        held = new.drop("was") if rest is None else rest.unionByName(new.drop("was"))
        if not into:
            return held.select("rank", F.array_max("rows").alias("pivot")).join(ends, -F.col("pivot") == F.col("at")).select("rank", "death")
        turn += 1
        held = cut(held) if turn % 8 == 0 else held
        state, rest = held.where(F.col("part").isin(into)), held.where(~F.col("part").isin(into))


def persistence(vertices: DataFrame, edges: DataFrame, triangles: DataFrame) -> DataFrame:
    """(rank, u, w, value, joins, persistence) of each edge: for how long the part it ends had been there, or its loop will be.

    Loops that nothing fills have persistence null.
    """
    dead = cut(elder_pairs(vertices, edges))
    joined = edges.join(dead, "rank").join(vertices, "v").select("rank", "u", "w", edges.value, F.lit(True).alias("joins"), (edges.value - F.col("f")).alias("persistence"))
    loops = cut(edges.join(dead, "rank", "left_anti"))
    filled = cycle_pairs(loops, triangles)
    last = edges.select(F.col("rank").alias("death"), F.col("value").alias("end"))
    closed = loops.join(filled.join(last, "death"), "rank", "left").select("rank", "u", "w", "value", F.lit(False).alias("joins"), (F.col("end") - F.col("value")).alias("persistence"))
    return joined.unionByName(closed)


def reconstruct(vertices: DataFrame, lasting: DataFrame, threshold: float) -> DataFrame:
    """(src, dst, marker): edges that last longer than the threshold, and the paths from their ends down to the oldest vertices.

    Markers: -1 for edges that join parts, 2 for those that close loops, 1 for paths.
    """
    lasting = cut(lasting)
    short = F.col("joins") & (F.col("persistence") <= threshold)
    tree = lasting.where(short).select(F.col("u").alias("src"), F.col("w").alias("dst"))
    critical = cut(lasting.where(~short & (F.col("joins") | F.col("persistence").isNull() | (F.col("persistence") > threshold))).select(F.col("u").alias("src"), F.col("w").alias("dst"), F.when(F.col("joins"), -1).otherwise(2).alias("marker")))
    parts = connected_components(vertices.select(F.col("v").alias("node_id")), tree)
    roots = parts.join(vertices, F.col("node_id") == F.col("v")).groupBy("component").agg(F.min_by("v", F.struct("f", "v")).alias("node_id")).select("node_id")
    ends = critical.select(F.explode(F.array("src", "dst")).alias("node_id"))
    return _trimmed(tree, roots.unionByName(ends).distinct()).withColumn("marker", F.lit(1)).unionByName(critical)


def _trimmed(tree: DataFrame, stay: DataFrame) -> DataFrame:
    """Edges (src, dst) of a forest that lie between nodes of ``stay`` (node_id): other leaves go, one after the other."""
    mark = lambda n: stay.select(F.col("node_id").alias(n), F.lit(True).alias("keep_" + n))
    now = tree.join(mark("src"), "src", "left").join(mark("dst"), "dst", "left")
    now = cut(now.select("src", "dst", F.coalesce("keep_src", F.lit(False)).alias("s"), F.coalesce("keep_dst", F.lit(False)).alias("t")))
    if _small(now):

        def trim(rows):
            near: dict[int, set[int]] = {}
            kept = set()
            for a, b, s, t in rows:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
                kept |= {n for n, k in ((a, s), (b, t)) if k}
            leaves = [n for n, x in near.items() if len(x) == 1 and n not in kept]
            while leaves:
                n = leaves.pop()
                for hub in near.pop(n):
                    near[hub].discard(n)
                    if len(near[hub]) == 1 and hub not in kept:
                        leaves.append(hub)
                    elif not near[hub]:
                        near.pop(hub)
                        leaves = [x for x in leaves if x != hub]
            return [(a, b) for a, b, _, _ in rows if b in near.get(a, ())]

        return _in_one_task(now, trim, "src long, dst long")
    return trimmed(tree, stay)[0]


def detour_filter(nodes: DataFrame, edges: DataFrame, tau: float) -> DataFrame:
    """``edges`` (src, dst, marker) without those of marker 2 whose way around, along the others, is at most tau times their length.

    All candidates search at once: each round takes every way found on by one edge, as long as its bound allows.
    """
    long = cut(edge_lengths(nodes, edges.select("src", "dst", "marker").distinct()).join(edges.distinct(), ["src", "dst"]))
    base, loops = long.where("marker != 2"), long.where("marker = 2")
    ways = cut(base.select(F.col("src").alias("at"), F.col("dst").alias("to"), "length").unionByName(base.select(F.col("dst").alias("at"), F.col("src").alias("to"), "length")))
    front = cut(loops.select("src", "dst", (F.col("length") * tau).alias("most"), F.col("src").alias("at"), F.lit(0.0).alias("way")))
    best = front
    while True:
        step = front.join(ways, "at").select("src", "dst", "most", F.col("to").alias("at"), (F.col("way") + F.col("length")).alias("way")).where("way <= most")
        step = step.groupBy("src", "dst", "most", "at").agg(F.min("way").alias("way"))
        front = cut(step.join(best.select("src", "dst", "at", F.col("way").alias("known")), ["src", "dst", "at"], "left").where("known IS NULL OR way < known").select("src", "dst", "most", "at", "way"))
        if front.isEmpty():
            break
        best = cut(best.unionByName(front).groupBy("src", "dst", "most", "at").agg(F.min("way").alias("way")))
    short = best.where("at = dst").select("src", "dst").distinct()
    return base.select("src", "dst", "marker").unionByName(loops.select("src", "dst", "marker").join(short, ["src", "dst"], "left_anti"))


def loose_ends(nodes: DataFrame, edges: DataFrame, back: int = 3) -> DataFrame:
    """(node_id, x, y, z, dx, dy, dz): ends of one edge and the direction in which they point, from up to ``back`` edges before."""
    ways = cut(edges.select(F.col("src").alias("at"), F.col("dst").alias("to")).unionByName(edges.select(F.col("dst").alias("at"), F.col("src").alias("to"))).where("at != to").distinct())
    degree = cut(ways.groupBy("at").agg(F.count("*").alias("degree"), F.min("to").alias("one"), F.max("to").alias("two")))
    path = degree.where("degree = 1").select(F.col("at").alias("tip"), F.col("at").alias("prev"), F.col("one").alias("now"))
    for _ in range(back - 1):
        on = degree.where("degree = 2").select(F.col("at").alias("now"), "one", "two")
        path = path.join(on, "now", "left").select("tip", F.when(F.col("one").isNull(), F.col("prev")).otherwise(F.col("now")).alias("prev"), F.when(F.col("one").isNull(), F.col("now")).when(F.col("one") == F.col("prev"), F.col("two")).otherwise(F.col("one")).alias("now"))
    place = lambda n, p: nodes.select(F.col("node_id").alias(n), *[F.col(c).cast("double").alias(p + c) for c in "xyz"])
    both = path.join(place("tip", ""), "tip").join(place("now", "b"), "now")
    size = F.sqrt(dist2(xyz(), xyz("b")))
    return both.withColumn("size", size).where("size > 0").select(F.col("tip").alias("node_id"), *xyz(), *[((F.col(c) - F.col("b" + c)) / F.col("size")).alias("d" + c) for c in "xyz"])


def connect_ends(nodes: DataFrame, edges: DataFrame, reach: float, cone: float = 30.0) -> DataFrame:
    """(src, dst) between loose ends at most ``reach`` apart that point at each other within ``cone`` degrees, one for each end.

    Rounds match pairs that are the nearest offer of both ends (ties: smaller ids), until no pair has both ends free.
    """
    ends = cut(loose_ends(nodes, edges))
    found = range_join(ends.withColumnRenamed("node_id", "q"), ends.withColumnRenamed("node_id", "p"), reach).where("q < p AND d2 > 0")
    side = lambda n: ends.select(F.col("node_id").alias(n), *[F.col(c).alias(n + c) for c in ("x", "y", "z", "dx", "dy", "dz")])
    both = found.join(side("q"), "q").join(side("p"), "p")
    dot = lambda n: sum(((F.col("p" + c) - F.col("q" + c)) * F.col(f"{n}d{c}") for c in "xyz"), F.lit(0.0)) / F.sqrt("d2")
    least = math.cos(math.radians(cone))
    offers = cut(both.where((dot("q") >= least) & (dot("p") <= -least)).select("q", "p", "d2"))
    made = None
    while not offers.isEmpty():
        first = offers.select(F.explode(F.array("q", "p")).alias("n"), F.struct("d2", "q", "p").alias("o")).groupBy("n").agg(F.min("o").alias("o"))
        mutual = cut(first.groupBy("o").agg(F.count("*").alias("k")).where("k = 2").select("o.q", "o.p"))
        made = mutual if made is None else made.unionByName(mutual)
        used = mutual.select(F.explode(F.array("q", "p")).alias("n"))
        offers = cut(offers.join(used.withColumnRenamed("n", "q"), "q", "left_anti").join(used.withColumnRenamed("n", "p"), "p", "left_anti").select("q", "p", "d2"))
    none = edges.sparkSession.createDataFrame([], "src long, dst long")
    return none if made is None else made.select(F.col("q").alias("src"), F.col("p").alias("dst"))


def reconstruct_skeleton(points: DataFrame, threshold: float, tau: float = 3.0, reach: float = 0.0, voxel: float | None = None, k: int = 15, percentile: float = 0.75, cone: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, x, y, z) and edges (src, dst) of points (x, y, z) by all five stages; without points both are empty.

    ``voxel`` thins the cloud first. Loops with a way around of at most ``tau`` times their edge go, loose ends within ``reach``
    are tied, and edges longer than the percentile of all lengths go.
    """
    good = points.where(finite(*xyz())).select(*[F.col(c).cast("double").alias(c) for c in "xyz"])
    thin = voxel_downsample(good, voxel, colors=False, shift=0.5).select(*xyz()) if voxel else good
    places = cut(thin.distinct().select(F.struct("x", "y", "z").alias("node_id")))
    nodes = cut(compact_ids(places).select(F.col("new_id").alias("node_id"), *[F.col(f"node_id.{c}").alias(c) for c in "xyz"]))
    vertices, edges, triangles = weighted_rips(nodes, k)
    marked = cut(reconstruct(vertices, persistence(vertices, edges, triangles), threshold))
    kept = cut(detour_filter(nodes, marked, tau).select("src", "dst"))
    if reach > 0:
        kept = cut(kept.unionByName(connect_ends(nodes, kept, reach, cone)))
    lengths = cut(edge_lengths(nodes, kept))
    longest = exact_quantiles(lengths, "length", [percentile])[0]
    return nodes, lengths.where(F.col("length") <= F.lit(longest).cast("double") + 1e-9).select("src", "dst")
