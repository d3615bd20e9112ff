"""Skeleton graphs: nodes (node_id, x, y, z) and undirected edges (src, dst)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumispan.functions.lineage import cut
from lumispan.functions.quantiles import exact_quantiles
from lumispan.functions.vectors import dist2, finite, xyz
from lumispan.operators.spatial import extent, knn_edges, nearest_join, voxel_downsample


def undirected(edges: DataFrame, loops: bool = False) -> DataFrame:
    """Distinct edges with the smaller end first; loops go unless they are wanted."""
    kept = edges if loops else edges.where("src != dst")
    return kept.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, degree) of every node; a loop counts twice."""
    ends = undirected(edges, loops=True).select(F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))
    return nodes.select("node_id").join(ends, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_histogram(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(nodes, edges).groupBy("degree").agg(F.count("*").alias("n_nodes"))


def select_by_degree(nodes: DataFrame, edges: DataFrame, degree: int) -> DataFrame:
    return nodes.join(degrees(nodes, edges).where(F.col("degree") == degree), "node_id", "left_semi")


def edge_lengths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    at = lambda n, p: nodes.select(F.col("node_id").alias(n), *[F.col(c).alias(p + c) for c in "xyz"])
    joined = edges.join(at("src", "s"), "src").join(at("dst", "t"), "dst")
    return joined.select("src", "dst", F.sqrt(dist2(xyz("s"), xyz("t"))).alias("length"))


def compact_ids(nodes: DataFrame) -> DataFrame:
    """(node_id, new_id): dense ids in ascending order, without a window over all rows."""
    ordered = nodes.select("node_id").repartitionByRange("node_id").sortWithinPartitions("node_id")
    numbered = cut(ordered.select("node_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    sizes = numbered.groupBy("part").agg(F.count("*").alias("n"))  # a row for each task
    base = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    return numbered.join(F.broadcast(base), "part").select("node_id", (F.col("base") + F.col("at")).alias("new_id"))


def induced(nodes: DataFrame, edges: DataFrame, keep: DataFrame, renumber: bool = True) -> tuple[DataFrame, DataFrame]:
    """The subgraph of the nodes in ``keep`` (node_id), with dense ids if wanted."""
    kept = nodes.join(keep.select("node_id").distinct(), "node_id", "left_semi")
    inner = edges.join(kept.select(F.col("node_id").alias("src")), "src", "left_semi").join(kept.select(F.col("node_id").alias("dst")), "dst", "left_semi").select("src", "dst")
    if not renumber:
        return kept, inner
    ids = compact_ids(kept)
    a, b = ids.select(F.col("node_id").alias("src"), F.col("new_id").alias("s")), ids.select(F.col("node_id").alias("dst"), F.col("new_id").alias("t"))
    return kept.join(ids, "node_id").select(F.col("new_id").alias("node_id"), "x", "y", "z"), inner.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("t").alias("dst"))


def union(n1: DataFrame, e1: DataFrame, n2: DataFrame, e2: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both graphs side by side; the ids of the second follow those of the first."""
    top = n1.agg(F.coalesce(F.max("node_id") + 1, F.lit(0))).first()[0]
    nodes = n1.unionByName(n2.withColumn("node_id", F.col("node_id") + top))
    return nodes, e1.select("src", "dst").unionByName(e2.select((F.col("src") + top).alias("src"), (F.col("dst") + top).alias("dst")))


def median_length(nodes: DataFrame, edges: DataFrame) -> float | None:
    return exact_quantiles(edge_lengths(nodes, edges), "length", [0.5])[0]


def union_with_bridges(n1: DataFrame, e1: DataFrame, n2: DataFrame, e2: DataFrame, factor: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """As :func:`union`, and each new node is tied to the nearest old one within ``factor`` median edge lengths."""
    nodes, edges = union(n1, e1, n2, e2)
    if n1.isEmpty() or n2.isEmpty():
        return nodes, edges
    reach = median_length(n1, e1)
    reach = median_length(n2, e2) if reach is None else reach
    top = n1.agg(F.max("node_id") + 1).first()[0]
    near = nearest_join(n2.withColumnRenamed("node_id", "q"), n1.withColumnRenamed("node_id", "p"))
    bridges = near if reach is None else near.where(F.sqrt("d2") <= factor * reach)
    return nodes, edges.unionByName(bridges.select(F.col("p").alias("src"), (F.col("q") + top).alias("dst")))


LOCAL = 100_000  # a graph with no more edges than this, which is counted first, ends in one task


class _Sets:
    """Disjoint sets named by their smallest member."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _small(edges: DataFrame) -> bool:
    return edges.limit(LOCAL + 1).count() <= LOCAL


def _in_one_task(rows: DataFrame, work, schema) -> DataFrame:
    """``work`` on all rows of a DataFrame of checked size, as a list of tuples."""

    def run(parts):
        found = [t for p in parts for t in p.itertuples(index=False, name=None)]
        if found:
            yield pd.DataFrame(work(found), columns=names)

    names = [f.name for f in schema] if not isinstance(schema, str) else [c.split()[0] for c in schema.split(", ")]
    return rows.coalesce(1).mapInPandas(run, schema)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, component): the smallest id that edges reach."""
    edges = cut(undirected(edges))
    if not _small(edges):
        return _spread_components(nodes, edges)
    return _labelled(nodes, _in_one_task(edges.select("src", "dst"), _joined, "id long, component long"))


def _joined(rows: list[tuple]) -> list[tuple]:
    s = _Sets()
    for a, b in rows:
        s.join(a, b)
    return [(x, s.find(x)) for x in list(s.up)]


def _labelled(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return nodes.select("node_id").join(found, F.col("node_id") == F.col("id"), "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def _spread_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rounds in which every part joins the first of its neighbours, by a hash, if that comes before itself.

    So a round leaves about half of the parts that have edges, however ids lie along a path, and of the edges between two parts one
    stays; what is small enough ends in one task. The smallest ids are taken at the end.
    """
    live, steps = cut(edges.where("src != dst").select("src", "dst")), []
    while not live.isEmpty() and not _small(live):
        h = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(steps))).alias("h"), F.col(c).alias("o"))  # noqa: E731, B023
        way = lambda a, b: F.struct(F.col(a).alias("c"), h(b).alias("m"))  # noqa: E731, B023
        first = live.select(F.explode(F.array(way("src", "dst"), way("dst", "src"))).alias("w")).groupBy("w.c").agg(F.min("w.m").alias("m"))
        to = cut(first.withColumn("o", F.when(F.col("m") < h("c"), F.col("m.o")).otherwise(F.col("c"))).select("c", "o", (F.col("o") != F.col("c")).alias("moved")))
        while not to.where("moved").isEmpty():
            to = cut(to.join(to.select(F.col("c").alias("o"), F.col("o").alias("next")), "o").select("c", F.col("next").alias("o"), (F.col("next") != F.col("o")).alias("moved")))
        steps.append(to.select("c", "o"))
        name = lambda n: to.select(F.col("c").alias(n), F.col("o").alias("new" + n))  # noqa: E731, B023
        moved = live.join(name("src"), "src").join(name("dst"), "dst").where("newsrc != newdst")
        live = cut(moved.select(F.least("newsrc", "newdst").alias("src"), F.greatest("newsrc", "newdst").alias("dst")).distinct())
    found = cut(_in_one_task(live, _joined, "id long, part long"))
    for to in reversed(steps):  # a step has a row for each part that had edges then
        found = cut(to.join(found, F.col("o") == F.col("id"), "left").select(F.col("c").alias("id"), F.coalesce("part", "o").alias("part")))
    least = found.groupBy("part").agg(F.min("id").alias("component"))
    return _labelled(nodes, found.join(least, "part").select("id", "component"))


def minimum_forest(nodes: DataFrame, edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Minimum spanning forest of edges (a, b, d); the order (d, a, b) makes it unique."""
    edges = cut(edges.select("a", "b", "d"))
    return _first_edges(edges.withColumns({"ca": F.col("a"), "cb": F.col("b")})) if _small(edges) else _spread_forest(nodes, edges, rounds)


def _first_edges(live: DataFrame) -> DataFrame:
    def pick(rows):
        s = _Sets()
        return [(a, b, d) for d, a, b, x, y in sorted((d, a, b, x, y) for a, b, d, x, y in rows) if s.join(x, y)]

    return _in_one_task(live.select("a", "b", "d", "ca", "cb"), pick, "a long, b long, d double")


def _spread_forest(nodes: DataFrame, edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Boruvka's rounds: every part takes its first edge to another one, parts that meet become one, and of the edges between two
    parts the first stays. So a round leaves at most half of the parts; what is small enough ends in one task."""
    live = cut(edges.where("a != b").select("a", "b", "d", F.col("a").alias("ca"), F.col("b").alias("cb")))
    chosen = edges.select("a", "b", "d").limit(0)
    for _ in range(rounds):
        if _small(live):
            return chosen.unionByName(_first_edges(live))
        if live.isEmpty():
            return chosen
        ways = live.select("a", "b", "d", F.explode(F.array(F.struct(F.col("ca").alias("c"), F.col("cb").alias("o")), F.struct(F.col("cb").alias("c"), F.col("ca").alias("o")))).alias("w"))
        best = cut(ways.groupBy("w.c").agg(F.min(F.struct("d", "a", "b", "w.o")).alias("m")).select("c", "m.*"))
        chosen = chosen.unionByName(best.select("a", "b", "d").distinct())
        # first edges close no loop, but two parts can take the same one: the smaller is then the root
        back = best.select(F.col("c").alias("o"), F.col("o").alias("next"))
        to = cut(best.select("c", "o").join(back, "o").select("c", F.when((F.col("next") == F.col("c")) & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o")).alias("o"), F.lit(True).alias("moved")))
        while not to.where("moved").isEmpty():
            to = cut(to.join(to.select(F.col("c").alias("o"), F.col("o").alias("next")), "o").select("c", F.col("next").alias("o"), (F.col("next") != F.col("o")).alias("moved")))
        name = lambda n: to.select(F.col("c").alias(n), F.col("o").alias("new" + n))
        moved = live.join(name("ca"), "ca").join(name("cb"), "cb").where("newca != newcb")
        live = cut(moved.groupBy(F.least("newca", "newcb").alias("ca"), F.greatest("newca", "newcb").alias("cb")).agg(F.min(F.struct("d", "a", "b")).alias("m")).select("m.a", "m.b", "m.d", "ca", "cb"))
    raise RuntimeError("the forest did not settle")


def trimmed(edges: DataFrame, stay: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst) without leaves that are not in ``stay`` (node_id), taken off one after the other; nodes of parts that keep edges.

    A round takes off the loose leaves and makes one edge of the two at a node that has no others, of nodes whose hash is less than
    those of both neighbours. So chains get shorter from all places at once, and rounds grow with the logarithm of the graph;
    what is small enough ends in one task.
    """
    mark = lambda n, k: stay.select(F.col("node_id").alias(n), F.lit(True).alias(k)).distinct()
    named = cut(edges.select("src", "dst", F.monotonically_increasing_id().alias("id")))
    live = named.join(mark("src", "s"), "src", "left").join(mark("dst", "t"), "dst", "left")
    live = cut(live.select("id", "src", "dst", F.coalesce("s", F.lit(False)).alias("s"), F.coalesce("t", F.lit(False)).alias("t")))
    hung, merged, turn = [], [], 0
    while not _small(live):
        ends = live.select(F.explode(F.array(F.struct(F.col("src").alias("n"), F.col("s").alias("k"), F.struct("id", F.col("dst").alias("o"), F.col("t").alias("ok")).alias("e")), F.struct(F.col("dst").alias("n"), F.col("t").alias("k"), F.struct("id", F.col("src").alias("o"), F.col("s").alias("ok")).alias("e")))).alias("x")).select("x.*")
        thin = ends.groupBy("n").agg(F.count("*").alias("degree"), F.max("k").alias("k"), F.min("e").alias("e"), F.max("e").alias("f")).where("degree <= 2 AND NOT k")
        thin = cut(thin)
        loose = thin.where("degree = 1").select("n", "e.id", "e.o")
        if loose.isEmpty():
            break
        h = lambda c: F.xxhash64(F.col(c), F.lit(turn))  # noqa: E731, B023
        inner = thin.where((F.col("degree") == 2) & (F.col("e.o") != F.col("n")) & (F.col("f.o") != F.col("n")) & (h("n") < h("e.o")) & (h("n") < h("f.o")))
        inner = inner.select("n", F.col("e.id").alias("id"), F.col("f.id").alias("other"), F.col("e.o").alias("src"), F.col("f.o").alias("dst"), F.col("e.ok").alias("s"), F.col("f.ok").alias("t"))
        taken = loose.select("id").distinct()
        inner = cut(inner.join(taken, "id", "left_anti").join(taken.withColumnRenamed("id", "other"), "other", "left_anti"))
        hung.append(loose.select("n", "o").unionByName(inner.select("n", F.col("src").alias("o"))))
        merged.append(inner.select("id", "other"))
        used = taken.unionByName(inner.select(F.explode(F.array("id", "other")).alias("id")))
        live = cut(live.join(used, "id", "left_anti").unionByName(inner.select("id", "src", "dst", "s", "t")))
        turn += 1
    if _small(live):
        last = cut(_in_one_task(live, _trimmed, "id long, edge boolean"))
        kept, nodes = last.where("edge").select("id"), last.where("NOT edge").select(F.col("id").alias("n"))
    else:
        kept, nodes = live.select("id"), live.select(F.explode(F.array("src", "dst")).alias("n")).distinct()
    for on, two in zip(reversed(hung), reversed(merged), strict=True):
        kept = cut(kept.unionByName(two.join(kept, "id", "left_semi").select(F.col("other").alias("id"))))
        nodes = cut(nodes.unionByName(on.join(nodes.select(F.col("n").alias("o")), "o", "left_semi").select("n")))
    return cut(named.join(kept, "id", "left_semi").select("src", "dst")), nodes.select(F.col("n").alias("node_id"))


def _trimmed(rows: list[tuple]) -> list[tuple]:
    """(id, True) of edges that stay, (node, False) of nodes of parts that keep some."""
    at: dict[int, set[int]] = {}
    ends, loops, stay, s = {}, set(), set(), _Sets()
    for i, a, b, ka, kb in rows:
        ends[i] = (a, b)
        at.setdefault(a, set()).add(i)
        at.setdefault(b, set()).add(i)
        stay |= {n for n, k in ((a, ka), (b, kb)) if k}
        loops |= {a} if a == b else set()
        s.join(a, b)
    line = [n for n, e in at.items() if len(e) == 1 and n not in stay and n not in loops]
    while line:
        n = line.pop()
        if not at[n]:  # the last of two that faced each other
            continue
        i = at[n].pop()
        hub = sum(ends[i]) - n
        at[hub].discard(i)
        del ends[i]
        if len(at[hub]) == 1 and hub not in stay and hub not in loops:
            line.append(hub)
    roots = {s.find(a) for a, _ in ends.values()}
    return [(i, True) for i in ends] + [(n, False) for n in at if s.find(n) in roots]


def prune_leaves(nodes: DataFrame, edges: DataFrame, shortest: float) -> tuple[DataFrame, DataFrame]:
    """Take leaves off edges shorter than ``shortest`` until none is left; of two that face each other the lower id goes.

    A pass stops while two nodes with edges are left; nodes that lose their last edge stay. With fewer than two nodes left,
    the graph comes back as it was. Ids stay as they are.
    """
    lengths = cut(edge_lengths(nodes, undirected(edges)))
    if _small(lengths):
        kept = cut(_in_one_task(lengths.select("src", "dst", "length"), lambda rows: _pruned(rows, shortest), "src long, dst long, gone boolean"))
        # a row (node, node) names a node that goes, any other one an edge that stays
        left = nodes.join(kept.where("gone").select(F.col("src").alias("node_id")), "node_id", "left_anti")
        return (nodes, edges) if left.limit(2).count() < 2 else (left, kept.where("NOT gone").select("src", "dst"))
    # ends of long edges never go, so where any edge stays the order of passes tells at most which node of a short tree is its last
    stay = lengths.where(F.col("length") >= shortest).select(F.explode(F.array("src", "dst")).alias("node_id"))
    kept, held = trimmed(lengths.select("src", "dst"), stay)
    if kept.isEmpty():
        return _spread_prune(nodes, edges, lengths, shortest)
    held = cut(held)
    short = cut(lengths.join(held.select(F.col("node_id").alias("src")), "src", "left_anti").select("src", "dst", "length"))
    if _small(short):
        rest = _in_one_task(short, lambda rows: _pruned(rows, shortest, 2), "src long, dst long, gone boolean").where("gone").select(F.col("src").alias("node_id"))
    else:
        ends = short.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
        rest = ends.join(_spread_prune(ends, short, short, shortest, 2)[0], "node_id", "left_anti")
    gone = held.join(kept.select(F.explode(F.array("src", "dst")).alias("node_id")), "node_id", "left_anti").unionByName(rest)
    return nodes.join(gone, "node_id", "left_anti"), kept


def _pruned(rows: list[tuple], shortest: float, others: int = 0) -> list[tuple]:
    """Rows as in :func:`prune_leaves`; ``others`` are nodes with edges elsewhere."""
    near: dict[int, dict[int, float]] = {}
    for a, b, d in rows:
        near.setdefault(a, {})[b] = d
        near.setdefault(b, {})[a] = d
    gone, changed = [], True
    joined = others + sum(bool(x) for x in near.values())
    while changed:
        changed = False
        for n in sorted(n for n, x in near.items() if len(x) == 1):
            if joined <= 2:
                break
            if len(near[n]) != 1:
                continue
            (hub, d), = near[n].items()
            if d < shortest:
                near[n].clear()
                del near[hub][n]
                joined -= 1 + (not near[hub])
                gone.append((n, n, True))
                changed = True
    return gone + [(a, b, False) for a, b, _ in rows if b in near[a]]


def _spread_prune(nodes: DataFrame, edges: DataFrame, lengths: DataFrame, shortest: float, others: int = 0) -> tuple[DataFrame, DataFrame]:
    """Passes over the whole graph, each a few joins, until no leaf goes."""
    left, long = cut(nodes), lengths
    while True:
        degree = degrees(left, long.select("src", "dst")).where("degree > 0")
        tips = degree.where("degree = 1").select("node_id")
        ends = long.select(F.col("src").alias("node_id"), F.col("dst").alias("hub"), "length").unionByName(long.select(F.col("dst").alias("node_id"), F.col("src").alias("hub"), "length"))
        cand = ends.where(F.col("length") < shortest).join(tips, "node_id")
        facing = tips.select(F.col("node_id").alias("hub"), F.lit(True).alias("tip"))
        cand = cut(cand.join(facing, "hub", "left").where("tip IS NULL OR node_id < hub").select("node_id", "hub"))
        n, joined = cand.count(), others + degree.count()
        if not n:
            break
        if joined - 2 * n <= 2:
            # a pass goes by id and stops while two nodes with edges are left, so at most its last two candidates stay: a leaf
            # takes one node off, or two where it is the last of its hub
            hub = degree.select(F.col("node_id").alias("hub"), "degree")
            per_hub = cand.groupBy("hub").agg(F.count("*").alias("n"), F.max("node_id").alias("last"))
            cost = F.when((F.col("n") == F.col("degree")) & (F.col("node_id") == F.col("last")), 2).otherwise(1)
            costs = cut(cand.join(per_hub.join(hub, "hub"), "hub").select("node_id", cost.alias("cost")))
            before, stay = costs.agg(F.sum("cost")).first()[0], []
            for r in costs.orderBy(F.desc("node_id")).limit(2).collect():
                before -= r.cost
                if before >= joined - 2:
                    stay.append(r.node_id)
            if len(stay) == n:
                break
            cand = cand.where(~F.col("node_id").isin(stay)) if stay else cand
        gone = cand.select("node_id")
        left = cut(left.join(gone, "node_id", "left_anti"))
        long = cut(long.join(gone.withColumnRenamed("node_id", "src"), "src", "left_anti").join(gone.withColumnRenamed("node_id", "dst"), "dst", "left_anti").select("src", "dst", "length"))
    if not others and left.limit(2).count() < 2:
        return nodes, edges
    return left, long.select("src", "dst")


def skeleton(points: DataFrame, voxel: float | None = None, k: int = 4, prune: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a cloud (x, y, z): voxels, k-nearest edges, minimum forest, short leaves pruned."""
    good = points.where(finite(*xyz())).select("x", "y", "z")
    if good.limit(2).count() < 2:
        raise ValueError("a skeleton needs two points")
    cells = voxel_downsample(good, voxel or extent(good) / 40, colors=False)
    ordered = cells.repartitionByRange("kx", "ky", "kz").sortWithinPartitions("kx", "ky", "kz")
    raw = cut(ordered.select(F.monotonically_increasing_id().alias("node_id"), *[F.col(c).cast("float").alias(c) for c in "xyz"]))
    nodes = cut(raw.join(compact_ids(raw), "node_id").select(F.col("new_id").alias("node_id"), "x", "y", "z"))
    if nodes.limit(2).count() < 2:
        raise ValueError("too few voxels for a skeleton")
    forest = minimum_forest(nodes, cut(knn_edges(nodes, k)))
    edges = forest.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    if prune <= 0:
        return nodes, edges
    middle = exact_quantiles(forest, "d", [0.5])[0]
    kept, rest = prune_leaves(nodes, edges, prune * middle)
    return induced(kept, rest, kept)


def reconnect(nodes: DataFrame, edges: DataFrame, selected: DataFrame, k: int = 4) -> DataFrame:
    """Edges with those between selected nodes (node_id) replaced by the forest of their k-nearest edges."""
    chosen = nodes.join(selected.select("node_id").distinct(), "node_id", "left_semi")
    s, t = chosen.select(F.col("node_id").alias("src"), F.lit(True).alias("s")), chosen.select(F.col("node_id").alias("dst"), F.lit(True).alias("t"))
    outside = edges.join(s, "src", "left").join(t, "dst", "left").where("s IS NULL OR t IS NULL").select("src", "dst")
    forest = minimum_forest(chosen, cut(knn_edges(chosen, k)))
    return outside.unionByName(forest.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def surviving(nodes: DataFrame, points: DataFrame, gone: DataFrame) -> DataFrame:
    """(node_id) of the nodes whose nearest living point is not among ``gone`` (point_id)."""
    near = nearest_join(nodes.withColumnRenamed("node_id", "q"), points.where("alive").select(F.col("point_id").alias("p"), "x", "y", "z"))
    return near.join(gone.select(F.col("point_id").alias("p")).distinct(), "p", "left_anti").select(F.col("q").alias("node_id"))


def delete_cascade(nodes: DataFrame, edges: DataFrame, points: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the nodes whose nearest living point is among ``gone`` (point_id)."""
    return induced(nodes, edges, surviving(nodes, points, gone))
