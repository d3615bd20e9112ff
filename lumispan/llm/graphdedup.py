"""Near-duplicate vectors by robust-pruned flat graphs.

Vectors of one label are dealt to overlapping shards, each to its nearest few centroids. Every shard builds a graph: nearest
candidates, robust pruning (a neighbour goes if a kept one is nearer to it by the factor ``alpha``), reversed edges, pruning
again. The adjacency lists of all shards are joined; in each shard a greedy beam search runs for every vector from the medoid,
from a node of each piece that the medoid does not reach, and from the vector's own node or its joined neighbours. From what
it finds in range it expands through all neighbours in range. Hits are verified in double precision.
Recall is audited against brute force in blocks for all vectors whose id is divisible by 100, label by label. Labels under the
aim are searched again with a beam twice as wide and more overlap; those that stay under it, and labels of at most MOST_SHARD
nodes of which the audit has no true link, are compared exactly in blocks. Of a larger label without one, more vectors are
asked for, at last all, so no label's recall stays unmeasured. The measured recall is logged.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows without label. Equal
vectors of a label are one node; each copy counts as a link. Of rows with equal vec_id the one with the
smallest label, then the smallest vector, is the vector. An empty table gives none.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumispan.llm.common import materialize
from lumispan.llm.components import components

THRESHOLD = 0.98
SHARD = 800  # vectors that a centroid is for
MOST_CENTROIDS = 4096  # of all labels
MOST_SAMPLE = 40_000  # rows that centroids are learnt from
MOST_SHARD = 4000  # a larger shard is split by a hash; its parts are searched for all of its queries
OVERLAP = 2
DEGREE, CANDIDATES, BEAM = 24, 48, 24
ALPHA = 1.2
MORE = (25, 5, 1)  # one vector in so many is asked for where the audit met no link
MOST_ASKED = 8192  # vectors that a pass of brute force holds in a task and on the driver

log = logging.getLogger(__name__)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means; the rows of the result are unit vectors."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.sqrt((total * total).sum(axis=1))
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1e-12)[:, None], c)
    return c


def prune(x: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning for all nodes at once: ``candidates`` (n, c) sorted by distance, -1 for none; returns (n, degree)."""
    n, c = candidates.shape
    out = np.full((n, degree), -1, np.int32)
    v = x[np.maximum(candidates, 0)]
    own = np.maximum(0.0, 2 - 2 * np.einsum("ncd,nd->nc", v, x))
    alive = candidates >= 0
    for d in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        first = alive.argmax(axis=1)
        at = np.arange(n)
        out[some, d] = candidates[at, first][some]
        to = np.maximum(0.0, 2 - 2 * np.einsum("ncd,nd->nc", v, v[at, first]))
        alive &= (alpha * to > own) & some[:, None]
        alive[at, first] = False
    return out


def nearest(x: np.ndarray, k: int) -> np.ndarray:
    """(n, k) nearest other rows by blocks, nearest first; -1 where there are fewer."""
    n = len(x)
    out = np.full((n, k), -1, np.int32)
    m = min(k, n - 1)
    if m < 1:
        return out
    for lo in range(0, n, 1024):
        s = x[lo : lo + 1024] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -2
        top = np.argpartition(-s, m - 1, axis=1)[:, :m]
        order = np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable")
        out[lo : lo + len(s), :m] = np.take_along_axis(top, order, 1)
    return out


def build(x: np.ndarray) -> np.ndarray:
    """Adjacency (n, 2 * DEGREE) of a shard of unit vectors."""
    n = len(x)
    once = prune(x, nearest(x, CANDIDATES))
    i, j = np.nonzero(once >= 0)
    to = once[i, j]
    # a node gets the nodes that point to it as well, and is pruned again
    a, b = np.concatenate([i, to]), np.concatenate([to, i])
    a, b = np.unique(np.stack([a, b]), axis=1)
    sim = np.einsum("nd,nd->n", x[a], x[b])
    order = np.lexsort((b, -sim, a))
    a, b = a[order], b[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    width = 2 * CANDIDATES
    keep = rank < width
    both = np.full((n, width), -1, np.int32)
    both[a[keep], rank[keep]] = b[keep]
    return prune(x, both, 2 * DEGREE)


def entries(x: np.ndarray, graph: np.ndarray) -> np.ndarray:
    """The medoid and more nodes, so that every node is reached from one of them."""
    medoid = int((x @ unit(x.mean(axis=0, keepdims=True) + 1e-12)[0]).argmax())
    reached = np.zeros(len(x), bool)
    out, start, after = [], medoid, 0
    while True:
        out.append(start)
        reached[start] = True
        front = np.array([start])
        while len(front):
            near = np.unique(graph[front])
            near = near[near >= 0]
            front = near[~reached[near]]
            reached[front] = True
        while after < len(x) and reached[after]:
            after += 1
        if after == len(x):
            return np.array(out)
        start = after


def search(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, queries: np.ndarray, seeds: np.ndarray, threshold: float = THRESHOLD, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query place, node) in range: greedy search from ``starts`` and the query's seeds, then expansion through neighbours in range.

    ``graph`` is (n, degree) and ``seeds`` (queries, any), -1 for none. All queries go on together, each by its nearest open node.
    """
    n, q = len(x), len(queries)
    seen = np.zeros((q, n), bool)
    loose, slack = threshold - 1e-6, 1e-9
    first = np.concatenate([queries @ x[starts].T, np.full((q, seeds.shape[1] + beam), -3.0)], axis=1)
    nodes = np.concatenate([np.broadcast_to(starts, (q, len(starts))), seeds, np.full((q, beam), -1)], axis=1).astype(np.int64)
    seen[:, starts] = True
    r, c = np.nonzero((seeds >= 0) & ~seen[np.arange(q)[:, None], np.maximum(seeds, 0)])
    seen[r, seeds[r, c]] = True
    first[r, len(starts) + c] = np.einsum("nd,nd->n", queries[r], x[seeds[r, c]])
    hit = np.nonzero(first >= loose)
    found_q, found_n = [hit[0]], [nodes[hit]]
    top = np.argpartition(-first, beam - 1, axis=1)[:, :beam]
    sims = np.take_along_axis(first, top, 1)
    ids = np.where(sims > -3 + slack, np.take_along_axis(nodes, top, 1), -1)
    closed = np.zeros((q, beam), bool)
    while True:
        rank = np.where(closed | (ids < 0), -4.0, sims)
        at = rank.argmax(axis=1)
        live = np.flatnonzero(rank[np.arange(q), at] > -3.5)
        if not len(live):
            break
        node = ids[live, at[live]]
        closed[live, at[live]] = True
        near = graph[node]
        fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        r, c = np.nonzero(fresh)
        if not len(r):
            continue
        who, what = live[r], near[r, c]
        seen[who, what] = True
        s = np.einsum("nd,nd->n", queries[who], x[what])
        hit = s >= loose
        found_q.append(who[hit])
        found_n.append(what[hit])
        new = np.full(near.shape, -3.0)
        new[r, c] = s
        all_s = np.concatenate([sims[live], new], axis=1)
        all_i = np.concatenate([ids[live], near], axis=1)
        all_c = np.concatenate([closed[live], np.zeros(near.shape, bool)], axis=1)
        top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        sims[live] = np.take_along_axis(all_s, top, 1)
        ids[live] = np.where(sims[live] > -3 + slack, np.take_along_axis(all_i, top, 1), -1)
        closed[live] = np.take_along_axis(all_c, top, 1)
    who, what = np.concatenate(found_q), np.concatenate(found_n)
    edge_q, edge_n = who, what
    while len(edge_q):  # from all that is in range to what is next to it
        near = graph[edge_n]
        r, c = np.nonzero((near >= 0) & ~seen[edge_q[:, None], np.maximum(near, 0)])
        a, b = edge_q[r], near[r, c]
        if not len(a):
            break
        key = np.unique(a.astype(np.int64) * n + b)
        a, b = key // n, key % n
        seen[a, b] = True
        hit = np.concatenate([np.einsum("nd,nd->n", queries[a[i : i + 65536]], x[b[i : i + 65536]]) for i in range(0, len(a), 65536)]) >= loose
        edge_q, edge_n = a[hit], b[hit]
        who, what = np.concatenate([who, edge_q]), np.concatenate([what, edge_n])
    return who, what


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 1))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, width, v) of the valid vectors, scaled."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("v")).where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    # a power of two that brings the largest component near 1 keeps squares finite and changes no cosine
    scaled = rows.where(F.coalesce(good, F.lit(False))).withColumn("top", F.array_max(F.transform("v", F.abs))).withColumn("v", F.transform("v", lambda x: x / F.pow(F.lit(2.0), F.floor(F.log2("top")))))
    return scaled.select("vec_id", "label", F.size("v").alias("width"), "v")


def _sharded(nodes: DataFrame, overlap: int) -> DataFrame:
    """(shard, node, v): each node in its nearest shards."""
    sizes = {(r.label, r.width): r.n for r in nodes.groupBy("label", "width").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label", "width").limit(MOST_CENTROIDS).collect()}
    total = sum(sizes.values())
    share = max(SHARD, total / MOST_CENTROIDS)
    many = {k: n for k, n in sizes.items() if n > 1.5 * share}
    centres: dict[tuple[str, int], np.ndarray] = {}
    if many:
        keys = nodes.sparkSession.createDataFrame(list(many), "label string, width int")
        sample = nodes.join(F.broadcast(keys), ["label", "width"]).orderBy(F.xxhash64("node")).limit(MOST_SAMPLE).select("label", "width", "v").toPandas()
        for (label, width), part in sample.groupby(["label", "width"]):
            x = unit(np.array(part["v"].tolist()))
            centres[label, int(width)] = kmeans(x, max(1, round(many[label, int(width)] / share)))
    held = nodes.sparkSession.sparkContext.broadcast(centres)  # at most MOST_CENTROIDS vectors

    def deal(batches):
        for batch in batches:
            label, width = batch.column("label").to_pylist(), batch.column("width").to_pylist()
            names, rows = [], []
            for key in sorted(set(zip(label, width, strict=True))):
                at = np.array([i for i, k in enumerate(zip(label, width, strict=True)) if k == key])
                c = held.value.get(key)
                if c is None or len(c) == 1:
                    near = np.zeros((len(at), 1), np.int64)
                else:
                    s = unit(_matrix(batch.column("v").take(pa.array(at)))) @ c.T
                    near = np.argsort(-s, axis=1, kind="stable")[:, :overlap]
                for j in range(near.shape[1]):
                    names += [f"{key[0]}/{key[1]}/{x}" for x in near[:, j]]
                    rows.append(at)
            if rows:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(names), batch.column("node").take(at), batch.column("v").take(at)], names=["shard", "node", "v"])

    return nodes.select("label", "width", "node", "v").mapInArrow(deal, "shard string, node long, v array<double>")


def _split(dealt: DataFrame) -> DataFrame:
    """Shards over MOST_SHARD in parts by a hash; each part is searched for all vectors of its shard, some at a time."""
    size = dealt.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > MOST_SHARD)
    parts = F.ceil(F.col("n") / F.lit(MOST_SHARD)).cast("int")
    joined = dealt.join(F.broadcast(size.select("shard", parts.alias("parts"))), "shard", "left")  # at most one row a centroid or label
    return joined.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))


def near_links(nodes: DataFrame, threshold: float = THRESHOLD, beam: int = BEAM, overlap: int = OVERLAP) -> DataFrame:
    """Pairs (u, v) with u < v of nodes (label, width, node, v) in range."""
    dealt = materialize(_split(_sharded(nodes, overlap)), "shards")

    def make(table: pa.Table) -> pa.Table:
        x, ids = unit(_matrix(table.column("v"))), table.column("node").to_numpy()
        graph = build(x)
        i, j = np.nonzero(graph >= 0)
        return pa.table({"a": ids[i], "b": ids[graph[i, j]]})

    edges = dealt.groupBy("shard", "part").applyInArrow(make, "a long, b long")
    # the lists of all shards together; a list has at most 2 * DEGREE nodes from each of ``overlap`` shards
    joined = materialize(edges.groupBy("a").agg(F.collect_set("b").alias("near")), "adjacency")
    base = dealt.join(joined, dealt.node == joined.a, "left").select("shard", "part", "parts", "node", "v", "near", F.lit(True).alias("here"), F.lit(0).alias("turn"))
    # a part of a split shard takes the others' vectors as queries, as many at a time as it holds itself
    guests = dealt.where("parts > 1").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int") != F.col("part"))
    guests = guests.join(joined, guests.node == joined.a, "left").select("shard", "part", "parts", "node", "v", "near", F.lit(False).alias("here"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int").alias("turn"))
    hosts = base.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def look(table: pa.Table) -> pa.Table:
        here = table.column("here").to_numpy(zero_copy_only=False)
        turn = table.column("turn")[0].as_py()
        x, ids = unit(_matrix(table.column("v"))), table.column("node").to_numpy()
        own, own_ids = x[here], ids[here]
        place = {int(i): k for k, i in enumerate(own_ids)}
        local = [[place[b] for b in near or () if b in place] for near in table.column("near").to_pylist()]

        def padded(lists):
            out = np.full((len(lists), max(1, max(map(len, lists), default=1))), -1, np.int32)
            for k, near in enumerate(lists):
                out[k, : len(near)] = near
            return out

        graph = padded([near for near, h in zip(local, here, strict=True) if h])
        seeds = padded([[place[i]] if h else near for i, near, h in zip(ids.tolist(), local, here, strict=True)])
        starts = entries(own, graph) if len(own) else None
        asked = np.full(len(x), True) if turn == 0 else ~here
        queries, names, seeds = x[asked], ids[asked], seeds[asked]
        us, vs = [], []
        for lo in range(0, len(queries), 1000):
            if not len(own):
                break
            q, m = search(own, graph, starts, queries[lo : lo + 1000], seeds[lo : lo + 1000], threshold, beam)
            a, b = names[lo + q], own_ids[m]
            exact = np.einsum("nd,nd->n", queries[lo + q], own[m])
            keep = (a != b) & (exact >= threshold)
            us.append(np.minimum(a, b)[keep])
            vs.append(np.maximum(a, b)[keep])
        u, v = np.concatenate(us or [ids[:0]]), np.concatenate(vs or [ids[:0]])
        pairs = np.unique(np.stack([u, v]), axis=1)
        return pa.table({"u": pairs[0], "v": pairs[1]})

    both = hosts.unionByName(guests) if dealt.where("parts > 1").limit(1).count() else base
    found = both.groupBy("shard", "part", "turn").applyInArrow(look, "u long, v long")
    return materialize(found.distinct(), "vector-links")


def exact_links(nodes: DataFrame, asked: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(label, width, u, v) of all links of the nodes ``asked``, by brute force against all nodes, so many in a pass."""
    asked = materialize(asked.select("label", "width", "node", "v"), "asked")
    turns = max(1, -(-asked.count() // (MOST_ASKED * 3 // 4)))  # a hash deals unevenly

    def truth(turn: int) -> DataFrame:
        part = asked.where(F.pmod(F.xxhash64("node"), F.lit(turns)) == turn).toPandas()
        queries = {k: (some["node"].to_numpy(np.int64), unit(np.array(some["v"].tolist()))) for k, some in part.groupby(["label", "width"])}
        held = nodes.sparkSession.sparkContext.broadcast(queries)

        def run(batches):
            for batch in batches:
                label, width, ids = batch.column("label").to_pylist(), batch.column("width").to_pylist(), batch.column("node").to_numpy()
                rows: dict[tuple[str, int], list[int]] = {}
                for i, key in enumerate(zip(label, width, strict=True)):
                    if key in held.value:
                        rows.setdefault(key, []).append(i)
                for key, at in rows.items():
                    q, w = held.value[key]
                    x, own = unit(_matrix(batch.column("v").take(pa.array(at)))), ids[at]
                    for lo in range(0, len(x), step := max(1, (1 << 20) // len(q))):
                        i, j = np.nonzero((x[lo : lo + step] @ w.T >= threshold) & (own[lo : lo + step, None] != q[None, :]))
                        a, b = own[lo + i], q[j]
                        yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(a), pa.string()), pa.array([key[1]] * len(a), pa.int32()), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["label", "width", "u", "v"])

        return materialize(nodes.select("label", "width", "node", "v").mapInArrow(run, "label string, width int, u long, v long").distinct(), "exact")

    found = truth(0)
    for turn in range(1, turns):
        found = found.unionByName(truth(turn))
    return found.distinct() if turns > 1 else found  # a link whose two nodes are asked comes in two passes


def group_links(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(u, v) of all links of nodes in labels of at most MOST_SHARD nodes: a label is compared in one task."""

    def run(table: pa.Table) -> pa.Table:
        x, ids = unit(_matrix(table.column("v"))), table.column("node").to_numpy()
        us, vs = [ids[:0]], [ids[:0]]
        for lo in range(0, len(x), 256):
            i, j = np.nonzero((x[lo : lo + 256] @ x.T >= threshold) & (ids[lo : lo + 256, None] < ids[None, :]))
            us.append(ids[lo + i])
            vs.append(ids[j])
        return pa.table({"u": np.concatenate(us), "v": np.concatenate(vs)})

    return nodes.select("label", "width", "node", "v").groupBy("label", "width").applyInArrow(run, "u long, v long")


def audit(nodes: DataFrame, truth: DataFrame, links: DataFrame) -> DataFrame:
    """(label, width, nodes, there, found): of each label its nodes, the true links and those of them that are in ``links``."""
    keys = ["label", "width"]
    seen = truth.join(links.select("u", "v", F.lit(1).alias("hit")), ["u", "v"], "left").groupBy(*keys).agg(F.count("*").alias("there"), F.count("hit").alias("found"))
    sizes = nodes.groupBy(*keys).agg(F.count("*").alias("nodes"))
    return materialize(sizes.join(seen, keys, "left").select(*keys, "nodes", F.coalesce("there", F.lit(0)).alias("there"), F.coalesce("found", F.lit(0)).alias("found")), "audit")


def audited_links(nodes: DataFrame, threshold: float = THRESHOLD, aim: float = 0.98, tries: int = 3) -> DataFrame:
    """The links of :func:`near_links` of nodes (label, width, node, v, asked), brought to the aim in each label."""
    keys = ["label", "width"]
    truth = exact_links(nodes, nodes.where("asked"), threshold)
    beam, overlap, links, left = BEAM, OVERLAP, None, nodes
    for k in range(tries):
        found = near_links(left, threshold, beam, overlap)
        links = found if links is None else materialize(links.unionByName(found).distinct(), "links")
        recall = audit(nodes, truth, links)
        low = recall.where(F.col("found") < aim * F.col("there"))
        total = recall.agg(F.sum("found"), F.sum("there"), F.min(F.when(F.col("there") > 0, F.col("found") / F.col("there"))), F.count(F.when(F.col("there") == 0, 1))).first()
        n = low.count()
        log.info("try %d: %s of %s audited links found, least recall of a label %s, %d labels under %s, %d without a true link in the audit", k + 1, total[0], total[1], total[2], n, aim, total[3])
        if not n:
            break
        left = materialize(nodes.join(low.select(*keys), keys, "left_semi"), "low")
        beam, overlap = 2 * beam, overlap + 1
    unmet = materialize(recall.where((F.col("there") == 0) & (F.col("nodes") > MOST_SHARD)), "unmet")
    for parts in MORE:  # large labels without a true link in the audit: ask for more vectors until there is one, at last for all
        if unmet.isEmpty():
            break
        some = materialize(nodes.join(unmet.select(*keys), keys, "left_semi"), "some")
        more = exact_links(some, some.where(F.pmod(F.xxhash64("node"), F.lit(parts)) == 0), threshold)
        again = audit(some, more, links)
        links = materialize(links.unionByName(more.select("u", "v")).distinct(), "links")
        low = materialize(low.unionByName(again.where(F.col("found") < aim * F.col("there"))), "low") if parts > 1 else low  # all pairs are known
        unmet = materialize(again.where("there = 0"), "unmet")
    few = F.col("nodes") <= MOST_SHARD
    unproven = recall.where(few & (F.col("nodes") > 1) & (F.col("there") == 0)).unionByName(low.where(few))
    exact = group_links(nodes.join(unproven.select(*keys), keys, "left_semi"), threshold)
    bad = low.where(~few)
    if not bad.isEmpty():
        left = materialize(nodes.join(bad.select(*keys), keys, "left_semi"), "bad")
        log.warning("%d nodes of labels whose recall stays under %s are compared exactly", left.count(), aim)
        exact = exact.unionByName(exact_links(left, left, threshold).select("u", "v"))
    return materialize(links.unionByName(exact).distinct(), "links")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, aim: float = 0.98, tries: int = 3) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors`` (vec_id, embedding, label)."""
    valid = materialize(valid_vectors(vectors), "vectors")
    # a node is asked for in the audit if any of its copies is
    asked = F.max(F.col("vec_id") % 100 == 0).alias("asked")
    nodes = materialize(valid.groupBy("label", "width", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), asked), "nodes")
    links = audited_links(nodes, threshold, aim, tries)
    parts = components(links)
    copies = nodes.select("node", "copies")
    ways = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = ways.join(copies, ways.v == copies.node).groupBy("u").agg(F.sum("copies").alias("others"))
    by_node = nodes.join(linked, nodes.node == linked.u, "left").join(parts, nodes.node == parts.id, "left").select("label", "width", "v", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    by_vector = valid.join(by_node, ["label", "width", "v"]).select("vec_id", "n_links", "component_id")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    component = F.coalesce("component_id", "vec_id")
    return rows.join(by_vector, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
