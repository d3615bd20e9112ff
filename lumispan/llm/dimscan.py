"""Nearest neighbours by cosine: inverted lists whose vectors are scanned by blocks of rotated dimensions.

Vectors are brought to unit length and turned by one random rotation, after which any leading dimensions are a fair sample of a
distance. Each goes to the list of its nearest centroid; centroids are learnt from at most ``MOST_SAMPLE`` vectors, all vectors
are indexed. Lists are cut into chunks of about ``CHUNK`` vectors by a hash, and a chunk holds its vectors as one matrix for each
block of dimensions. A query scans the chunks of its nearest lists block by block: from the part of the squared distance that it
has seen, a hypothesis test (Gao and Long, 2023) rejects that the vector is nearer than the k-th one known, and abandons it.
What is left is compared by the cosine of the original vectors in double precision. Queries scan their first list before the
others, so that the others start with a k-th distance.

How many lists are probed is measured: ``AUDIT`` queries, chosen by a hash, are compared with all vectors, and the smallest
number of lists which holds ``AIM`` of their true neighbours is taken. The recall of the result is measured on the same queries,
and logged; below ``LEAST`` all lists are scanned without the test, which is exact.

Equal vectors are one node: of its copies only the k + 1 smallest (by vec_id) can be among k nearest, and a query is asked once
for all of its copies. Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
without vec_id. Rows with the same vec_id are rows of their own: each is a query, and each a candidate of the other. Vectors of
different lengths don't meet. Other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumispan.llm.common import materialize

CHUNK = 4096  # vectors of a chunk, about
QUERIES = 256  # queries of a block, about
STEP = 16  # dimensions of a column block
LIST = 1024  # vectors that a centroid is for
MOST_LISTS = 4096
MOST_SAMPLE = 40_000
AUDIT = 256
AIM, LEAST = 0.97, 0.9
DOUBT = 2.1  # of the test: larger abandons later

log = logging.getLogger(__name__)

def usable(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, v): vectors that take part, numbered, and scaled by a power of two each, which changes no cosine."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))
    scaled = rows.withColumn("top", F.array_max(F.transform("v", F.abs))).select("vec_id", F.transform("v", lambda x: x / F.pow(F.lit(2.0), F.floor(F.log2("top"))) + 0.0).alias("v"))
    return materialize(scaled.withColumn("row", F.monotonically_increasing_id()), "vectors")


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def rotation(width: int, seed: int = 12) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, width)))
    return q * np.sign(np.diag(r))


def _centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    rng = np.random.default_rng(5)
    c = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds if len(c) > 1 else 0):
        near = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        size = np.sqrt((total * total).sum(axis=1))
        c = np.where(size[:, None] > 1e-9, total / np.maximum(size, 1e-9)[:, None], c)
    return c


def _by_width(batch):
    """(width, rows, unit matrix, matrix) for each width in a batch with columns width and v."""
    widths = batch.column("width").to_numpy()
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        x = _matrix(batch.column("v").take(pa.array(at)))
        yield int(w), at, unit(x), x


class Lists:
    """Centroids of each width."""

    def __init__(self, nodes: DataFrame):
        counts = {r.width: r.n for r in nodes.groupBy("width").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").collect()}
        total = sum(counts.values())
        share = max(LIST, total / MOST_LISTS)
        sample = nodes.orderBy(F.xxhash64("node")).limit(MOST_SAMPLE).select("width", "v").toPandas()
        self.centroids = {int(w): _centroids(unit(np.array(part["v"].tolist())), max(1, round(counts[w] / share))) for w, part in sample.groupby("width")}
        for w in counts:
            self.centroids.setdefault(w, np.zeros((1, w)))  # rarer than the sample shows: one list

    def nearest(self, width: int, x: np.ndarray) -> np.ndarray:
        """Numbers of all lists for each row, nearest first."""
        return np.argsort(-(x @ self.centroids[width].T), axis=1, kind="stable")


def _dealt(nodes: DataFrame, lists: Lists) -> DataFrame:
    """(width, list, node, least, v): each node in its list."""
    held = nodes.sparkSession.sparkContext.broadcast(lists)  # at most MOST_LISTS centroids

    def run(batches):
        for batch in batches:
            for width, at, x, _ in _by_width(batch):
                take = pa.array(at)
                home = (x @ held.value.centroids[width].T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), width, np.int32)), pa.array(home.astype(np.int32)), *(batch.column(c).take(take) for c in ("node", "least", "v"))], names=["width", "list", "node", "least", "v"])

    return nodes.select("node", "least", "width", "v").mapInArrow(run, "width int, list int, node long, least long, v array<double>")


def _chunked(dealt: DataFrame, sizes: DataFrame) -> DataFrame:
    """(width, list, part, nodes, least, turned, original): chunks of about CHUNK vectors; ``turned`` has a matrix for each column block."""
    parts = dealt.join(F.broadcast(sizes), ["width", "list"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))

    def build(t: pa.Table) -> pa.Table:
        x = _matrix(t.column("v"))
        width = x.shape[1]
        turned = (unit(x) @ rotation(width)).astype(np.float32)
        blocks = [turned[:, i : i + STEP].T.tobytes() for i in range(0, width, STEP)]
        cell = lambda a: pa.array([a.tobytes()], pa.binary())
        names = {"nodes": "node", "least": "least"}
        return pa.table({"width": pa.array([width], pa.int32()), "list": t.column("list").slice(0, 1), "part": t.column("part").slice(0, 1), **{k: cell(t.column(c).to_numpy().astype(np.int64)) for k, c in names.items()}, "turned": pa.array([blocks], pa.list_(pa.binary())), "original": cell(x)})

    return parts.select("width", "list", "part", "node", "least", "v").groupBy("width", "list", "part").applyInArrow(build, "width int, list int, part int, nodes binary, least binary, turned array<binary>, original binary")


def _asked(queries: DataFrame, lists: Lists, sizes: DataFrame, first: int, last: int) -> DataFrame:
    """(width, list, part, nodes, bounds, asked): blocks of queries (node, width, v, bound) for their lists number ``first`` to ``last`` by nearness."""
    spark = queries.sparkSession
    held = spark.sparkContext.broadcast(lists)

    def run(batches):
        for batch in batches:
            for width, at, x, _ in _by_width(batch):
                order = held.value.nearest(width, x)[:, first:last]
                if not order.shape[1]:
                    continue
                take = pa.array(np.repeat(at, order.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column("width").take(take), pa.array(order.ravel().astype(np.int32)), *(batch.column(c).take(take) for c in ("node", "v", "bound"))], names=["width", "list", "node", "v", "bound"])

    dealt = queries.select("node", "width", "v", "bound").mapInArrow(run, "width int, list int, node long, v array<double>, bound double")
    asks = spark.createDataFrame(dealt.groupBy("width", "list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks")).collect(), "width int, list int, blocks int")  # a row for each list
    some = dealt.join(F.broadcast(sizes.join(asks, ["width", "list"])), ["width", "list"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))

    def build(t: pa.Table) -> pa.Table:
        x = _matrix(t.column("v"))
        cell = lambda a: pa.array([a.tobytes()], pa.binary())
        return pa.table({"width": pa.array([x.shape[1]], pa.int32()), "list": t.column("list").slice(0, 1), "parts": t.column("parts").slice(0, 1), "asked": cell(t.column("node").to_numpy().astype(np.int64)), "bounds": cell(t.column("bound").to_numpy().astype(np.float64)), "wanted": cell(x)})

    blocks = some.select("width", "list", "parts", "block", "node", "v", "bound").groupBy("width", "list", "block").applyInArrow(build, "width int, list int, parts int, asked binary, bounds binary, wanted binary")
    return blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def scan(q: np.ndarray, blocks: list[np.ndarray], bound: np.ndarray, k: int, doubt: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) that may be among the k nearest: those not abandoned, up to the k-th smallest squared distance.

    ``q`` holds turned unit vectors, ``blocks`` the chunk's column blocks (dimensions, vectors), ``bound`` a squared distance for
    each query which its k nearest do not exceed.
    """
    width, n = q.shape[1], blocks[0].shape[1]
    slack = 1e-5
    part = np.zeros((len(q), n), np.float32)
    alive = np.ones((len(q), n), bool)
    pairs = None
    seen = 0
    for b in blocks:
        mine = q[:, seen : seen + len(b)]
        seen += len(b)
        if pairs is None:
            part += (mine * mine).sum(axis=1, keepdims=True) + (b * b).sum(axis=0) - 2 * (mine @ b)
        else:
            i, j, d = pairs
            gap = mine[i] - b.T[j]
            pairs = (i, j, d + np.einsum("nd,nd->n", gap, gap))
        limit = bound + slack if seen == width else bound * (seen / width) * (1 + doubt / np.sqrt(seen)) ** 2 + slack
        if pairs is None:
            alive = part <= limit[:, None]
            if alive.mean() < 0.1:  # few are left: go on with those alone
                i, j = np.nonzero(alive)
                pairs = (i, j, part[i, j])
        else:
            i, j, d = pairs
            keep = d <= limit[i]
            pairs = (i[keep], j[keep], d[keep])
    if pairs is None:
        if n > k:
            alive &= part <= np.partition(part, k - 1, axis=1)[:, k - 1 : k] + slack
        i, j = np.nonzero(alive)
        pairs = (i, j, part[i, j])
    i, j, d = pairs
    # the k-th smallest of each query bounds what can matter
    order = np.lexsort((d, i))
    i, j, d = i[order], j[order], d[order]
    first = np.searchsorted(i, np.arange(len(q)))
    count = np.bincount(i, minlength=len(q))
    far = np.where(count >= k, d[np.minimum(first + k - 1, len(d) - 1)] if len(d) else 0.0, np.inf)
    keep = d <= far[i] + slack
    return i[keep], j[keep]


def _scanned(chunks: DataFrame, asked: DataFrame, k: int, doubt: float) -> DataFrame:
    """(q, node, least, score): the k best nodes of each query in each chunk."""

    def run(batches):
        turn: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, nodes, least, turned, original, asks, bounds, wanted in zip(*(batch.column(c) for c in ("width", "nodes", "least", "turned", "original", "asked", "bounds", "wanted")), strict=True):
                width = width.as_py()
                if width not in turn:
                    turn = {width: rotation(width)}
                names, first = np.frombuffer(nodes.as_buffer(), np.int64), np.frombuffer(least.as_buffer(), np.int64)
                x = np.frombuffer(original.as_buffer()).reshape(-1, width)
                blocks = [np.frombuffer(b.as_buffer(), np.float32).reshape(-1, len(names)) for b in turned.values]
                every, limit = np.frombuffer(asks.as_buffer(), np.int64), np.frombuffer(bounds.as_buffer())
                y = np.frombuffer(wanted.as_buffer()).reshape(-1, width)
                for at in range(0, len(y), QUERIES):
                    mine = y[at : at + QUERIES]
                    i, j = scan((unit(mine) @ turn[width]).astype(np.float32), blocks, limit[at : at + QUERIES], k, doubt)
                    score = cosine(mine[i], x[j])
                    order = np.lexsort((names[j], first[j], -score, i))
                    i, j, score = i[order], j[order], score[order]
                    rank = np.arange(len(i)) - np.searchsorted(i, i)
                    i, j, score = i[rank < k], j[rank < k], score[rank < k]
                    yield pa.RecordBatch.from_arrays([pa.array(every[at + i]), pa.array(names[j]), pa.array(first[j]), pa.array(score)], names=["q", "node", "least", "score"])

    both = chunks.join(asked, ["width", "list", "part"])
    return both.select("width", "nodes", "least", "turned", "original", "asked", "bounds", "wanted").mapInArrow(run, "q long, node long, least long, score double")


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision, summed in the order of components, so that equal rows have equal bits."""
    dot, one, two = (np.cumsum(x * y, axis=1)[:, -1] for x, y in ((a, b), (a, a), (b, b)))
    return np.clip(dot / np.sqrt(one * two), -1.0, 1.0)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best nodes of each query: the rank is cut before the shuffle as well as after it."""
    return found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "least", "node"))).where(F.col("rank") <= k)


def brute_force(asked: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(q, node, score, rank): the k nearest nodes of some queries (at most AUDIT rows), from all nodes."""
    wanted = {int(w): (part["node"].to_numpy(), np.array(part["v"].tolist())) for w, part in asked.select("node", "width", "v").toPandas().groupby("width")}
    held = nodes.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        for batch in batches:
            names, least = batch.column("node").to_numpy(), batch.column("least").to_numpy()
            for width, at, x, whole in _by_width(batch):
                if width not in held.value:
                    continue
                qs, y = held.value[width]
                s = unit(y) @ x.T
                m = min(k, len(at))
                top = np.argpartition(-s, m - 1, axis=1)[:, :m]
                i, j = np.repeat(np.arange(len(qs)), m), top.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(qs[i]), pa.array(names[at[j]]), pa.array(least[at[j]]), pa.array(cosine(y[i], whole[j]))], names=["q", "node", "least", "score"])

    return best(nodes.select("node", "least", "width", "v").mapInArrow(run, "q long, node long, least long, score double"), k)


def nearest_vectors(vectors: DataFrame, divisor: int = 50, k: int = 5, aim: float = AIM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of each row (vec_id, embedding) whose vec_id is divisible by ``divisor``."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    small = W.partitionBy("v").orderBy("vec_id", "row")
    held = materialize(rows.withColumn("copy", F.row_number().over(small)).where(F.col("copy") <= k + 1), "copies")
    heads = held.where("copy = 1").select(F.col("row").alias("node"), F.col("vec_id").alias("least"), F.size("v").alias("width"), "v")
    nodes = materialize(heads, "nodes")
    result = "query_id long, rank int, vec_id long, score double"
    if nodes.isEmpty():
        return spark.createDataFrame([], result)
    members = materialize(held.join(nodes.select("node", "v"), "v").select("node", "vec_id", "row"), "members")
    asking = materialize(rows.where(F.col("vec_id") % divisor == 0).join(nodes.select("node", "v"), "v").select("node", "vec_id", "row"), "asking")
    queries = nodes.join(asking.select("node").distinct(), "node", "left_semi").withColumn("bound", F.lit(float("inf"))).select("node", "width", "v", "bound")
    lists = Lists(nodes)
    dealt = _dealt(nodes, lists)
    sizes = spark.createDataFrame(dealt.groupBy("width", "list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts")).collect(), "width int, list int, parts int")  # a row for each list
    chunks = materialize(_chunked(dealt, sizes), "chunks")
    most = max(len(c) for c in lists.centroids.values())

    audit = materialize(queries.orderBy(F.xxhash64("node", F.lit(2)), "node").limit(AUDIT), "audit")
    truth = materialize(brute_force(audit, nodes, k + 1).where("q != node"), "truth")
    places = _places(truth, nodes, audit, lists)
    probes = min(most, 1 + int(np.ceil(np.quantile(places, aim)))) if len(places) else most

    near = best(_scanned(chunks, _asked(queries, lists, sizes, 0, 1), k + 1, DOUBT), k + 1)
    found = materialize(near, "found")
    if probes > 1:
        known = found.where(F.col("rank") == k + 1).select(F.col("q").alias("node"), F.greatest(F.lit(0.0), 2 - 2 * F.col("score")).alias("known"))
        bounded = queries.join(known, "node", "left").select("node", "width", "v", F.coalesce("known", "bound").alias("bound"))
        more = _scanned(chunks, _asked(bounded, lists, sizes, 1, probes), k + 1, DOUBT)
        found = materialize(best(found.drop("rank").unionByName(more), k + 1), "found")
    hits = truth.join(found, ["q", "node"], "left_semi").count()
    total = truth.count()
    recall = hits / max(1, total)
    log.info("%d of %d lists probed, recall %.4f of %d neighbours", probes, most, recall, total)
    if recall < LEAST:
        log.warning("recall %.4f is below %.2f: all lists are compared exactly", recall, LEAST)
        found = materialize(best(_scanned(chunks, _asked(queries, lists, sizes, 0, most), k + 1, np.inf), k + 1), "found")

    pairs = asking.select(F.col("node").alias("q"), F.col("vec_id").alias("query_id"), F.col("row").alias("own")).join(found.select("q", "node", "score"), "q").join(members, "node").where("row != own")
    order = W.partitionBy("query_id", "own").orderBy(F.desc("score"), "vec_id", "row")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _places(truth: DataFrame, nodes: DataFrame, audit: DataFrame, lists: Lists) -> np.ndarray:
    """For each true neighbour of the audited queries: which of the query's lists, by nearness, holds it."""
    vector = nodes.select("node", "width", "v")
    rows = truth.join(vector, "node").select("q", "width", "v").toPandas()  # at most AUDIT * (k + 1) rows
    asked = dict(audit.select("node", "v").toPandas().itertuples(index=False))
    out = []
    for width, part in rows.groupby("width"):
        c = lists.centroids[int(width)]
        home = (unit(np.array(part["v"].tolist())) @ c.T).argmax(axis=1)
        order = lists.nearest(int(width), unit(np.array([asked[q] for q in part["q"]])))
        out.append((order == home[:, None]).argmax(axis=1))
    return np.concatenate(out) if out else np.zeros(0)
