"""Queries on graphs, neighbourhoods, registration, files and edit logs, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lumispan.functions import derived as D
from lumispan.functions.lineage import cut
from lumispan.functions.quantiles import exact_quantiles
from lumispan.functions.store import scratch
from lumispan.functions.vectors import euler
from lumispan.operators import clouds as C
from lumispan.operators import features as E
from lumispan.operators import graphs as G
from lumispan.operators import morse as M
from lumispan.operators import register as R
from lumispan.operators import spatial as S
from lumispan.plans.clouds import rounded
from lumispan.sources import graphs as SG
from lumispan.sources import pcd as SP
from lumispan.streaming import keyed as K
from lumispan.streaming import session as L

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _d2(a: str, b: str) -> str:
    return " + ".join(f"(CAST({a}.{c} AS DOUBLE) - CAST({b}.{c} AS DOUBLE)) * (CAST({a}.{c} AS DOUBLE) - CAST({b}.{c} AS DOUBLE))" for c in "xyz")


CLEAN = f"(SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM {D.USER_EDGES} WHERE src <> dst)"
LOOPED = f"(SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM {D.USER_EDGES})"
DEGREES = f"(SELECT n.node_id, count(e.node_id) AS degree FROM {D.USER_NODES} n LEFT JOIN (SELECT src AS node_id FROM {LOOPED} UNION ALL SELECT dst FROM {LOOPED}) e ON e.node_id = n.node_id GROUP BY n.node_id)"
LENGTHS = f"(SELECT e.src, e.dst, sqrt({_d2('a', 'b')}) AS length FROM (SELECT DISTINCT src, dst FROM {D.TRADE_EDGES}) e JOIN {D.TRADE_NODES} a ON a.node_id = e.src JOIN {D.TRADE_NODES} b ON b.node_id = e.dst)"
NEAR = f"(SELECT a.point_id AS q, b.point_id AS p, {_d2('a', 'b')} AS d2, row_number() OVER (PARTITION BY a.point_id ORDER BY {_d2('a', 'b')}, b.point_id) AS rank FROM {D.CLOUD_EMB} a JOIN {D.CLOUD_EMB} b ON a.point_id <> b.point_id)"
KNN = f"(SELECT least(q, p) AS a, greatest(q, p) AS b, sqrt(min(d2)) AS d FROM {NEAR} WHERE rank <= 4 GROUP BY 1, 2)"
WITHIN = f"(SELECT a.point_id AS q, b.point_id AS p, {_d2('a', 'b')} AS d2 FROM {D.CLOUD_EMB} a, {D.CLOUD_EMB} b WHERE {_d2('a', 'b')} <= 0.04::DOUBLE)"
CROSS = f"(SELECT q.point_id AS q, p.point_id AS p, {_d2('q', 'p')} AS d2 FROM {D.CLOUD_EMB} q, {D.CLOUD_EMB} p WHERE q.selected AND NOT p.selected)"


def _nodes(s, d):
    return D.cloud_emb(s, d).select(F.col("point_id").alias("node_id"), "x", "y", "z")


def _sides(s, d):
    emb = D.cloud_emb(s, d)
    return emb.where("selected").withColumnRenamed("point_id", "q"), emb.where("NOT selected").withColumnRenamed("point_id", "p")


@query("graph_clean", f"SELECT src, dst FROM {CLEAN}")
def graph_clean(s, d):
    return G.undirected(D.user_edges(s, d))


@query("degree_hist", f"SELECT degree, count(*) AS n_nodes FROM {DEGREES} GROUP BY degree")
def degree_hist(s, d):
    return G.degree_histogram(D.user_nodes(s, d), D.user_edges(s, d))


@query("select_degree", f"SELECT node_id FROM {DEGREES} WHERE degree = 10")
def select_degree(s, d):
    return G.select_by_degree(D.user_nodes(s, d), D.user_edges(s, d), 10)


@query("graph_union", f"WITH t AS (SELECT max(node_id) + 1 AS top FROM {D.TRADE_NODES}) SELECT src, dst, count(*) AS n FROM (SELECT src, dst FROM {D.TRADE_EDGES} UNION ALL SELECT src + top, dst + top FROM {D.USER_EDGES}, t) GROUP BY src, dst")
def graph_union(s, d):
    none = [F.lit(0.0).cast("float").alias(c) for c in "xyz"]
    _, edges = G.union(D.trade_nodes(s, d), D.trade_edges(s, d), D.user_nodes(s, d).select("node_id", *none), D.user_edges(s, d))
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n"))


_KEEP = f"(SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS new_id FROM {D.USER_NODES} WHERE node_id % 3 <> 0)"


@query("induced_subgraph", f"SELECT a.new_id AS src, b.new_id AS dst, count(*) AS n FROM {D.USER_EDGES} e JOIN {_KEEP} a ON a.node_id = e.src JOIN {_KEEP} b ON b.node_id = e.dst GROUP BY 1, 2")
def induced_subgraph(s, d):
    nodes = D.user_nodes(s, d).withColumns({c: F.lit(0.0) for c in "xyz"})
    return G.induced(nodes, D.user_edges(s, d), nodes.where("node_id % 3 != 0"))[1].groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("id_compaction", f"SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS new_id FROM {D.TRADE_NODES}")
def id_compaction(s, d):
    return G.compact_ids(D.trade_nodes(s, d))


@query("weight_order", "SELECT c_custkey AS node_id, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS new_id FROM customer")
def weight_order(s, d):
    c = D.table(s, d, "customer").select(F.struct("c_acctbal", "c_custkey").alias("node_id"))
    return G.compact_ids(c).select(F.col("node_id.c_custkey").alias("node_id"), "new_id")


@query("edge_lengths", f"SELECT src, dst, round(length, 4) AS length FROM {LENGTHS}")
def edge_lengths(s, d):
    return rounded(G.edge_lengths(D.trade_nodes(s, d), D.trade_edges(s, d).distinct()))


@query("median_edge", f"SELECT round(quantile_cont(length, 0.5), 4) AS median, count(*) AS n FROM {LENGTHS}")
def median_edge(s, d):
    lengths = cut(G.edge_lengths(D.trade_nodes(s, d), D.trade_edges(s, d).distinct()).select("length"))
    return rounded(lengths.agg(F.lit(exact_quantiles(lengths, "length", [0.5])[0]).cast("double").alias("median"), F.count("*").alias("n")))


@query("edge_p75", f"WITH l AS {LENGTHS}, p AS (SELECT quantile_cont(length, 0.75) AS p FROM l) SELECT src, dst FROM l, p WHERE length <= p + 1e-9")
def edge_p75(s, d):
    lengths = cut(G.edge_lengths(D.trade_nodes(s, d), D.trade_edges(s, d).distinct()))
    return lengths.where(F.col("length") <= F.lit(exact_quantiles(lengths, "length", [0.75])[0]).cast("double") + 1e-9).select("src", "dst")


@query("length_quantiles", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT {q} AS share, round(quantile_cont(length, {q}), 4) AS length FROM {LENGTHS}" for q in (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)) + ")")
def length_quantiles(s, d):
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    found = exact_quantiles(G.edge_lengths(D.trade_nodes(s, d), D.trade_edges(s, d).distinct()), "length", shares)
    return rounded(s.createDataFrame(list(zip(shares, found, strict=True)), "share double, length double"))


@query("knn_edges", f"SELECT a, b, round(d, 6) AS d FROM {KNN}")
def knn_edges(s, d):
    return rounded(S.knn_edges(_nodes(s, d), 4), 6)


@query("knn_directed", f"SELECT q, p, CAST(rank AS INT) AS rank FROM {NEAR} WHERE rank <= 8")
def knn_directed(s, d):
    emb = D.cloud_emb(s, d)
    return S.knn_join(emb.withColumnRenamed("point_id", "q"), emb.withColumnRenamed("point_id", "p"), 8, self_join=True).select("q", "p", "rank")


@query("nearest_join", f"SELECT q, p, round(d2, 6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, p) AS rank FROM {CROSS}) WHERE rank = 1")
def nearest_join(s, d):
    q, p = _sides(s, d)
    return rounded(S.nearest_join(q, p), 6)


@query("range_join", f"SELECT q, p FROM {WITHIN}")
def range_join(s, d):
    emb = D.cloud_emb(s, d)
    return S.range_join(emb.withColumnRenamed("point_id", "q"), emb.withColumnRenamed("point_id", "p"), 0.2).select("q", "p")


@query("hybrid_search", f"SELECT q, p FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, p) AS rank FROM {WITHIN}) WHERE rank <= 5")
def hybrid_search(s, d):
    return E.neighbours(D.cloud_emb(s, d), 0.2, 5).select("q", "p")


@query("min_safe_beta", f"SELECT round(2 * avg(sqrt(d2)), 6) AS beta FROM {NEAR} WHERE rank = 1")
def min_safe_beta(s, d):
    return s.createDataFrame([(round(R.safe_beta(D.cloud_emb(s, d)), 6),)], "beta double")


@query("density_eps", f"SELECT round(8 * quantile_cont(sqrt(d2), 0.5), 6) AS eps FROM {NEAR} WHERE rank = 1")
def density_eps(s, d):
    return s.createDataFrame([(round(E.density_eps(D.cloud_emb(s, d)), 6),)], "eps double")


@query("bridge_edges", f"WITH e AS (SELECT point_id AS node_id, x, y, z FROM {D.CLOUD_EMB} WHERE selected), l AS (SELECT quantile_cont(sqrt({_d2('a', 'b')}), 0.5) AS m FROM e a JOIN e b ON b.node_id = a.node_id + 3), t AS (SELECT max(node_id) + 1 AS top FROM e) SELECT p AS src, q + top AS dst FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, p) AS rank FROM (SELECT q.point_id AS q, p.node_id AS p, {_d2('q', 'p')} AS d2 FROM {D.CLOUD_EMB} q, e p WHERE NOT q.selected)), l, t WHERE rank = 1 AND sqrt(d2) <= 0.2 * m")
def bridge_edges(s, d):
    emb = D.cloud_emb(s, d)
    n1, n2 = (emb.where(w).select(F.col("point_id").alias("node_id"), "x", "y", "z") for w in ("selected", "NOT selected"))
    last = n1.agg(F.max("node_id")).first()[0]
    chain = n1.where(F.col("node_id") < last).select(F.col("node_id").alias("src"), (F.col("node_id") + 3).alias("dst"))
    none = chain.limit(0)
    return G.union_with_bridges(n1, chain, n2, none, 0.2)[1].where(F.col("dst") > last).select("src", "dst")


@query("delete_cascade", f"WITH n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, p) AS rank FROM (SELECT q.point_id AS q, p.point_id AS p, {_d2('q', 'p')} AS d2 FROM {D.CLOUD_EMB} q, {D.CLOUD_EMB} p WHERE q.selected AND p.alive)) SELECT q AS node_id FROM n WHERE rank = 1 AND p % 2 <> 0")
def delete_cascade(s, d):
    emb = D.cloud_emb(s, d)
    nodes = emb.where("selected").select(F.col("point_id").alias("node_id"), "x", "y", "z")
    return G.surviving(nodes, emb, emb.where("point_id % 2 = 0"))


_WEB = f"(SELECT point_id AS node_id, x, y, z FROM {D.CLOUD_EMB} WHERE selected)"
_LEFT = f"(SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS new_id FROM (SELECT q AS node_id FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, p) AS rank FROM (SELECT q.point_id AS q, p.point_id AS p, {_d2('q', 'p')} AS d2 FROM {D.CLOUD_EMB} q, {D.CLOUD_EMB} p WHERE q.selected AND p.alive)) WHERE rank = 1 AND p % 2 <> 0))"


@query("cascaded_edges", f"SELECT a.new_id AS src, b.new_id AS dst FROM (SELECT node_id AS src, node_id + 3 AS dst FROM {_WEB}) e JOIN {_LEFT} a ON a.node_id = e.src JOIN {_LEFT} b ON b.node_id = e.dst")
def cascaded_edges(s, d):
    emb = D.cloud_emb(s, d)
    nodes = emb.where("selected").select(F.col("point_id").alias("node_id"), "x", "y", "z")
    chain = nodes.select(F.col("node_id").alias("src"), (F.col("node_id") + 3).alias("dst"))
    return G.delete_cascade(nodes, chain, emb, emb.where("point_id % 2 = 0"))[1]


_RIPS = f"(WITH n AS {NEAR}, f AS (SELECT q AS v, sqrt(sum(d2) / (count(*) + 1)) AS f FROM n WHERE rank <= 15 GROUP BY q), e AS (SELECT least(q, p) AS u, greatest(q, p) AS w, sqrt(min(d2)) AS d FROM n WHERE rank <= 15 GROUP BY 1, 2) SELECT e.u, e.w, CASE WHEN d <= abs(a.f - b.f) THEN greatest(a.f, b.f) ELSE greatest(a.f, b.f, (a.f + b.f + d) / 2) END AS value FROM e JOIN f a ON a.v = e.u JOIN f b ON b.v = e.w)"


@query("rips_edges", f"SELECT u, w, round(value, 6) AS value FROM {_RIPS}")
def rips_edges(s, d):
    return rounded(M.weighted_rips(_nodes(s, d))[1].select("u", "w", "value"), 6)


@query("rips_triangles", f"WITH e AS MATERIALIZED {_RIPS} SELECT a.u AS first, count(*) AS n FROM e a JOIN e b ON b.u = a.u AND a.w < b.w JOIN e c ON c.u = a.w AND c.w = b.w GROUP BY a.u")
def rips_triangles(s, d):
    _, edges, triangles = M.weighted_rips(_nodes(s, d))
    last = edges.select(*[F.col(c).alias("e" + c) for c in ("rank", "u", "w")])
    corner = triangles.withColumn("t", F.monotonically_increasing_id()).select("t", F.explode(F.array("r1", "r2", "r3")).alias("erank")).join(last, "erank").groupBy("t").agg(F.min("eu").alias("first"))
    return corner.groupBy("first").agg(F.count("*").alias("n"))


@query("edge_persistence")
def edge_persistence(s, d):
    return rounded(M.persistence(*M.weighted_rips(_nodes(s, d))), 6)


@query("morse_skeleton")
def morse_skeleton(s, d):
    nodes, edges = M.reconstruct_skeleton(_nodes(s, d), threshold=0.02, tau=3.0, reach=0.05)
    return rounded(G.edge_lengths(nodes, edges), 6)


@query("grow_skeleton")
def grow_skeleton(s, d):
    return rounded(E.grow_skeleton(D.cloud_part(s, d).where("alive"), radius=4.0, size=0.5, iterations=10, rounds=3), 4)


@query("align_turned")
def align_turned(s, d):
    cloud = D.cloud_part(s, d).where("alive").select("point_id", "x", "y", "z")
    found = R.align(C.transform(cloud, euler(30.0, -20.0, 10.0, 90, 0, 0)), cloud, probe=4, steps=10)
    return s.createDataFrame([(i, *map(float, row)) for i, row in enumerate(np.round(found["matrix"], 1) + 0.0)], "row int, c0 double, c1 double, c2 double, c3 double")


@query("sweep_turned")
def sweep_turned(s, d):
    cloud = D.cloud_part(s, d).select("point_id", "x", "y", "z")
    found = R.sweep_align(C.transform(cloud, euler(5.0, -3.0, 2.0, 40, 0, 0)), cloud, voxel=2.0, probe=10, steps=30)
    return s.createDataFrame([(round(found["fitness"], 3), found["n"])], "fitness double, n long")


@query("feature_best_pair", "SELECT p, s, round(d, 6) AS d FROM (SELECT a.vec_id AS p, b.vec_id AS s, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d FROM embeddings a, embeddings b WHERE a.label = 0 AND b.label = 1 ORDER BY d, p, s LIMIT 1)")
def feature_best_pair(s, d):
    e = D.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("f"), "label")
    return rounded(R.best_feature_pair(e.where("label = 0"), e.where("label = 1")), 6)


@query("connected_components")
def connected_components(s, d):
    return G.connected_components(D.user_nodes(s, d), D.user_edges(s, d))


@query("msf_small", "WITH RECURSIVE n AS (SELECT n_nationkey AS id, CAST(n_nationkey % 5 AS DOUBLE) * 1.5 AS x, CAST(n_nationkey * 7 % 11 AS DOUBLE) AS y, CAST(n_regionkey AS DOUBLE) AS z FROM nation), e AS MATERIALIZED (SELECT a.id AS a, b.id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM n a JOIN n b ON a.id < b.id), o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY d, a, b) AS k FROM e), w AS MATERIALIZED (SELECT a, b, k FROM o UNION ALL SELECT b, a, k FROM o), r AS (SELECT k, a AS at FROM o UNION SELECT r.k, w.b FROM r JOIN w ON w.a = r.at AND w.k < r.k) SELECT o.a, o.b, round(o.d, 6) AS d FROM o WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.k = o.k AND r.at = o.b)")
def msf_small(s, d):
    n = D.table(s, d, "nation").select(F.col("n_nationkey").alias("id"), ((F.col("n_nationkey") % 5).cast("double") * 1.5).alias("x"), (F.col("n_nationkey") * 7 % 11).cast("double").alias("y"), F.col("n_regionkey").cast("double").alias("z"))
    a, b = n.alias("a"), n.alias("b")
    at = lambda t: [F.col(f"{t}.{c}") for c in "xyz"]
    from lumispan.functions.vectors import dist2

    edges = a.join(b, F.col("a.id") < F.col("b.id")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.sqrt(dist2(at("a"), at("b"))).alias("d"))
    return rounded(G.minimum_forest(n.select(F.col("id").alias("node_id")), edges), 6)


@query("skeleton")
def skeleton(s, d):
    nodes, edges = G.skeleton(D.cloud_part(s, d), prune=0.9)
    return rounded(G.edge_lengths(nodes, edges))


@query("prune")
def prune(s, d):
    nodes = _nodes(s, d)
    forest = G.minimum_forest(nodes, S.knn_edges(nodes, 4))
    return G.prune_leaves(nodes, forest.select(F.col("a").alias("src"), F.col("b").alias("dst")), 0.05)[1]


@query("reextract")
def reextract(s, d):
    nodes = _nodes(s, d)
    edges = S.knn_edges(nodes, 3).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return G.reconnect(nodes, edges, nodes.where("node_id % 2 = 0"))


_PAIR = f"(SELECT CAST(a.x AS DOUBLE) AS sx, CAST(a.y AS DOUBLE) AS sy, CAST(a.z AS DOUBLE) AS sz, CAST(a.r AS DOUBLE) AS tx, CAST(a.g AS DOUBLE) AS ty, CAST(a.b AS DOUBLE) AS tz FROM {D.CLOUD_EMB} a)"
_H = ", ".join(f"round(covar_pop(s{i}, t{j}) * count(*), 4) AS h{i}{j}" for i in "xyz" for j in "xyz")


@query("kabsch_h", f"SELECT count(*) AS n, round(avg(sx), 4) AS msx, round(avg(sy), 4) AS msy, round(avg(sz), 4) AS msz, round(avg(tx), 4) AS mtx, round(avg(ty), 4) AS mty, round(avg(tz), 4) AS mtz, {_H} FROM {_PAIR}")
def kabsch_h(s, d):
    emb = D.cloud_emb(s, d)
    names = dict(zip("xyzrgb", ["sx", "sy", "sz", "tx", "ty", "tz"], strict=True))
    return rounded(R.cross_covariance(emb.select(*[F.col(a).alias(b) for a, b in names.items()])))


@query("icp_step", f"WITH n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, p) AS rank FROM {CROSS}), m AS (SELECT sqrt(d2) AS d FROM n WHERE rank = 1), t AS (SELECT avg(d) + stddev_pop(d) AS thr FROM m) SELECT count(*) AS n, round(avg(d), 6) AS mean_inlier_dist FROM m, t WHERE d < thr")
def icp_step(s, d):
    emb = D.cloud_emb(s, d)
    pairs = R.matched(emb.where("selected"), emb.where("NOT selected"), np.eye(4))
    bound = pairs.agg((F.avg("d") + F.stddev_pop("d")).alias("thr"))
    return rounded(pairs.join(F.broadcast(bound)).where("d < thr").agg(F.count("*").alias("n"), F.avg("d").alias("mean_inlier_dist")), 6)  # one row


@query("icp_known_transform")
def icp_known_transform(s, d):
    cloud = D.cloud_emb(s, d).select("point_id", "x", "y", "z")
    found = R.icp(C.transform(cloud, np.linalg.inv(euler(0.02, -0.01, 0.015, 4, 2, -3))), cloud, steps=20)
    return s.createDataFrame([(i, *map(float, row)) for i, row in enumerate(np.round(found["matrix"], 4))], "row int, c0 double, c1 double, c2 double, c3 double")


@query("dbscan_core", f"SELECT q AS point_id FROM {WITHIN} GROUP BY q HAVING count(*) >= 5")
def dbscan_core(s, d):
    return E.dbscan(D.cloud_emb(s, d), 0.2).where("core").select("point_id")


@query("dbscan", f"WITH RECURSIVE w AS MATERIALIZED {WITHIN}, c AS MATERIALIZED (SELECT q FROM w GROUP BY q HAVING count(*) >= 5), l AS MATERIALIZED (SELECT w.q, w.p FROM w JOIN c a ON a.q = w.q JOIN c b ON b.q = w.p), r AS (SELECT q, q AS k FROM c UNION SELECT l.p, r.k FROM r JOIN l ON l.q = r.q), m AS (SELECT q, min(k) AS label FROM r GROUP BY q) SELECT e.point_id, CAST(coalesce(o.label, (SELECT min(m.label) FROM w JOIN m ON m.q = w.p WHERE w.q = e.point_id), -1) AS BIGINT) AS label FROM {D.CLOUD_EMB} e LEFT JOIN m o ON o.q = e.point_id")
def dbscan(s, d):
    return E.dbscan(D.cloud_emb(s, d), 0.2).select("point_id", F.col("label").cast("long").alias("label"))


_COV = ", ".join(f"round(covar_pop(CAST(c.{i} AS DOUBLE), CAST(c.{j} AS DOUBLE)), 6) + 0.0 AS c{i}{j}" for i, j in ("xx", "xy", "xz", "yy", "yz", "zz"))


@query("local_cov", f"SELECT w.q, count(*) AS n, {_COV} FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, p) AS rank FROM {WITHIN}) w JOIN {D.CLOUD_EMB} c ON c.point_id = w.p WHERE rank <= 30 GROUP BY w.q")
def local_cov(s, d):
    emb = D.cloud_emb(s, d)
    return rounded(E.covariances(emb, E.neighbours(emb, 0.2, 30)).drop("mx", "my", "mz"), 6)


@query("principal_axes")
def principal_axes(s, d):
    emb = D.cloud_emb(s, d)
    return rounded(E.principal_axes(E.covariances(emb, E.neighbours(emb, 0.2, 30))).select("q", "l1", "l2", "l3"), 6)


@query("contract_1", f"SELECT a.point_id, round(CAST(a.x AS DOUBLE) + 0.4 * (avg(CAST(c.x AS DOUBLE)) - CAST(a.x AS DOUBLE)), 6) AS x, round(CAST(a.y AS DOUBLE) + 0.4 * (avg(CAST(c.y AS DOUBLE)) - CAST(a.y AS DOUBLE)), 6) AS y, round(CAST(a.z AS DOUBLE) + 0.4 * (avg(CAST(c.z AS DOUBLE)) - CAST(a.z AS DOUBLE)), 6) AS z FROM {NEAR} n JOIN {D.CLOUD_EMB} a ON a.point_id = n.q JOIN {D.CLOUD_EMB} c ON c.point_id = n.p WHERE n.rank <= 7 GROUP BY a.point_id, a.x, a.y, a.z")
def contract_1(s, d):
    emb = D.cloud_emb(s, d)
    near = S.knn_join(emb.withColumnRenamed("point_id", "q"), emb.withColumnRenamed("point_id", "p"), 7, self_join=True)
    return rounded(E.contract(emb, near, steps=1), 6)


@query("fps_small", f"WITH RECURSIVE c AS MATERIALIZED (SELECT point_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM {D.CLOUD_EMB}), f AS (SELECT 1 AS turn, [min(point_id)] AS ids FROM c UNION ALL SELECT turn + 1, list_append(ids, (SELECT t.point_id FROM (SELECT a.point_id, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS m FROM c a JOIN c b ON list_contains(f.ids, b.point_id) GROUP BY a.point_id) t ORDER BY t.m DESC, t.point_id LIMIT 1)) FROM f WHERE turn < 8) SELECT turn, ids[turn] AS point_id FROM f")
def fps_small(s, d):
    return E.farthest_points(D.cloud_emb(s, d), 8).select("turn", "point_id")


CONTROL, WEIGHTS = np.array([[0.1, 0.0, -0.1], [-0.2, 0.1, 0.0], [0.0, -0.15, 0.2]]), np.array([[0.05, 0.0, 0.01], [0.0, -0.03, 0.02], [0.04, 0.01, 0.0]])


def _kernel(c: int) -> str:
    return " + ".join(f"exp(-((x - ({y[0]})) * (x - ({y[0]})) + (y - ({y[1]})) * (y - ({y[1]})) + (z - ({y[2]})) * (z - ({y[2]}))) / 0.18) * ({w[c]})" for y, w in zip(CONTROL, WEIGHTS, strict=True))


@query("kernel_warp", f"SELECT point_id, round(x + {_kernel(0)}, 6) AS x, round(y + {_kernel(1)}, 6) AS y, round(z + {_kernel(2)}, 6) AS z FROM (SELECT point_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM {D.CLOUD_EMB})")
def kernel_warp(s, d):
    return rounded(R.kernel_warp(D.cloud_emb(s, d).select("point_id", "x", "y", "z"), CONTROL, WEIGHTS, 0.3), 6)


@query("beta_schedule", "SELECT * FROM (VALUES (0, 60.0::DOUBLE), (1, 15.0::DOUBLE), (2, 10.0::DOUBLE)) t(stage, beta)")
def beta_schedule(s, d):
    return s.createDataFrame(list(enumerate(R.beta_schedule([60.0, 15.0, 5.0, 2.0], 10.0))), "stage int, beta double")


@query("tps_warp")
def tps_warp(s, d):
    cloud = D.cloud_emb(s, d).select("point_id", "x", "y", "z")
    a = np.array(cloud.orderBy("point_id").limit(6).select("x", "y", "z").toPandas(), float)
    return rounded(R.plate_warp(cloud, a, a + [0.1, 0.0, -0.05], pins=20), 4)


@query("cpd_warp")
def cpd_warp(s, d):
    cloud = D.cloud_emb(s, d).select("point_id", "x", "y", "z")
    return rounded(R.coherent_drift(cloud, C.transform(cloud, euler(0.05, 0.02, 0, 3, 0, 0)), (0.5, 0.3), alpha=0.1, steps=20)[1], 3)


@query("tensor_vote")
def tensor_vote(s, d):
    k = F.col("p_partkey")
    line = D.table(s, d, "part").select(k.alias("point_id"), (k / 50).alias("x"), F.lit(0.0).alias("y"), (k % 3 / 20.0).alias("z"))
    return rounded(E.vote(line, 0.4, 3, 0.1), 3)


@query("point_features")
def point_features(s, d):
    f = E.point_features(D.cloud_emb(s, d), 0.2, 0.3)
    return f.select("id", F.size("f").alias("n_bins"), F.round(F.aggregate("f", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query("recon_marker_filter", "SELECT event_id % 100 AS src, user_id AS dst, CAST(event_id % 4 - 1 AS BIGINT) AS marker FROM events WHERE event_id % 4 - 1 IN (-1, 1) UNION ALL SELECT event_id, user_id, 2 FROM events WHERE event_type = 'purchase' UNION ALL SELECT user_id, event_id, 2 FROM events WHERE event_type = 'view'")
def recon_marker_filter(s, d):
    e = D.table(s, d, "events")
    base = e.select((F.col("event_id") % 100).alias("src"), F.col("user_id").alias("dst"), (F.col("event_id") % 4 - 1).alias("marker"))
    good, back = (e.where(F.col("event_type") == t).select(F.col(a).alias("src"), F.col(b).alias("dst")) for t, a, b in (("purchase", "event_id", "user_id"), ("view", "user_id", "event_id")))
    return SG.recon_edges(base, good, back)


_NAMES = "(SELECT CASE WHEN event_id % 3 = 0 THEN 'misc' || event_id || '.pcd' ELSE 'tangle' || (event_id % 7) || ' rest p' || user_id || ' T0.' || (event_id % 9) || '.pcd' END AS name FROM events)"


def _names(s, d):
    i, u = F.col("event_id"), F.col("user_id")
    return D.table(s, d, "events").select(F.when(i % 3 == 0, F.concat(F.lit("misc"), i, F.lit(".pcd"))).otherwise(F.concat(F.lit("tangle"), i % 7, F.lit(" rest p"), u, F.lit(" T0."), i % 9, F.lit(".pcd"))).alias("name"))


@query("catalog_regex", f"SELECT regexp_extract(name, '(?i)^(tangle\\w+)\\s+(.+?)\\s+T([0-9.]+)\\.pcd$', 1) AS series, regexp_extract(name, '(?i)^(tangle\\w+)\\s+(.+?)\\s+T([0-9.]+)\\.pcd$', 2) AS session, CAST(regexp_extract(name, '(?i)^(tangle\\w+)\\s+(.+?)\\s+T([0-9.]+)\\.pcd$', 3) AS DOUBLE) AS threshold, count(*) AS n FROM {_NAMES} WHERE name LIKE 'tangle%' GROUP BY 1, 2, 3")
def catalog_regex(s, d):
    return SG.structured_catalog(_names(s, d), F.col("name")).groupBy("series", "session", F.col("threshold").cast("double").alias("threshold")).agg(F.count("*").alias("n"))


@query("catalog_filter", f"SELECT count(*) AS n FROM {_NAMES} WHERE lower(split_part(name, ' ', 1)) LIKE '%gle3%'")
def catalog_filter(s, d):
    return SG.filter_series(SG.structured_catalog(_names(s, d), F.col("name")), "GLE3").agg(F.count("*").alias("n"))


@query("catalog_flat", f"SELECT replace(name, '.pcd', '') AS stem, count(*) AS n FROM {_NAMES} WHERE name LIKE 'misc%' GROUP BY 1")
def catalog_flat(s, d):
    names = _names(s, d).where("name LIKE 'misc%'")
    return SG.flat_catalog(names, F.col("name")).groupBy("stem").agg(F.count("*").alias("n"))


@query("pcd_roundtrip", f"SELECT x, y, z, round(trunc(CAST(r AS DOUBLE) * 255) / 255, 4) AS r FROM {D.CLOUD_ORD} WHERE alive")
def pcd_roundtrip(s, d):
    back = SP.read_pcd(s, SP.write_pcd(D.cloud_ord(s, d), scratch(s, "cloud.pcd")))
    return rounded(back.select("x", "y", "z", "r"), 4, "r")


@query("ply_roundtrip", f"SELECT x, y, z, CAST(trunc(CAST(g AS DOUBLE) * 255) AS INT) AS green FROM {D.CLOUD_ORD} WHERE alive")
def ply_roundtrip(s, d):
    return SP.read_ply(s, SP.write_ply(D.cloud_ord(s, d), scratch(s, "cloud.ply"))).select("x", "y", "z", "green")


@query("graph_json_roundtrip", f"SELECT src, dst FROM {CLEAN}")
def graph_json_roundtrip(s, d):
    nodes = D.user_nodes(s, d).select("node_id", *[(F.col("node_id") * k).cast("float").alias(c) for c, k in (("x", 1), ("y", 2), ("z", 3))])
    return SG.read_graph_json(s, SG.write_graph_json(nodes, G.undirected(D.user_edges(s, d)), scratch(s, "graph.json")))[1]


@query("catalog_ordered", f"SELECT regexp_extract(name, '(?i)^(tangle\\w+)\\s+(.+?)\\s+T([0-9.]+)\\.pcd$', 1) AS series, min(TRY_CAST(regexp_extract(name, '(?i)^(tangle\\w+)\\s+(.+?)\\s+T([0-9.]+)\\.pcd$', 3) AS DOUBLE)) AS lowest FROM {_NAMES} WHERE regexp_matches(name, '(?i)^(tangle\\w+)\\s+(.+?)\\s+T([0-9.]+)\\.pcd$') GROUP BY 1")
def catalog_ordered(s, d):
    found = SG.ordered_catalog(SG.structured_catalog(_names(s, d), F.col("name")))
    return found.groupBy("series").agg(F.min("value").alias("lowest"))


@query("recon_convert", f"SELECT src, dst FROM {CLEAN}")
def recon_convert(s, d):
    nodes = D.user_nodes(s, d).select(F.format_string("%d %d %d", "node_id", "node_id", "node_id"))
    edges = G.undirected(D.user_edges(s, d)).select(F.format_string("%d %d 1", "src", "dst"))
    n, e = scratch(s, "nodes"), scratch(s, "edges")
    nodes.coalesce(1).write.text(n)  # the format has one file each
    edges.coalesce(1).write.text(e)
    return SG.read_graph_json(s, SG.convert_recon(s, n, e, scratch(s, "graph.json")))[1]


@query("text_sink", f"SELECT printf('%.6f %.6f %.6f', CAST(x AS DOUBLE), CAST(y AS DOUBLE), CAST(z AS DOUBLE)) AS value FROM {D.CLOUD_ORD}")
def text_sink(s, d):
    return s.read.text(SG.write_points_text(D.cloud_ord(s, d), scratch(s, "points")))


@query("history_last20", "SELECT user_id AS log_id, event_id AS seq, age FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS INT) AS age FROM events) WHERE age <= 20")
def history_last20(s, d):
    log = D.table(s, d, "events").select(F.col("user_id").alias("log_id"), F.col("event_id").alias("seq"))
    return L.recent(log, F.col("seq"))


def edit_log(s, d):
    kind = F.when(F.col("event_id") % 4 == 1, "undo").when(F.col("event_id") % 9 == 2, "redo").otherwise("edit")
    return D.table(s, d, "events").select(F.col("user_id").alias("log_id"), F.col("event_id").alias("seq"), kind.alias("kind"))


# a step of every log at once: the edits that can be undone and redone as lists
EDITS = """WITH RECURSIVE e AS (SELECT user_id, event_id, CASE WHEN event_id % 4 = 1 THEN 'undo' WHEN event_id % 9 = 2 THEN 'redo' ELSE 'edit' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
t(user_id, n, done, undone, fixed) AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST(0 AS BIGINT) FROM e
  UNION ALL
  SELECT t.user_id, e.n,
    CASE WHEN kind = 'undo' THEN done[:-2] WHEN kind = 'redo' THEN CASE WHEN len(undone) > 0 THEN list_append(done, undone[-1]) ELSE done END ELSE list_append(CASE WHEN len(done) = 20 THEN done[2:] ELSE done END, event_id) END,
    CASE WHEN kind = 'undo' THEN CASE WHEN len(done) > 0 THEN list_append(undone, done[-1]) ELSE undone END WHEN kind = 'redo' THEN undone[:-2] ELSE CAST([] AS BIGINT[]) END,
    fixed + CASE WHEN kind = 'edit' AND len(done) = 20 THEN 1 ELSE 0 END
  FROM t JOIN e ON e.user_id = t.user_id AND e.n = t.n + 1)
SELECT user_id AS log_id, fixed + len(done) AS applied, CAST(len(undone) AS BIGINT) AS redoable{more} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) AS back FROM t) WHERE back = 1"""


@query("undo_replay", EDITS.format(more=""))
def undo_replay(s, d):
    return L.replay(edit_log(s, d))


@query("undo_stream", EDITS.format(more=", CAST(0 AS BIGINT) AS late, (SELECT max(event_id) FROM events x WHERE x.user_id = user_id_of.user_id) AS last_seq").replace(") WHERE back = 1", ") user_id_of WHERE back = 1"))
def undo_stream(s, d):
    return K.replay(edit_log(s, d))


def camera_log(s, d):
    i, of = F.col("event_id"), F.array(*[F.lit(k) for k in ("w", "s", "a", "d", "space", "shift")])
    kind = F.when(i % 97 == 0, "blur").when(i % 6 == 0, "down").when(i % 12 == 1, "up").when(i % 6 == 2, "look").otherwise("tick")
    return D.table(s, d, "events").select(F.col("user_id").alias("log_id"), i.alias("seq"), kind.alias("kind"), F.get(of, (F.floor(i / 6) % 6).cast("int")).alias("key"), F.when(kind == "tick", (i % 13) / 200.0).otherwise(F.col("value")).alias("a"), (i % 400 - 150).cast("double").alias("b"))


@query("camera_stream")
def camera_stream(s, d):
    return rounded(K.cameras(camera_log(s, d)), 6)


def click_log(s, d):
    i = F.col("event_id")
    kind = F.when(i % 7 == 0, "miss").when(F.floor(i / 3) % 2 == 0, "primary").otherwise("secondary")
    return D.table(s, d, "events").select(F.col("user_id").alias("log_id"), i.alias("seq"), kind.alias("kind"), (i * 5 % 9).alias("idx"))


@query("pair_stream")
def pair_stream(s, d):
    return K.pairs_now(K.pair_changes(click_log(s, d)))


def lasso_log(s, d):
    i = F.col("event_id")
    kind = F.when(i % 11 == 0, "press").when(i % 13 == 5, "release").otherwise("move")
    return D.table(s, d, "events").select(F.col("user_id").alias("log_id"), i.alias("seq"), kind.alias("kind"), (i * 7 % 50).cast("double").alias("x"), (i * 3 % 10).cast("double").alias("y"))


@query("lasso_stream")
def lasso_stream(s, d):
    return K.lassos(lasso_log(s, d))


RATES = """WITH RECURSIVE e AS (SELECT user_id % 10 AS log_id, event_id % 13 / 200.0::DOUBLE AS dt, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS n FROM events),
t(log_id, n, rate) AS (SELECT DISTINCT log_id, CAST(0 AS BIGINT), CAST(0 AS DOUBLE) FROM e UNION ALL SELECT t.log_id, e.n, CASE WHEN dt > 0 THEN 0.9::DOUBLE * rate + 0.1::DOUBLE / least(dt, 0.1::DOUBLE) ELSE rate END FROM t JOIN e ON e.log_id = t.log_id AND e.n = t.n + 1)
SELECT log_id, CAST(n AS INT) AS n, round(rate, 6) AS rate FROM t WHERE n > 0 AND n % 30 = 0"""


@query("smoothed_rate", RATES)
def smoothed_rate(s, d):
    ticks = D.table(s, d, "events").select((F.col("user_id") % 10).alias("log_id"), F.col("event_id").alias("seq"), ((F.col("event_id") % 13) / 200.0).alias("dt"))
    return rounded(L.smoothed_rate(ticks), 6)


@query("camera_flight")
def camera_flight(s, d):
    keys = D.table(s, d, "events").select(F.col("user_id").alias("log_id"), F.col("event_id").alias("seq"), F.lit(0.016).alias("dt"), *[(F.floor(F.col("event_id") / k) % 3 - 1).alias(c) for c, k in (("ahead", 1), ("side", 2), ("rise", 5))], (F.col("event_id") % 360).cast("double").alias("yaw"), (F.col("event_id") % 120 - 60).cast("double").alias("pitch"))
    return rounded(L.fly(keys), 6)


LOOKS = """WITH RECURSIVE e AS (SELECT user_id, value AS dx, CAST(event_id % 400 - 150 AS DOUBLE) AS dy, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
t(user_id, n, yaw, pitch) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM e UNION ALL SELECT t.user_id, e.n, yaw + dx * 0.1::DOUBLE, greatest(-89.0::DOUBLE, least(89.0::DOUBLE, pitch - dy * 0.1::DOUBLE)) FROM t JOIN e ON e.user_id = t.user_id AND e.n = t.n + 1)
SELECT user_id AS log_id, round(yaw, 4) AS yaw, round(pitch, 4) AS pitch FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) AS back FROM t) WHERE back = 1"""


@query("camera_look", LOOKS)
def camera_look(s, d):
    deltas = D.table(s, d, "events").select(F.col("user_id").alias("log_id"), F.col("event_id").alias("seq"), F.col("value").alias("dx"), (F.col("event_id") % 400 - 150).cast("double").alias("dy"))
    return rounded(L.look(deltas), 4)


@query("edit_windows", "SELECT to_timestamp(floor(epoch(ts) / 300) * 300)::TIMESTAMP AS start, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def edit_windows(s, d):
    return L.live_counts(D.table(s, d, "events").select("ts", F.col("event_type").alias("kind")))
