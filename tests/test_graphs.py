import numpy as np

from lumispan.operators import features as E
from lumispan.operators import graphs as G
from lumispan.operators import register as R
from lumispan.functions.vectors import euler
from lumispan.operators.clouds import transform


def nodes(spark, rows):
    return spark.createDataFrame([(i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(rows)], "node_id long, x float, y float, z float")


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


def pairs(df):
    return sorted(tuple(r) for r in df.select("src", "dst").collect())


def test_clean_and_degrees(spark):
    assert pairs(G.undirected(edges(spark, [(1, 0), (0, 1), (2, 2), (1, 2)]))) == [(0, 1), (1, 2)]
    n = nodes(spark, [(i, 0, 0) for i in range(4)])
    assert {tuple(r) for r in G.degree_histogram(n, edges(spark, [(0, 1), (1, 2)])).collect()} == {(0, 1), (1, 2), (2, 1)}
    assert {tuple(r) for r in G.degrees(n, edges(spark, [(3, 3)])).collect()} == {(0, 0), (1, 0), (2, 0), (3, 2)}


def test_union_and_bridges(spark):
    n1, e1 = nodes(spark, [(0, 0, 0), (1, 0, 0)]), edges(spark, [(0, 1)])
    n2, none = nodes(spark, [(1, 2, 0)]), edges(spark, [])
    assert pairs(G.union(nodes(spark, [(0, 0, 0)] * 3), none, n1, e1)[1]) == [(3, 4)]
    assert pairs(G.union_with_bridges(n1, e1, n2, none, 2.0)[1]) == [(0, 1), (1, 2)]
    assert pairs(G.union_with_bridges(n1, e1, n2, none, 1.9)[1]) == [(0, 1)]


def test_forest(spark):
    n = nodes(spark, [(0, 0, 0)] * 3)
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.5), (0, 2, 2.0)], "a long, b long, d double")
    assert {(r.a, r.b) for r in G.minimum_forest(n, e).collect()} == {(0, 1), (1, 2)}


def test_pruning(spark):
    n = nodes(spark, [(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 0, 0), (3.3, 0, 0)])
    kept, left = G.prune_leaves(n, edges(spark, [(0, 1), (1, 2), (2, 3), (3, 4)]), 0.5)
    assert pairs(left) == [(0, 1), (1, 2), (2, 3)] and kept.count() == 4
    single = nodes(spark, [(0, 0, 0), (0.1, 0, 0)])
    assert pairs(G.prune_leaves(single, edges(spark, [(0, 1)]), 1.0)[1]) == [(0, 1)]
    assert len(pairs(G.prune_leaves(n, edges(spark, [(0, 1), (1, 2)]), 1.0)[1])) == 2


def test_compact_ids(spark):
    got = G.compact_ids(spark.createDataFrame([(9,), (4,), (100,)], "node_id long")).collect()
    assert {tuple(r) for r in got} == {(4, 0), (9, 1), (100, 2)}


def test_icp_finds_a_known_transform(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(size=(150, 3))
    d = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "point_id long, x float, y float, z float")
    truth = euler(0.01, -0.005, 0.01, 2, 1, -1)
    found = R.icp(transform(d, np.linalg.inv(truth)), d, steps=8)
    assert np.allclose(found["matrix"], truth, atol=1e-3)


def test_schedule_and_plate(spark):
    assert R.beta_schedule([60, 15, 5, 2], 10) == [60, 15, 10]
    assert R.beta_schedule([], 3) == [3]
    a = np.random.default_rng(1).uniform(size=(8, 3))
    w, linear = R.thin_plate(a, a + [1.0, 2.0, 3.0])
    assert np.allclose(w, 0, atol=1e-6) and np.allclose(linear[0], [1, 2, 3], atol=1e-6)


def test_farthest_points(spark):
    d = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 10.0, 0.0, 0.0), (3, 6.0, 0.0, 0.0)], "point_id long, x double, y double, z double")
    assert [r.point_id for r in E.farthest_points(d, 3).orderBy("turn").collect()] == [0, 2, 3]
    assert E.farthest_points(d, 9).count() == 4


def test_spread_and_local_forms_agree(spark):
    rng = np.random.default_rng(8)
    x = rng.uniform(size=(40, 3))
    n = nodes(spark, x)
    e = {(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 40, (70, 2)) if a != b}
    d = spark.createDataFrame([(a, b, float(np.linalg.norm(x[a] - x[b]))) for a, b in sorted(e)], "a long, b long, d double")
    local = {(r.a, r.b) for r in G.minimum_forest(n, d).collect()}
    assert local == {(r.a, r.b) for r in G._spread_forest(n, d).collect()}
    tree = edges(spark, sorted(local))
    same = lambda f: {tuple(r) for r in f.collect()}
    assert same(G.connected_components(n, tree)) == same(G._spread_components(n, G.undirected(tree)))
    a, b = G.prune_leaves(n, tree, 0.4)
    c, f = G._spread_prune(n, tree, G.edge_lengths(n, G.undirected(tree)), 0.4)
    assert pairs(b) == pairs(f) and same(a.select("node_id")) == same(c.select("node_id"))


def test_contracted_graphs_end_in_few_rounds(spark, monkeypatch):
    """A long chain, twigs, loops and whole short trees, contracted to the end: as in one task, in rounds that a chain does not add to."""
    rng = np.random.default_rng(11)
    chain = [(i, i + 1) for i in range(120)]
    twigs = [(int(rng.integers(0, i)), i) for i in range(121, 150)] + [(160 + i, 161 + i) for i in range(9)] + [(180, 181), (181, 182), (180, 182), (182, 183)]
    x = rng.uniform(size=(190, 3))
    x[:121, 0] += np.arange(121) * 0.01
    x[[40, 90]] += 50.0
    n, e = nodes(spark, x), edges(spark, chain + twigs)
    same = lambda f: {tuple(r) for r in f.collect()}
    d = G.edge_lengths(n, e).selectExpr("src AS a", "dst AS b", "length AS d")
    forest, (a, b) = same(G.minimum_forest(n, d)), G.prune_leaves(n, e, 3.0)
    a, b = same(a.select("node_id")), pairs(b)
    assert (40, 41) in b and (180, 181) in b and not any(160 <= i < 170 for p in b for i in p) and len({i for i, in a if 160 <= i < 170}) == 1
    seen = []
    cut = G.cut
    monkeypatch.setattr(G, "_small", lambda f: False)
    monkeypatch.setattr(G, "cut", lambda f: seen.append(1) or cut(f))
    assert forest == same(G.minimum_forest(n, d))
    kept, held = G.trimmed(e, spark.createDataFrame([(39,), (92,)], "node_id long"))
    assert len(seen) < 100
    monkeypatch.undo()
    assert set(pairs(kept)) == {(i, i + 1) for i in range(39, 92)} | {(180, 181), (181, 182), (180, 182)}
    assert {r[0] for r in same(held)} == set(range(150)) | set(range(180, 184))
    small, first = G._small, []
    monkeypatch.setattr(G, "_small", lambda f: bool(first) and small(f) if first or first.append(1) else False)
    c, f = G.prune_leaves(n, e, 3.0)
    assert pairs(f) == b and same(c.select("node_id")) == a


def test_components_settle_however_ids_lie_along_a_path(spark, monkeypatch):
    """Ids that fall along a path towards its other end let no smaller id pass on faster than an edge a round."""
    far, rng = 150, np.random.default_rng(2)
    fall = [0, *range(far, 0, -1)]
    path = list(zip(fall, fall[1:], strict=False)) + [(int(rng.integers(200, i)), i) for i in range(201, 260)] + [(300, 301), (302, 302)]
    n = nodes(spark, np.zeros((310, 3)))
    want = {(i, 0 if i <= far else 200 if 200 <= i < 260 else 300 if i == 301 else i) for i in range(310)}
    same = lambda f: {tuple(r) for r in f.collect()}
    assert same(G.connected_components(n, edges(spark, path))) == want
    seen, cut, small = [], G.cut, G._small
    monkeypatch.setattr(G, "_small", lambda f: False)
    monkeypatch.setattr(G, "cut", lambda f: seen.append(1) or cut(f))
    assert same(G.connected_components(n, edges(spark, path))) == want and len(seen) < 60
    first = []
    monkeypatch.setattr(G, "_small", lambda f: small(f) if len(first) > 2 else bool(first.append(1)))
    assert same(G.connected_components(n, edges(spark, path))) == want and len(first) == 3


def test_components_of_the_whole_graph(spark):
    from lumispan.functions import derived as D
    from lumispan.plans import graphs as P

    sf = "/root/testdata/sf0.001"
    up = {r.node_id: r.node_id for r in D.user_nodes(spark, sf).collect()}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in D.user_edges(spark, sf).collect():
        a, b = find(r.src), find(r.dst)
        up[max(a, b)] = min(a, b)
    assert {r.node_id: r.component for r in P.connected_components(spark, sf).collect()} == {x: find(x) for x in up}


def test_spread_pruning_goes_on_to_the_end_and_stops_at_two(spark):
    rows = [(float(i), 0.0, 0.0) for i in range(9)] + [(100.0, 0.0, 0.0), (101.0, 0.0, 0.0), (200.0, 5.0, 0.0), (201.0, 5.0, 0.0), (200.0, 6.0, 0.0), (199.0, 5.0, 0.0)]
    nodes = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "node_id long, x float, y float, z float")
    chain = [(i, i + 1) for i in range(8)]
    for pairs in (chain, [*chain, (9, 10)], [(9, 10)], [(11, 12), (11, 13), (11, 14)], [(11, 12), (11, 13), (11, 14), (9, 10)]):
        edges = spark.createDataFrame(pairs, "src long, dst long")
        lengths = G.edge_lengths(nodes, edges)
        want = [d.collect() for d in G.prune_leaves(nodes, edges, 1.5)]
        got = [d.collect() for d in G._spread_prune(nodes, edges, lengths, 1.5)]
        assert [sorted(map(tuple, x)) for x in got] == [sorted(map(tuple, x)) for x in want], pairs


def test_few_anchors_shift_by_their_own_mean(spark):
    from lumispan.operators import register as R

    cloud = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(3)], "point_id long, x double, y double, z double")
    moved = R.plate_warp(cloud, np.array([[0.0, 0.0, 0.0]]), np.array([[3.0, 0.0, 0.0]])).orderBy("point_id").collect()
    assert [r.x for r in moved] == [3.0, 4.0, 5.0]


def test_rates_and_flights_step_by_step(spark):
    from lumispan.streaming import session as L

    rng = np.random.default_rng(8)
    dts = np.where(rng.random(130) < 0.2, 0.0, rng.random(130) * 0.2)
    ticks = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(dts)], "log_id long, seq long, dt double")
    fps, want = 0.0, {}
    for n, x in enumerate(dts, 1):
        fps = 0.9 * fps + 0.1 / min(x, 0.1) if x > 0 else fps
        if n % 30 == 0:
            want[n] = fps
    got = {r.n: r.rate for r in L.smoothed_rate(ticks).collect()}
    assert set(got) == set(want) and all(abs(got[n] - want[n]) < 1e-9 for n in want)
    keys = spark.createDataFrame([(1, 0, 0.1, 1, 0, 0, 0.0, 0.0), (1, 1, 0.1, 1, 1, 0, 90.0, 0.0)], "log_id long, seq long, dt double, ahead int, side int, rise int, yaw double, pitch double")
    one, two = L.fly(keys).orderBy("seq").collect()
    assert np.allclose([one.vx, one.vy, one.vz, one.pz], [0, 0, -2 * 0.2, -0.04])
    assert np.allclose([two.vx, two.vz], [2 * np.sqrt(0.5) * 0.2, (-0.4 + 2 * np.sqrt(0.5)) * 0.2])  # along x, and right of it is z


def test_catalog_names_begin_with_the_series(spark):
    from pyspark.sql import functions as F

    from lumispan.sources import graphs as SG

    names = spark.createDataFrame([("tangle1 a T0.5.pcd",), ("xtangle1 a T0.5.pcd",), ("Tangle2 b c T1.pcd",)], "name string")
    assert {r.series for r in SG.structured_catalog(names, F.col("name")).collect()} == {"tangle1", "Tangle2"}
