"""Operators 11 to 13 against brute force on small messy tables."""

import hashlib

import numpy as np
import pytest

from lumispan.llm import dimscan, dualtree, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, node long, row long, v string, x string, width int, part int, n long, score double, q long"


def rows_of(width, seed=3):
    """Clusters, exact and scaled copies, ties, repeated ids with other vectors, null ids, bad vectors and other widths."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    vectors = [(c + 0.1 * rng.normal(size=width)).astype(np.float32).tolist() for c in centres for _ in range(40)]
    rows = [(i, v) for i, v in enumerate(vectors)]
    rows += [(1000 + i, vectors[0]) for i in range(120)]  # a hot vector
    rows += [(2000, (2 * np.float32(vectors[7])).tolist()), (2000, vectors[9]), (2000, vectors[9]), (None, vectors[3]), (None, None), (2050, None), (2100, [0.0] * width), (2150, [0.0] * (width - 1) + [float("nan")]), (2200, [None] + [1.0] * (width - 1)), (2250, [float("inf")] + [1.0] * (width - 1)), (2300, [1.0, 2.0]), (2350, [2.0, 1.0]), (2400, [])]
    rows += [(-50, [-x for x in vectors[0]])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, "v", "x", 5, 6, 7, 0.5, 8) for i, v in rows], SCHEMA).repartition(5)


def finite(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def lloyd(rows, k, rounds, scale, width, seed):
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows if finite(v) and len(v) == width]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in order[:k]]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for _ in range(rounds):
        at = [min(range(len(c)), key=lambda j: (d(v, c[j]), j)) for _, v in kept]
        for j in range(len(c)):
            if mine := [v for (_, v), a in zip(kept, at, strict=True) if a == j]:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    at = [min((d(v, c[j]), j) for j in range(len(c))) for _, v in kept]
    total = {j: sum(x for x, a in at if a == j) for j in range(len(c))}
    return sorted((str(i), j, x, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (x, j) in zip(kept, at, strict=True))


@pytest.mark.parametrize(("width", "k", "block"), [(64, 8, 1024), (5, 12, 64)])
def test_dual_tree(spark, monkeypatch, width, k, block):
    monkeypatch.setattr(dualtree, "BLOCK", block)
    rows = rows_of(width)
    got = dualtree.cluster_vectors(frame(spark, rows), k=k, rounds=10, width=width)
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == lloyd(rows, k, 10, 1024, width, 3)


def test_dual_tree_ends(spark):
    cluster = lambda rows, **more: dualtree.cluster_vectors(frame(spark, rows), **more).collect()
    assert cluster([]) == []
    assert cluster([(None, [0.5] * 64), (1, None)]) == []
    one = cluster([(4, [0.5] * 64), (4, [0.5] * 64), (None, [0.25] * 64)])
    # two equal starts: the first takes all three, moves away, and leaves the copies to the second
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.inertia) for r in one) == [("4", 1, 0, 0)] * 2 + [("None", 0, 0, 0)]
    with pytest.raises(Exception, match="no exact distances"):
        cluster([(1, [1e9] * 64)])


def test_cover_tree_holds_its_bounds():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-5, 5, (300, 3)), rng.integers(-2000, 2000, (100, 3)), np.zeros((50, 3), int)]).astype(np.int32)
    tree, order = dualtree.CoverTree.build(x, 4)
    assert sorted(order) == list(range(len(x))) and (tree.points == x[order]).all()
    for i in range(len(tree.radii)):
        mine = tree.points[tree.begin[i] : tree.end[i]].astype(float)
        d = np.sqrt(((mine - tree.points[tree.centre[i]]) ** 2).sum(axis=1))
        assert np.isclose(d.max(), tree.radii[i])
        below = range(tree.first[i], tree.last[i])
        if below:
            assert [tree.begin[j] for j in below] + [tree.end[i]] == [tree.begin[i]] + [tree.end[j] for j in below]
            centres = tree.points[[tree.centre[j] for j in below]].astype(float)
            gaps = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))
            half = 2.0 ** (np.ceil(np.log2(tree.radii[i])) - 1)
            assert (gaps[~np.eye(len(centres), dtype=bool)] > half).all()


def test_trees_prune():
    rng = np.random.default_rng(2)
    x = (rng.integers(0, 4, (900, 1)) * 10_000 + rng.integers(0, 30, (900, 6))).astype(np.int32)
    tree, _ = dualtree.CoverTree.build(x)
    c = np.array([[10_000 * i] * 6 for i in range(4)])
    over, numbers = dualtree.CoverTree.build(c, 1)
    assert (over.points == c[numbers]).all()
    cluster, _, (begin, end, of) = dualtree.walk(tree, over, numbers)
    assert (cluster == -1).all() and len(of) < 20 and (end - begin).sum() == 900
    assert all((tree.points[b:e] // 10_000 == n).all() for b, e, n in zip(begin, end, of, strict=True))


def neighbours(rows, divisor, k):
    good = [(i, n, np.array(v, np.float32).astype(float)) for n, (i, v) in enumerate(rows) if i is not None and finite(v) and any(v)]
    cos = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b)))
    out = []
    for i, n, v in good:
        if i % divisor == 0:
            near = sorted((-round(cos(v, w), 12), j) for j, m, w in good if m != n and len(w) == len(v))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("lists", [1024, 40])
def test_dimension_scan(spark, monkeypatch, lists):
    """One list is exact; several reach the aim here, since clusters are lists."""
    monkeypatch.setattr(dimscan, "LIST", lists)
    monkeypatch.setattr(dimscan, "CHUNK", 64)
    rows = rows_of(64)
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 12)) for r in dimscan.nearest_vectors(frame(spark, rows)).collect())
    want = neighbours(rows, 50, 5)
    assert len(got) == len(want)
    if lists == 1024:
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)
    else:
        assert len({(q, v) for q, _, v, _ in got} & {(q, v) for q, _, v, _ in want}) >= 0.9 * len({(q, v) for q, _, v, _ in want})


def test_dimension_scan_falls_back_to_all(spark, monkeypatch):
    """Where the test abandons too much, the measured recall sends all lists through the exact comparison."""
    monkeypatch.setattr(dimscan, "LIST", 40)
    monkeypatch.setattr(dimscan, "DOUBT", -50.0)
    monkeypatch.setattr(dimscan, "AIM", 0.0)
    rng = np.random.default_rng(8)
    rows = [(i * 5, v) for i, v in enumerate(rng.normal(size=(400, 32)).astype(np.float32).tolist())]
    got = sorted((r.query_id, r.rank, r.vec_id) for r in dimscan.nearest_vectors(frame(spark, rows), aim=0.0).collect())
    assert got == [w[:3] for w in neighbours(rows, 50, 5)]


def test_dimension_scan_ends(spark):
    assert dimscan.nearest_vectors(frame(spark, [])).collect() == []
    assert dimscan.nearest_vectors(frame(spark, [(50, [1.0, 0.0])])).collect() == []
    assert [tuple(r) for r in dimscan.nearest_vectors(frame(spark, [(50, [1.0, 0.0]), (7, [0.0, 2.0]), (3, [5.0, 0.0])])).orderBy("rank").collect()] == [(50, 1, 3, 1.0), (50, 2, 7, 0.0)]


def test_scan_abandons_early():
    rng = np.random.default_rng(6)
    x = dimscan.unit(rng.normal(size=(2000, 64)))
    turned = (x @ dimscan.rotation(64)).astype(np.float32)
    exact = 2 - 2 * x[:20] @ x.T
    bound = np.sort(exact, axis=1)[:, 5]
    blocks = [np.ascontiguousarray(turned[:, i : i + 16].T) for i in range(0, 64, 16)]
    i, j = dimscan.scan(turned[:20], blocks, bound, 6, dimscan.DOUBT)
    hit = {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(a, int(b)) for a in range(20) for b in np.argsort(exact[a])[:6]}
    assert len(hit & want) >= 0.97 * len(want) and len(hit) < 200


def whitened(rows, components=4, scale=256):
    """By width: distinct vectors, their covariance, and each row's deviation and projections."""
    out = {}
    kept = [(i, np.floor(scale * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v in rows if finite(v) and len(v)]
    for width in {len(x) for _, x in kept}:
        mine = [(i, x) for i, x in kept if len(x) == width]
        fit = np.unique(np.array([x for _, x in mine]), axis=0)
        n, sums = len(fit), fit.sum(axis=0)
        gap = fit - sums / n
        cov = gap.T @ gap / n
        values, axes = np.linalg.eigh(cov)
        values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
        for i, x in mine:
            out.setdefault((i, width), []).append((n, int(((n * x - sums) ** 2).sum()), (x - sums / n) @ axes, values, np.trace(cov)))
    return out


@pytest.mark.parametrize("width", [64, 3])
def test_whitening(spark, width):
    rows = [r for r in rows_of(width) if r[1] is None or len(r[1]) != 2]
    got = whitening.whiten(frame(spark, rows)).collect()
    want = whitened(rows)
    k = min(4, width)
    assert len(got) == k * sum(map(len, want.values()))
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, []).append(r)
    for (i, _), some in want.items():
        mine = by_id.pop(i)
        assert sorted({(r.n, r.deviation) for r in mine}) == sorted({s[:2] for s in some})
        for c in range(k):
            have = sorted(abs(r.whitened) for r in mine if r.component == c + 1)
            assert np.allclose(have, sorted(abs(s[2][c]) / np.sqrt(s[3][c]) for s in some), rtol=1e-7, atol=1e-9)
            assert all(abs(r.explained - some[0][3][c] / some[0][4]) < 1e-9 for r in mine if r.component == c + 1)
    assert not by_id and {r.identity_error < 1e-9 for r in got} == {True}


def test_whitening_ends(spark):
    made = lambda rows: [tuple(r) for r in whitening.whiten(frame(spark, rows)).orderBy("vec_id", "component").collect()]
    assert made([]) == [] and made([(1, None), (2, []), (3, [float("nan")])]) == []
    assert made([(1, [0.5, 1.0]), (2, [0.5, 1.0])]) == [(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    flat = made([(1, [0.0, 1.0]), (2, [0.0, -1.0]), (3, [4.0])])  # two widths; one direction without variance
    assert [(r[0], r[1], r[2], r[3], None if r[4] is None else abs(round(r[4], 12))) for r in flat] == [(1, 1, 2, 512 * 512, 1.0), (1, 2, 2, 512 * 512, None), (2, 1, 2, 512 * 512, 1.0), (2, 2, 2, 512 * 512, None), (3, 1, 1, 0, None)]
    huge = made([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 3.0])])  # beyond a long
    assert len(huge) == 6 and all(r[3] is None or r[3] >= 0 for r in huge)


def test_symmetric_qr():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 17, 64):
        for kind in range(4):
            a = rng.normal(size=(n, n))
            a = [a @ a.T, a + a.T, np.diag(np.arange(n, dtype=float)), np.zeros((n, n)) + (n > 3) * np.eye(n)][kind]
            values, axes = whitening.symmetric_qr(a)
            assert np.allclose(axes.T @ axes, np.eye(n), atol=1e-12)
            assert np.allclose(axes @ np.diag(values) @ axes.T, a, atol=1e-11 * max(1, np.abs(a).max()) * n)
            assert (np.diff(values) <= 1e-12 * max(1, np.abs(values).max())).all()
