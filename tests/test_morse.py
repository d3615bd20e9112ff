"""Persistence against a plain reduction, reconstruction of known shapes, detours against Dijkstra, ties of loose ends."""

import heapq
import itertools

import numpy as np
import pytest

from lumispan.operators import graphs, morse


def frame(spark, x):
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "node_id long, x double, y double, z double").repartition(3)


def plain(vertices, edges, triangles):
    """Standard reduction of the whole boundary matrix: persistence of each edge rank, and whether it joins."""
    f = dict(vertices)
    order = [(v, None) for v, _ in sorted(f.items(), key=lambda t: (t[1], t[0]))]
    place = {v: i for i, (v, _) in enumerate(order)}
    out, pivot = {}, {}
    for rank, u, w, value in sorted(edges):
        col = {place[u], place[w]}
        while col and max(col) in pivot:
            col = col ^ pivot[max(col)]
        if col:
            pivot[max(col)] = col
            out[rank] = (True, value - f[order[max(col)][0]])
        else:
            out[rank] = (False, None)
    value = {r: x for r, _, _, x in edges}
    pivot = {}
    for t in sorted(triangles):
        col = set(t)
        while col and max(col) in pivot:
            col = col ^ pivot[max(col)]
        if col:
            pivot[max(col)] = col
            out[max(col)] = (False, value[t[0]] - value[max(col)])
    return out


@pytest.mark.parametrize(("most", "local"), [(10**6, True), (40, False)])
def test_persistence(spark, monkeypatch, most, local):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(40, 3)), np.repeat(rng.normal(size=(1, 3)), 3, axis=0), rng.integers(0, 3, (12, 3)) + 8.0])
    v, e, t = morse.weighted_rips(frame(spark, x), 6)
    vertices, edges, triangles = ([tuple(r) for r in d.collect()] for d in (v, e.select("rank", "u", "w", "value"), t))
    assert [r[0] for r in sorted(edges)] == list(range(len(edges))) and len(triangles) == len(set(triangles)) > 50
    near = {(u, w): r for r, u, w, _ in edges}
    cliques = {tuple(sorted((near[a, b], near[a, c], near[b, c]), reverse=True)) for a, b, c in itertools.combinations(range(len(x)), 3) if {(a, b), (a, c), (b, c)} <= near.keys()}
    assert set(triangles) == cliques
    monkeypatch.setattr(morse, "COLUMNS", most)
    if not local:
        monkeypatch.setattr(morse, "_small", lambda d: False)
    dead = morse.elder_pairs(v, e)
    want = plain(vertices, edges, triangles)
    assert {r.rank for r in dead.collect()} == {r for r, (joins, _) in want.items() if joins}
    loops = e.join(dead, "rank", "left_anti")
    value, f = {r: x for r, _, _, x in edges}, dict(vertices)
    pairs = {r.rank: value[r.death] - value[r.rank] for r in morse.cycle_pairs(loops, t, most).collect()}
    assert pairs == {r: p for r, (joins, p) in want.items() if not joins and p is not None}
    assert {r.rank: value[r.rank] - f[r.v] for r in dead.collect()} == {r: p for r, (joins, p) in want.items() if joins}
    if local:
        assert {r.rank: (r.joins, r.persistence) for r in morse.persistence(v, e, t).collect()} == want


def test_parts_end_in_one_task_after_a_round(spark, monkeypatch):
    v, e, _ = morse.weighted_rips(frame(spark, np.random.default_rng(5).normal(size=(70, 3))), 5)
    want, turns = {tuple(r) for r in morse.elder_pairs(v, e).collect()}, []
    monkeypatch.setattr(morse, "_small", lambda d: len(turns) > 1 or bool(turns.append(1)))
    assert {tuple(r) for r in morse.elder_pairs(v, e).collect()} == want and len(turns) == 2 and len(want) > 50


def test_a_dense_cloud_has_a_column_for_each_loop(spark):
    """Of 5984 triangles, 528 loops are reduced, as the plain reduction of all triangles says."""
    x = np.random.default_rng(9).normal(size=(34, 3))
    v, e, t = morse.weighted_rips(frame(spark, x), 33)
    loops = e.join(morse.elder_pairs(v, e), "rank", "left_anti")
    columns, ends = morse.loop_columns(loops, t)
    assert columns.count() == loops.count() == 33 * 34 // 2 - 33 and ends.count() == t.count() == 34 * 33 * 32 // 6
    vertices, edges, triangles = ([tuple(r) for r in d.collect()] for d in (v, e.select("rank", "u", "w", "value"), t))
    want = {r: p for r, (joins, p) in plain(vertices, edges, triangles).items() if not joins}
    value = {r: x for r, _, _, x in edges}
    for most in (10**6, 300):
        assert {r.rank: value[r.death] - value[r.rank] for r in morse.cycle_pairs(loops, t, most).collect()} == want


def shape(spark, x, threshold, tau=3.0, reach=0.0):
    nodes, edges = morse.reconstruct_skeleton(frame(spark, x), threshold, tau, reach, k=12, percentile=1.0)
    found = [tuple(r) for r in edges.collect()]
    used = {n for e in found for n in e}
    parts = {r.component for r in graphs.connected_components(nodes, edges).collect() if r.node_id in used}
    return len(found) - len(used) + len(parts), len(parts), found  # loops, parts


def test_a_circle_has_one_loop_and_a_line_none(spark):
    rng = np.random.default_rng(1)
    a = np.sort(rng.uniform(0, 2 * np.pi, 160))
    circle = np.stack([10 * np.cos(a), 10 * np.sin(a), 0 * a], axis=1) + rng.normal(size=(160, 3)) * 0.3
    loops, parts, found = shape(spark, circle, 1.5)
    assert (loops, parts) == (1, 1) and len(found) > 20
    line = np.stack([np.linspace(0, 40, 150), *np.zeros((2, 150))], axis=1) + rng.normal(size=(150, 3)) * 0.2
    loops, parts, _ = shape(spark, line, 1.0)
    assert loops == 0 and parts <= 1
    assert shape(spark, np.zeros((0, 3)), 1.0)[2] == [] and shape(spark, np.zeros((3, 3)), 1.0)[2] == []


def test_trim_both_ways(spark, monkeypatch):
    rng = np.random.default_rng(6)
    tree = [(int(rng.integers(0, i)), i) for i in range(1, 60)]
    stay = [(int(i),) for i in rng.choice(60, 6, replace=False)]
    t, s = spark.createDataFrame(tree, "src long, dst long"), spark.createDataFrame(stay, "node_id long")
    one = {tuple(r) for r in morse._trimmed(t, s).collect()}
    monkeypatch.setattr(morse, "_small", lambda d: False)
    assert one == {tuple(r) for r in morse._trimmed(t, s).collect()}
    near = {i: {b for a, b in [*tree, *[(b, a) for a, b in tree]] if a == i} for i in range(60)}
    def path(a, b):
        line, seen = [(a, ())], {a}
        for n, way in line:
            if n == b:
                return way
            line += [(m, (*way, (min(n, m), max(n, m)))) for m in near[n] - seen]
            seen |= near[n]
    assert one == {e for (a,), (b,) in itertools.combinations(stay, 2) for e in path(a, b)}


def test_detours_against_dijkstra(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(size=(60, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    base = sorted({(min(i, j), max(i, j)) for i in range(60) for j in np.argsort(d[i])[1:4].tolist()})
    loops = [e for e in {(min(i, j), max(i, j)) for i in range(60) for j in np.argsort(d[i])[5:8].tolist()} if e not in base]
    near = {i: [(b, d[a, b]) for a, b in [*base, *[(b, a) for a, b in base]] if a == i] for i in range(60)}

    def way(a, b):
        line, seen = [(0.0, a)], set()
        while line:
            s, n = heapq.heappop(line)
            if n == b:
                return s
            if n not in seen:
                seen.add(n)
                for m, w in near[n]:
                    heapq.heappush(line, (s + w, m))
        return np.inf

    edges = spark.createDataFrame([(a, b, 1) for a, b in base] + [(a, b, 2) for a, b in loops], "src long, dst long, marker int")
    got = {tuple(r) for r in morse.detour_filter(frame(spark, x), edges, 2.0).collect()}
    want = {(a, b, 1) for a, b in base} | {(a, b, 2) for a, b in loops if way(a, b) > 2.0 * d[a, b]}
    assert got == want and 0 < sum(m == 2 for *_, m in got) < len(loops)


def test_broken_lines_are_tied_and_crossings_are_not(spark):
    line = lambda a, b, n: np.linspace(a, b, n)
    parts = [line([0, 0, 0], [4, 0, 0], 5), line([6, 0.2, 0], [10, 0.2, 0], 5), line([5, 1, 0], [5, 6, 0], 5), line([20, 0, 0], [24, 0, 0], 5)]
    x, edges, at = np.concatenate(parts), [], 0
    for p in parts:
        edges += [(at + i, at + i + 1) for i in range(len(p) - 1)]
        at += len(p)
    nodes, links = frame(spark, x), spark.createDataFrame(edges, "src long, dst long")
    assert [tuple(r) for r in morse.connect_ends(nodes, links, 3.0).collect()] == [(4, 5)]
    assert sorted(tuple(r) for r in morse.connect_ends(nodes, links, 12.0).collect()) == [(4, 5), (9, 15)]
    assert morse.connect_ends(nodes, links, 1.0).count() == 0 and morse.connect_ends(nodes, links.limit(0), 5.0).count() == 0
