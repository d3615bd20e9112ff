"""Spread picks of clusters against the plain selection, and growth along a line."""

import numpy as np
import pytest

from lumispan.operators import features as E


def plain(x, n):
    taken, near = [0], np.full(len(x), np.inf)
    while len(taken) < min(n, len(x)):
        d = x - x[taken[-1]]
        near = np.minimum(near, d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2])
        taken.append(int(near.argmax()))
    return taken


@pytest.mark.parametrize("kind", ["normal", "grid", "line", "copies"])
def test_rows_equal_the_plain_selection(kind):
    rng = np.random.default_rng(0)
    x = {"normal": rng.normal(size=(3000, 3)), "grid": rng.integers(0, 9, (2000, 3)).astype(float), "line": np.stack([np.arange(1500.0), *np.zeros((2, 1500))], axis=1), "copies": np.repeat(rng.normal(size=(3, 3)), 300, axis=0)}[kind]
    assert E.farthest_rows(x, 200).tolist() == plain(x, 200)
    assert E.farthest_rows(x[:5], 9).tolist() == list(range(5))


@pytest.mark.parametrize("most", [10**6, 100])
def test_picks_of_clusters(spark, monkeypatch, most):
    monkeypatch.setattr(E, "MOST_GROUP", most)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(320, 3))
    label = np.repeat([-1, 0, 50, 70], [200, 60, 59, 1])
    d = spark.createDataFrame([(int(l), i * 2, *map(float, v)) for i, (l, v) in enumerate(zip(label, x, strict=True))], "label long, point_id long, x double, y double, z double").repartition(4)
    got = {}
    for r in E.spread_picks(d, 0.1, 3, 6).collect():
        got.setdefault(r.label, {})[r.point_id] = (r.x, sorted(r.near))
    for l in (-1, 0, 50, 70):
        rows = np.flatnonzero(label == l)
        mine = rows[plain(x[rows], max(1, int(len(rows) * 0.1)))] if len(rows) > 1 else rows
        want = {}
        for i in mine:
            near = sorted((((x[j] - x[i]) ** 2).sum(), j) for j in mine if j != i)[:3] if len(mine) >= 6 else []
            want[int(i) * 2] = (x[i][0], sorted(int(j) * 2 for _, j in near))
        assert got[l] == want


def test_growth_follows_a_line(spark):
    """A straight noisy line grows beyond both of its ends, and only along itself."""
    rng = np.random.default_rng(2)
    x = np.stack([rng.uniform(0, 60, 1500), *rng.normal(size=(2, 1500)) * 0.05], axis=1)
    d = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "point_id long, x double, y double, z double")
    assert E.grow_skeleton(d.limit(0)).count() == 0
    base = E.grow_skeleton(d, iterations=2, rounds=0).select("x", "y", "z").toPandas().to_numpy()
    grown = E.grow_skeleton(d, radius=8.0, size=1.0, iterations=2, rounds=2).select("x", "y", "z").toPandas().to_numpy()
    assert 15 <= len(base) <= 40 and len(grown) > len(base)
    assert np.abs(grown[:, 1:]).max() < 1.0
    assert grown[:, 0].max() > base[:, 0].max() + 1 and grown[:, 0].min() < base[:, 0].min() - 1


def test_point_features_make_no_row_for_each_bin(spark):
    rows = [(i, float(v[0]), float(v[1]), float(v[2])) for i, v in enumerate(np.random.default_rng(2).normal(0, 0.2, (60, 3)))]
    found = E.point_features(spark.createDataFrame([*rows, (60, 99.0, 99.0, 99.0)], "point_id long, x double, y double, z double"), 0.3, 0.3)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.id: r.f for r in found.collect()}
    assert 60 not in got and all(len(f) == 33 and abs(sum(f[:11]) - sum(f[22:])) < 1e-6 and sum(f) >= 300 - 1e-6 for f in got.values())
