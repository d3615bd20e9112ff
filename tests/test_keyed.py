"""Keyed state over tables and over streams of three batches, against plain folds over the whole log."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumispan.plans import graphs as P
from lumispan.streaming import keyed as K
from lumispan.streaming import session as L

DIR = "/root/testdata/sf0.001"


def streamed(spark, folder, batches, schema, make):
    """Rows of a stream whose micro-batches are the given lists, with the number of the batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder / "in"))
        out = make(spark.readStream.schema(schema).json(str(folder / "in")))
        query = out.writeStream.foreachBatch(lambda d, n: d.withColumn("batch", F.lit(n)).write.mode("append").parquet(str(folder / "out"))).outputMode("update").option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    return spark.read.parquet(str(folder / "out")).collect()


def plain_undo(kinds, depth=20):
    done, undone, fixed = [], [], 0
    for k in kinds:
        if k == "undo":
            undone += [done.pop()] if done else []
        elif k == "redo":
            done += [undone.pop()] if undone else []
        else:
            done.append(k)
            undone = []
        if len(done) > depth:
            done, fixed = done[1:], fixed + 1
    return fixed + len(done), len(undone)


def test_edits_in_three_batches_end_as_one_fold(spark, tmp_path):
    rng = np.random.default_rng(3)
    logs = {i: [(i, n, str(k)) for n, k in enumerate(rng.choice(["edit", "edit", "edit", "undo", "redo"], 70))] for i in (1, 2)}
    logs[None] = [(None, n, "edit") for n in range(30)] + [(None, n, "undo") for n in range(30, 60)]
    batches = [[r for rows in logs.values() for r in rows[a:b]][::-1] for a, b in ((0, 25), (25, 26), (26, 70))]
    batches[2] += [(1, 3, "undo"), (2, None, "undo"), (2, 69, logs[2][69][2])]  # late, without order, and once again
    rows = streamed(spark, tmp_path, batches, "log_id long, seq long, kind string", K.replay)
    last = {}
    for r in sorted(rows, key=lambda r: r.batch):
        last[r.log_id] = (r.applied, r.redoable, r.late, r.last_seq)
    late = {1: 1, 2: 2, None: 0}
    assert last == {i: (*plain_undo([k for _, _, k in rows]), late[i], len(rows) - 1) for i, rows in logs.items()}
    assert last[None][:2] == (10, 20)


def test_edits_of_a_table(spark):
    log = spark.createDataFrame([(1, 2, "undo", "x"), (1, 1, "edit", "y"), (1, 1, "edit", "z"), (2, None, "edit", "x"), (3, 5, None, "x")], "log_id long, seq long, kind string, last_seq string")
    got = {r.log_id: tuple(r)[1:] for r in K.replay(log).collect()}
    assert got == {1: (0, 1, 1, 2), 2: (0, 0, 1, None), 3: (1, 0, 0, 5)}
    assert K.replay(log.limit(0)).collect() == []
    query = P.undo_stream(spark, DIR)
    want = {tuple(r) for r in P.undo_replay(spark, DIR).collect()}
    assert {tuple(r)[:3] for r in query.collect()} == want


def test_a_log_longer_than_an_arrow_batch_passes_in_order(spark):
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        log = spark.range(1000).select(F.lit(1).alias("log_id"), (F.lit(999) - F.col("id")).alias("seq"), F.when(F.col("id") % 3 == 0, "undo").otherwise("edit").alias("kind"))
        (r,) = K.replay(log).collect()
        kinds = ["undo" if (999 - n) % 3 == 0 else "edit" for n in range(1000)]
        assert (r.applied, r.redoable, r.late, r.last_seq) == (*plain_undo(kinds), 0, 999)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


KEYS = ("w", "s", "a", "d", "space", "shift")


def plain_camera(rows):
    held, p, v, yaw, pitch, out = set(), np.zeros(3), np.zeros(3), 0.0, 0.0, {}
    for _, seq, kind, key, a, b in sorted(rows, key=lambda r: r[1]):
        if kind == "down":
            held.add(key)
        elif kind == "up":
            held.discard(key)
        elif kind == "blur":
            held, v = set(), np.zeros(3)
        elif kind == "look":
            yaw, pitch = yaw + a * 0.1, float(np.clip(pitch - b * 0.1, -89, 89))
        else:
            y, q = np.radians(yaw), np.radians(pitch)
            ahead = np.array([np.cos(q) * np.sin(y), np.sin(q), -np.cos(q) * np.cos(y)])
            right = np.cross(ahead, [0, 1, 0])
            right /= np.linalg.norm(right)
            want = sum((np.array(d) for k, d in zip(KEYS, (ahead, -ahead, -right, right, [0, 1, 0], [0, -1, 0]), strict=True) if k in held), np.zeros(3))
            want = want / np.linalg.norm(want) if np.linalg.norm(want) > 1e-6 else want
            v = (v + want * 20 * a) * max(0, 1 - 8 * a)
            v = v * min(1, 5 / max(np.linalg.norm(v), 1e-12))
            p = p + v * a
            out[seq] = [*p, *v, yaw, pitch, len(held)]
    return out


def test_keys_stay_held_from_batch_to_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    kinds = rng.choice(["down", "up", "look", "tick", "tick", "tick", "blur"], 120, p=[0.2, 0.1, 0.15, 0.2, 0.2, 0.1, 0.05])
    rows = [(7, n, str(k), str(rng.choice(KEYS)), float(rng.random() * 0.1 if k == "tick" else rng.normal(0, 300)), float(rng.normal(0, 300))) for n, k in enumerate(kinds)]
    got = streamed(spark, tmp_path, [rows[:40], rows[40:41], rows[41:]], "log_id long, seq long, kind string, key string, a double, b double", K.cameras)
    want = plain_camera(rows)
    assert {r.seq for r in got} == set(want) and len(got) == len(want)
    assert all(np.allclose(list(r)[2:11], want[r.seq], atol=1e-9) for r in got)
    assert any(r.n_held > 1 for r in got) and max(abs(r.pitch) for r in got) == 89.0


def test_keys_and_flight_of_a_table(spark):
    log = P.camera_log(spark, DIR).collect()
    got = {(r.log_id, r.seq): list(r)[2:] for r in P.camera_stream(spark, DIR).collect()}
    want = {(i, n): x for i in {r.log_id for r in log} for n, x in plain_camera([r for r in log if r.log_id == i]).items()}
    assert set(got) == set(want) and len(got) > 100
    assert all(np.allclose(got[k], want[k], atol=2e-6) for k in want)
    odd = spark.createDataFrame([(1, 1, "down", None, None, None), (1, 2, "up", "q", None, None), (1, 3, None, "w", 1.0, 1.0), (1, 4, "look", None, None, 2000.0), (1, 5, "tick", None, None, None)], "log_id long, seq long, kind string, key string, a double, b double")
    assert [tuple(r) for r in K.cameras(odd).collect()] == [(1, 5, 0, 0, 0, 0, 0, 0, 0.0, -89.0, 0)]



def test_a_step_of_a_camera_makes_no_arrays(monkeypatch):
    """Arrays of three took most of a tick's time; numbers that are not finite stay as they were with them."""
    for name in ("array", "radians", "sqrt", "zeros"):
        monkeypatch.delattr(np, name)
    camera = K._Camera(5.0, 20.0, 8.0, 0.1)
    camera.open(K._InTask())
    camera.load()
    for row in [("down", "d", None, None), ("look", None, 900.0, 0.0)]:
        assert camera.step(SimpleNamespace(seq=0, **dict(zip(("kind", "key", "a", "b"), row, strict=True)))) == []
    ((seq, *at),) = camera.step(SimpleNamespace(seq=1, kind="tick", key=None, a=0.05, b=None))
    assert seq == 1 and abs(at[5] - 20 * 0.05 * 0.6) < 1e-12 and abs(at[2] - 0.03) < 1e-12 and abs(at[0]) < 1e-12
    assert camera.step(SimpleNamespace(seq=2, kind="look", key=None, a=float("inf"), b=0.0)) == []
    ((_, *at),) = camera.step(SimpleNamespace(seq=3, kind="tick", key=None, a=0.05, b=None))
    assert all(x != x for x in (at[0], at[2], at[3], at[5])) and at[1] == at[4] == 0.0


def plain_pairs(rows):
    active, pairs = None, []
    for _, _, kind, idx in sorted(rows, key=lambda r: r[1]):
        if kind not in ("primary", "secondary") or idx is None:
            active = None
        elif active and active[0] != kind:
            p, s = (idx, active[1]) if kind == "primary" else (active[1], idx)
            pairs = [x for x in pairs if x[0] != p and x[1] != s] + [(p, s)]
            active = None
        else:
            active = (kind, idx)
    return set(pairs)


def test_pairs_stay_one_to_one_over_batches(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, n, str(rng.choice(["primary", "secondary", "miss"], p=[0.45, 0.45, 0.1])), int(rng.integers(6))) for i in (1, 2) for n in range(80)]
    rows += [(3, 0, "primary", 1), (3, 1, "secondary", None), (3, 2, "secondary", 1)]
    changes = streamed(spark, tmp_path, [[r for r in rows if r[1] % 80 in span] for span in (range(33), range(33, 34), range(34, 80))], "log_id long, seq long, kind string, idx long", K.pair_changes)
    now = K.pairs_now(spark.createDataFrame(changes)).collect()
    for i in (1, 2, 3):
        assert {(r.p_idx, r.s_idx) for r in now if r.log_id == i} == plain_pairs([r for r in rows if r[0] == i])
    assert any(r.change == "unpair" for r in changes) and not any(r.log_id == 3 for r in changes)


def test_pairs_of_a_table(spark):
    log = P.click_log(spark, DIR).collect()
    got = P.pair_stream(spark, DIR).collect()
    assert {tuple(r) for r in got} == {(i, *x) for i in {r.log_id for r in log} for x in plain_pairs([r for r in log if r.log_id == i])} and got


def plain_lassos(rows):
    path, out = None, []
    for i, seq, kind, x, y in sorted(rows, key=lambda r: r[1]):
        if kind == "press":
            path = [(x, y)]
        elif kind == "move" and path and (abs(x - path[-1][0]) > 2 or abs(y - path[-1][1]) > 2):
            path.append((x, y))
        elif kind == "release":
            out += [(i, seq, n, *v) for n, v in enumerate(path)] if path and len(path) > 2 else []
            path = None
    return set(out)


def test_lassos_go_on_over_batches(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(1, n, str(rng.choice(["press", "move", "release"], p=[0.12, 0.8, 0.08])), float(rng.integers(8)), float(rng.integers(8))) for n in range(300)]
    got = streamed(spark, tmp_path, [rows[:100], rows[100:101], rows[101:]], "log_id long, seq long, kind string, x double, y double", K.lassos)
    assert {tuple(r)[:5] for r in got} == plain_lassos(rows) and len({r.lasso for r in got}) > 2
    assert any(r.batch == 2 and r.lasso > 101 for r in got)


def test_lassos_of_a_table(spark):
    log = P.lasso_log(spark, DIR).collect()
    got = {tuple(r) for r in P.lasso_stream(spark, DIR).collect()}
    assert got == {x for i in {r.log_id for r in log} for x in plain_lassos([tuple(r) for r in log if r.log_id == i])} and got


@pytest.mark.parametrize("fold", [K.cameras, K.pair_changes, K.lassos])
def test_empty_logs(spark, fold):
    log = spark.createDataFrame([], "log_id long, seq long, kind string, key string, a double, b double, idx long, x double, y double, batch string")
    assert fold(log).collect() == []


def test_plain_and_keyed_replay_agree_on_depth(spark):
    log = spark.createDataFrame([(1, n, "edit" if n < 8 else "undo") for n in range(16)], "log_id long, seq long, kind string")
    for depth in (1, 3):
        assert tuple(K.replay(log, depth).collect()[0])[1:3] == tuple(L.replay(log, depth).collect()[0])[1:3] == (8 - depth, depth)


def test_a_table_asks_no_state_store_and_may_be_cut_anywhere(spark):
    rng = np.random.default_rng(8)
    logs = {i: [(i, n, str(rng.choice(["edit", "edit", "undo", "redo"]))) for n in range(23)] for i in (1, 2, None)}
    more = [(1, 22, k) for k in ("zoom", None, "zz", "zzz")] + [(2, None, "undo")] * 5 + [(2, 22, "zzzz")] * 3
    log = spark.createDataFrame([r for rows in logs.values() for r in rows] + more, "log_id long, seq long, kind string")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in (1, 3, 1000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            made = K.replay(log)
            assert "TransformWithState" not in made._jdf.queryExecution().toString()
            got = {r.log_id: tuple(r)[1:] for r in made.collect()}
            # of rows with one seq the least by text: a missing kind counts as None, which comes before the others
            last = {1: "None", 2: logs[2][22][2], None: logs[None][22][2]}
            assert got == {i: (*plain_undo([k for _, _, k in rows[:22]] + [last[i]]), {1: 4, 2: 8, None: 0}[i], 22) for i, rows in logs.items()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
