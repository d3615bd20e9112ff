"""Edit sessions: versions with undo and redo, the same as a fold over a log, and ordered state machines."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEPTH = 20


class Session:
    """Immutable versions of named tables; an edit takes and gives a DataFrame. At most ``depth`` edits can be undone."""

    def __init__(self, depth: int = DEPTH, **tables: DataFrame):
        self.tables = dict(tables)
        self.done: deque = deque(maxlen=depth)
        self.undone: list = []

    def edit(self, name: str, change: Callable[[DataFrame], DataFrame], back: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
        """``back`` makes the undone version from (before, after) where that is not simply the one before."""
        before = self.tables[name]
        after = change(before)
        self.done.append((name, before, after, back))
        self.undone.clear()
        self.tables[name] = after
        return after

    def undo(self) -> bool:
        if not self.done:
            return False
        name, before, after, back = step = self.done.pop()
        self.undone.append(step)
        self.tables[name] = back(before, after) if back else before
        return True

    def redo(self) -> bool:
        if not self.undone:
            return False
        step = self.undone.pop()
        self.done.append(step)
        self.tables[step[0]] = step[2]
        return True


def keep_unselected(before: DataFrame, after: DataFrame) -> DataFrame:
    """Undoing a delete brings points back to life and leaves the selection as the delete made it."""
    old = before.select(F.col("point_id").alias("__id"), F.col("alive").alias("__alive"))
    return after.join(old, after.point_id == F.col("__id")).withColumn("alive", F.col("__alive")).drop("__id", "__alive")


def recent(log: DataFrame, order: Column, depth: int = DEPTH) -> DataFrame:
    """The last rows of each log (column log_id), newest first."""
    return log.withColumn("age", F.row_number().over(W.partitionBy("log_id").orderBy(order.desc()))).where(F.col("age") <= depth)


def replay(log: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(log_id, applied, redoable): the edits in force after a log (log_id, seq, kind) of edit, undo and redo rows, in order.

    A log is one user's session. Its rows are folded in order in a task, with at most ``depth`` edits that can still be undone held.
    """
    import pandas as pd

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        done, undone, fixed = deque(), [], 0
        for seq, kind in rows.sort_values("seq")[["seq", "kind"]].itertuples(index=False):
            if kind == "undo":
                if done:
                    undone.append(done.pop())
            elif kind == "redo":
                if undone:
                    done.append(undone.pop())
            else:
                done.append(seq)
                undone.clear()
            if len(done) > depth:
                done.popleft()
                fixed += 1
        return pd.DataFrame({"log_id": [rows["log_id"].iloc[0]], "applied": [fixed + len(done)], "redoable": [len(undone)]})

    return log.groupBy("log_id").applyInPandas(fold, "log_id long, applied long, redoable long")


def smoothed_rate(ticks: DataFrame, keep: float = 0.9, every: int = 30) -> DataFrame:
    """(log_id, n, rate): the exponentially smoothed rate 1 / dt of each log (log_id, seq, dt), at every 30th tick.

    dt is held at 0.1 from above; a tick without time counts and leaves the rate as it is. The recurrence is a sum of powers,
    taken over blocks of ticks.
    """
    w = W.partitionBy("log_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    counted = ticks.withColumn("n", F.row_number().over(W.partitionBy("log_id").orderBy("seq"))).withColumn("m", F.sum(F.when(F.col("dt") > 0, 1).otherwise(0)).over(w))
    # within a block of moving ticks the weights stay in range; blocks are joined by a fold over one row each
    moving = counted.where("dt > 0").select("log_id", "m", F.floor((F.col("m") - 1) / every).alias("block"), ((F.col("m") - 1) % every).alias("at"), ((1 - keep) / F.least(F.col("dt"), F.lit(0.1))).alias("v"))
    ahead = W.partitionBy("log_id", "block").orderBy("m").rowsBetween(W.unboundedPreceding, 0)
    part = moving.withColumn("s", F.pow(F.lit(keep), F.col("at")) * F.sum(F.col("v") * F.pow(F.lit(keep), -F.col("at"))).over(ahead))
    power = keep**every
    before = W.partitionBy("log_id").orderBy("block").rowsBetween(-40, 0)  # power ** 40 is below 1e-54
    ends = part.where(F.col("at") == every - 1).withColumn("all", F.collect_list("s").over(before))
    held = ends.select("log_id", (F.col("block") + 1).alias("block"), F.aggregate("all", F.lit(0.0), lambda a, s: a * power + s).alias("held"))
    rates = part.join(held, ["log_id", "block"], "left").select("log_id", "m", (F.col("s") + F.coalesce("held", F.lit(0.0)) * F.pow(F.lit(keep), F.col("at") + 1)).alias("rate"))
    return counted.where(F.col("n") % every == 0).join(rates, ["log_id", "m"], "left").select("log_id", "n", F.coalesce("rate", F.lit(0.0)).alias("rate"))


def fly(keys: DataFrame, speed: float = 5.0, acceleration: float = 20.0, damping: float = 8.0) -> DataFrame:
    """(log_id, seq, px, py, pz, vx, vy, vz): a camera's place and velocity after each tick (log_id, seq, dt, ahead, side, rise, yaw, pitch).

    ahead, side and rise are -1, 0 or 1, as keys are held; yaw is in degrees from -z towards x, y is up. Keys make a unit
    direction; velocity is accelerated, damped and capped, so each tick depends on the one before: a log, the session of one
    user, is folded in order in one task.
    """
    import numpy as np
    import pandas as pd

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        yaw, pitch = np.radians(rows["yaw"].to_numpy(float)), np.radians(rows["pitch"].to_numpy(float))
        ahead = np.stack([np.cos(pitch) * np.sin(yaw), np.sin(pitch), -np.cos(pitch) * np.cos(yaw)], axis=1)
        right = np.stack([-ahead[:, 2], np.zeros(len(rows)), ahead[:, 0]], axis=1)
        size = np.sqrt((right * right).sum(axis=1, keepdims=True))
        right = np.where(size > 1e-6, right / np.maximum(size, 1e-12), [1.0, 0.0, 0.0])
        want = ahead * rows[["ahead"]].to_numpy(float) + right * rows[["side"]].to_numpy(float)
        want[:, 1] += rows["rise"].to_numpy(float)
        size = np.sqrt((want * want).sum(axis=1, keepdims=True))
        want = np.where(size > 1e-6, want / np.maximum(size, 1e-12), want)
        p, v, out = np.zeros(3), np.zeros(3), np.empty((len(rows), 6))
        for i, dt in enumerate(rows["dt"].to_numpy(float)):
            v = (v + acceleration * dt * want[i]) * max(0.0, 1 - damping * dt)
            fast = float(np.sqrt(v @ v))
            if fast > speed:
                v = v * (speed / fast)
            p = p + v * dt
            out[i, :3], out[i, 3:] = p, v
        return rows[["log_id", "seq"]].assign(**{c: out[:, i] for i, c in enumerate(("px", "py", "pz", "vx", "vy", "vz"))})

    return keys.groupBy("log_id").applyInPandas(fold, "log_id long, seq long, px double, py double, pz double, vx double, vy double, vz double")


def look(deltas: DataFrame, sensitivity: float = 0.1) -> DataFrame:
    """(log_id, yaw, pitch) after all (log_id, seq, dx, dy): yaw adds up, pitch is held within 89 degrees at each step.

    A log is one session of one user; its steps are folded in order.
    """
    steps = F.array_sort(F.collect_list(F.struct("seq", "dx", "dy")))
    bound = lambda x: F.greatest(F.lit(-89.0), F.least(F.lit(89.0), x))
    return deltas.groupBy("log_id").agg(steps.alias("steps")).select("log_id", F.aggregate("steps", F.lit(0.0), lambda a, s: a + s["dx"] * sensitivity).alias("yaw"), F.aggregate("steps", F.lit(0.0), lambda a, s: bound(a - s["dy"] * sensitivity)).alias("pitch"))


def live_counts(events: DataFrame, late: str = "10 minutes", wide: str = "5 minutes") -> DataFrame:
    """Edits of each kind in windows of time, for a stream or a table of (ts, kind)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", wide), "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "kind", "n")
