"""Logs of user sessions as keyed state: edits, cameras, anchor pairs and lassos, in micro-batches or over a whole table.

A log is (log_id, seq, ...). Each function takes a stream or a table. State is kept by log_id between micro-batches, in RocksDB and in
the stream's checkpoint, so a query that is started again goes on where it was. A table has no next batch: its tasks hold the state of
the log they are at, and no store is asked.

Order: the rows of a micro-batch are applied by seq, and batches as they come. A row at or before the last seq applied to its log
comes late or again: it changes nothing and is counted in ``late``; so is a row without seq. Rows of equal seq in a batch count once, the
least by its other columns. Rows with a null log_id are one log. An empty table gives no rows, columns not named here are ignored.

Memory: a micro-batch holds its rows of one log (bound it at the source, as with maxFilesPerTrigger). A table is sorted by Spark and
read in Arrow batches, so that a log of any length passes through one task in bounded memory.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import chain
from math import cos, isfinite, nan, radians, sin, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumispan.streaming.session import DEPTH

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NO_SEQ = -(2**63)
SLICE = 10_000  # rows that a task hands on at once


class _Value:
    """The state of one value in a task, with the calls of Spark's."""

    def __init__(self):
        self.value = None

    def get(self) -> tuple | None:
        return self.value

    def update(self, value: tuple) -> None:
        self.value = value

    def clear(self) -> None:
        self.value = None


class _List(_Value):
    def get(self) -> Iterator[tuple]:
        return iter(self.value or [])

    put = _Value.update


class _Map(dict):
    containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.pop  # noqa: N815


class _InTask:
    """A handle of states that a task holds while it reads one log of a table."""

    def getValueState(self, name: str, schema: str) -> _Value:  # noqa: N802
        return _Value()

    def getListState(self, name: str, schema: str) -> _List:  # noqa: N802
        return _List()

    def getMapState(self, name: str, key: str, value: str) -> _Map:  # noqa: N802
        return _Map()


class _Ordered(StatefulProcessor):
    """Hands rows to ``step`` in order; ``load`` and ``save`` move what it needs between a log's state and fields."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.marks = handle.getValueState("marks", "last long, late long")
        self.open(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, late = self.marks.get() or (NO_SEQ, 0)
        self.load()
        chunk = _in_order(pd.concat(list(rows)))
        fresh = chunk[chunk["seq"] > last].drop_duplicates("seq")
        late += len(chunk) - len(fresh)
        if len(fresh):
            last = int(fresh["seq"].iloc[-1])
        out = [row for event in fresh.drop(columns=["log_id", "nameless"]).itertuples(index=False) for row in self.step(event)]
        if out:
            yield self.frame([key] * len(out), out)
        self.marks.update((last, late))
        self.save()
        done = self.result(late, last)
        if done:
            yield self.frame([key], [done])

    def over_table(self, chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Logs one after the other, as :meth:`handleInputRows` takes them, from rows sorted by log and seq."""
        at, last, late, keys, out = None, NO_SEQ, 0, [], []
        for event in chain(_one_a_seq(chunks), (None,)):
            key = None if event is None else (event.log_id, event.nameless)
            if key != at:
                done = self.result(late, last) if at else None
                if done:
                    keys.append(at)
                    out.append(done)
                at, last, late = key, NO_SEQ, 0
                self.open(_InTask())
                self.load()
            if event is not None:
                late += event.again
                if event.seq == NO_SEQ:
                    late += 1
                else:
                    last = event.seq
                    made = self.step(event)
                    keys += [key] * len(made)
                    out += made
            if len(out) >= SLICE or out and event is None:
                yield self.frame(keys, out)
                keys, out = [], []

    def frame(self, keys: list[tuple], rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=self.columns, dtype=object)  # integers stay whole beside missing ones
        out.insert(0, "log_id", pd.array([None if nameless else i for i, nameless in keys], dtype="Int64"))
        return out

    def result(self, late: int, last: int) -> tuple | None:
        return None

    def close(self) -> None:
        pass


def _in_order(chunk: pd.DataFrame) -> pd.DataFrame:
    # stable sorts, the deciding column last: text and missing values compare as text
    keys = ("seq", "nameless", "log_id")
    return chunk.iloc[np.lexsort([chunk[c].astype(str) for c in reversed(chunk.columns) if c not in (*keys, "again")] + [chunk[c] for c in keys])]


def _one_a_seq(chunks: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """The first row in order of each (log, seq), with the number of its others as ``again``; chunks may cut them anywhere."""
    names, held = ["log_id", "nameless", "seq"], None
    for chunk in chunks:
        if not len(chunk):
            continue
        chunk = chunk.assign(again=0)
        if held is not None and (held[names].iloc[0] == chunk[names].iloc[0]).all():
            chunk = pd.concat([held, chunk], ignore_index=True)
        elif held is not None:
            yield from held.itertuples(index=False)
        place = [chunk[c].to_numpy() for c in names]
        new = np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in place]))
        if not new.all():
            first = np.flatnonzero(new)
            again = np.add.reduceat(chunk["again"].to_numpy() + 1, first) - 1
            chunk = _in_order(chunk).iloc[first].assign(again=again)
        yield from chunk.iloc[:-1].itertuples(index=False)
        held = chunk.iloc[-1:]
    if held is not None:
        yield from held.itertuples(index=False)


def _fold(log: DataFrame, columns: list[str], processor: _Ordered, schema: str) -> DataFrame:
    spark = log.sparkSession
    # the key is never null, as workers tell rows of null keys apart
    rows = log.select(F.coalesce(F.col("log_id").cast("long"), F.lit(0)).alias("log_id"), F.col("log_id").isNull().alias("nameless"), F.coalesce(F.col("seq").cast("long"), F.lit(NO_SEQ)).alias("seq"), *columns)
    if not log.isStreaming:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # given, as tasks that are small in bytes take long in Python
        return rows.repartition(parts, "log_id", "nameless").sortWithinPartitions("log_id", "nameless", "seq", *columns).mapInPandas(processor.over_table, schema)
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKS:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # keyed state of several variables has no other store
    return rows.groupBy("log_id", "nameless").transformWithStateInPandas(processor, schema, "Update", "None")


class _Undo(_Ordered):
    columns = ("applied", "redoable", "late", "last_seq")

    def __init__(self, depth: int):
        self.depth = depth

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.done_state, self.undone_state = (handle.getListState(n, "seq long") for n in ("done", "undone"))
        self.fixed_state = handle.getValueState("fixed", "n long")

    def load(self) -> None:
        self.done, self.undone = (deque(r[0] for r in s.get()) for s in (self.done_state, self.undone_state))
        self.fixed = (self.fixed_state.get() or (0,))[0]

    def step(self, event) -> list[tuple]:
        if event.kind == "undo":
            if self.done:
                self.undone.append(self.done.pop())
        elif event.kind == "redo":
            if self.undone:
                self.done.append(self.undone.pop())
        else:
            self.done.append(int(event.seq))
            self.undone.clear()
            if len(self.done) > self.depth:
                self.done.popleft()
                self.fixed += 1
        return []

    def save(self) -> None:
        for state, held in ((self.done_state, self.done), (self.undone_state, self.undone)):
            if held:
                state.put([(x,) for x in held])
            else:
                state.clear()
        self.fixed_state.update((self.fixed,))

    def result(self, late: int, last: int) -> tuple:
        return self.fixed + len(self.done), len(self.undone), late, None if last == NO_SEQ else last


def replay(log: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(log_id, applied, redoable, late, last_seq): the edits in force after the edit, undo and redo rows (log_id, seq, kind) of a log.

    One row for each log that a micro-batch touches; that of the latest batch holds. List state keeps at most ``depth`` edits that can
    be undone, and as many that can be redone. Any other kind, null as well, is an edit.
    """
    return _fold(log, ["kind"], _Undo(depth), "log_id long, applied long, redoable long, late long, last_seq long")


def _number(x) -> float:
    return 0.0 if x is None or x != x else float(x)


class _Camera(_Ordered):
    columns = ("seq", "px", "py", "pz", "vx", "vy", "vz", "yaw", "pitch", "n_held")

    def __init__(self, speed: float, acceleration: float, damping: float, sensitivity: float):
        self.speed, self.acceleration, self.damping, self.sensitivity = speed, acceleration, damping, sensitivity

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.keys_state = handle.getMapState("held", "key string", "down boolean")
        self.at_state = handle.getValueState("at", ", ".join(f"{c} double" for c in self.columns[1:9]))

    def load(self) -> None:
        self.held = {k[0] for k in self.keys_state.keys()}
        self.before = set(self.held)
        at = self.at_state.get() or (0.0,) * 8
        self.p, self.v, self.yaw, self.pitch = tuple(at[:3]), tuple(at[3:6]), at[6], at[7]

    def _want(self) -> tuple[float, float, float]:
        """The direction that the held keys pull to, of length 1 or null; plain floats, as arrays of three take ten times as long."""
        held = self.held
        ahead, side, rise = (("w" in held) - ("s" in held)), (("d" in held) - ("a" in held)), (("space" in held) - ("shift" in held))
        if isfinite(self.yaw):
            if not (ahead or side or rise):
                return 0.0, 0.0, 0.0
            sy, cy = sin(radians(self.yaw)), cos(radians(self.yaw))
        else:
            sy = cy = nan
        sp, cp = sin(radians(self.pitch)), cos(radians(self.pitch))
        x = ahead * (cp * sy) + side * cy
        y = ahead * sp + rise
        z = ahead * (-cp * cy) + side * sy
        size = sqrt(x * x + y * y + z * z)
        return (x / size, y / size, z / size) if size > 1e-6 else (x, y, z)

    def step(self, event) -> list[tuple]:
        kind = event.kind
        if kind == "tick":
            dt = _number(event.a)
            (px, py, pz), (vx, vy, vz) = self.p, self.v
            wx, wy, wz = self._want()
            push, keep = self.acceleration * dt, max(0.0, 1 - self.damping * dt)
            vx, vy, vz = (vx + wx * push) * keep, (vy + wy * push) * keep, (vz + wz * push) * keep
            fast = sqrt(vx * vx + vy * vy + vz * vz)
            if fast > self.speed:
                less = self.speed / fast
                vx, vy, vz = vx * less, vy * less, vz * less
            self.v = vx, vy, vz
            self.p = px, py, pz = px + vx * dt, py + vy * dt, pz + vz * dt
            return [(int(event.seq), px, py, pz, vx, vy, vz, self.yaw, self.pitch, len(self.held))]
        if kind == "down":
            if event.key:
                self.held.add(event.key)
        elif kind == "up":
            self.held.discard(event.key)
        elif kind == "blur":
            self.held.clear()
            self.v = (0.0, 0.0, 0.0)
        elif kind == "look":
            self.yaw += _number(event.a) * self.sensitivity
            self.pitch = min(89.0, max(-89.0, self.pitch - _number(event.b) * self.sensitivity))
        return []

    def save(self) -> None:
        for k in self.before - self.held:
            self.keys_state.removeKey((k,))
        for k in self.held - self.before:
            self.keys_state.updateValue((k,), (True,))
        self.at_state.update((*self.p, *self.v, self.yaw, self.pitch))


def cameras(log: DataFrame, speed: float = 5.0, acceleration: float = 20.0, damping: float = 8.0, sensitivity: float = 0.1) -> DataFrame:
    """(log_id, seq, px, py, pz, vx, vy, vz, yaw, pitch, n_held) after each tick of a log (log_id, seq, kind, key, a, b).

    Kinds: ``down`` and ``up`` of a key (w, s, a, d, space and shift move; others are held without effect), ``blur`` lets go of all keys
    and stops, ``look`` by a and b pixels, ``tick`` of a seconds. Other kinds and missing keys do nothing, missing numbers are 0. Held
    keys are map state; place, velocity and angles one value.
    """
    columns = [F.col(c) for c in ("kind", "key")] + [F.col(c).cast("double").alias(c) for c in "ab"]
    return _fold(log.select("log_id", "seq", *columns), ["kind", "key", "a", "b"], _Camera(speed, acceleration, damping, sensitivity), "log_id long, seq long, px double, py double, pz double, vx double, vy double, vz double, yaw double, pitch double, n_held int")


class _Pairs(_Ordered):
    columns = ("seq", "change", "p_idx", "s_idx")

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.active_state = handle.getValueState("active", "side string, idx long")
        self.second_of, self.first_of = (handle.getMapState(n, "idx long", "other long") for n in ("by_primary", "by_secondary"))

    def load(self) -> None:
        self.active = self.active_state.get()

    def step(self, event) -> list[tuple]:
        if event.kind not in ("primary", "secondary") or pd.isna(event.idx):
            self.active = None
            return []
        if not self.active or self.active[0] == event.kind:
            self.active = (event.kind, int(event.idx))
            return []
        p, s = (int(event.idx), self.active[1]) if event.kind == "primary" else (self.active[1], int(event.idx))
        self.active, gone = None, set()
        if self.second_of.containsKey((p,)):
            gone.add((p, self.second_of.getValue((p,))[0]))
        if self.first_of.containsKey((s,)):
            gone.add((self.first_of.getValue((s,))[0], s))
        for a, b in gone:
            self.second_of.removeKey((a,))
            self.first_of.removeKey((b,))
        self.second_of.updateValue((p,), (s,))
        self.first_of.updateValue((s,), (p,))
        return [(int(event.seq), "unpair", a, b) for a, b in sorted(gone)] + [(int(event.seq), "pair", p, s)]

    def save(self) -> None:
        if self.active:
            self.active_state.update(self.active)
        else:
            self.active_state.clear()


def pair_changes(log: DataFrame) -> DataFrame:
    """(log_id, seq, change, p_idx, s_idx): pairs of anchors made (pair) and displaced (unpair) by clicks (log_id, seq, kind, idx).

    A click on an anchor of a kind, ``primary`` or ``secondary``, after one on the other kind makes a pair; pairs that share an end with
    it go, so pairs stay one to one (the same pair again is displaced and made). A second click of one kind replaces the first, any
    other kind or a missing idx is a miss and forgets it. Two maps by end are state, read by key.
    """
    return _fold(log.withColumn("idx", F.col("idx").cast("long")), ["kind", "idx"], _Pairs(), "log_id long, seq long, change string, p_idx long, s_idx long")


def pairs_now(changes: DataFrame) -> DataFrame:
    """(log_id, p_idx, s_idx) that :func:`pair_changes` leaves in force; null log_ids are one log."""
    last = changes.groupBy("log_id", "p_idx", "s_idx").agg(F.max(F.struct("seq", (F.col("change") == "pair").alias("on"))).alias("m"))
    return last.where("m.on").select("log_id", "p_idx", "s_idx")


class _Lassos(_Ordered):
    columns = ("lasso", "at", "x", "y")

    def __init__(self, least: float):
        self.least = least

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.drawing_state = handle.getListState("drawing", "x double, y double")

    def load(self) -> None:
        self.path = [tuple(v) for v in self.drawing_state.get()]

    def step(self, event) -> list[tuple]:
        if event.kind == "release":
            path, self.path = self.path, []
            return [(int(event.seq), i, *v) for i, v in enumerate(path)] if len(path) >= 3 else []
        if pd.isna(event.x) or pd.isna(event.y):
            return []
        here = (float(event.x), float(event.y))
        if event.kind == "press":
            self.path = [here]
        elif event.kind == "move" and self.path and max(abs(here[0] - self.path[-1][0]), abs(here[1] - self.path[-1][1])) > self.least:
            self.path.append(here)
        return []

    def save(self) -> None:
        if self.path:
            self.drawing_state.put(self.path)
        else:
            self.drawing_state.clear()


def lassos(log: DataFrame, least: float = 2.0) -> DataFrame:
    """(log_id, lasso, at, x, y): the vertices of each finished lasso, named by the seq of its release, in order from 0.

    A log is (log_id, seq, kind, x, y) of ``press``, ``move`` and ``release``. A vertex stays if it moved more than ``least`` pixels in x
    or y from the one kept before; a lasso of fewer than three goes. Moves without a press, other kinds and missing places do nothing;
    a press begins anew. Vertices of an open lasso are list state.
    """
    return _fold(log.withColumns({c: F.col(c).cast("double") for c in "xy"}), ["kind", "x", "y"], _Lassos(least), "log_id long, lasso long, at int, x double, y double")
