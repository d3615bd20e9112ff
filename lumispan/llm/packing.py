"""Harmonic packing of tokenized documents into sequences of a fixed capacity.

A document longer than the capacity first fills whole sequences. What is left, of length r, belongs to the class
k = capacity // r, whose sequences hold k pieces each. A piece that would leave more than ``slack`` of its share
(capacity // k) empty is cut: the largest exact share that fits goes to its own class and the rest is classed again, so
that little padding stays. Each task fills the sequences of each class by itself. What does not fill a sequence (fewer than
k pieces of class k in each task) goes on to rounds that each join the rest of ``FAN`` groups, until one group is left,
whose pieces are placed by first fit. What a group takes on is bounded by the classes, not by the number of rows.

Null text is empty text: it has the end id alone. Repeated rows are documents of their own. An empty table gives none.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumispan.llm.common import materialize, small_slices
from lumispan.llm.wordbpe import encoder

CAPACITY = 1024
SLACK = 0.02
FAN = 64
COLUMNS = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, grp long, sequence_id long, offset int"
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def cut_lengths(n: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens, in order."""
    out = [capacity] * (n // capacity)
    r = n % capacity
    while r:
        share = capacity // (capacity // r)
        if share - r <= slack * share or r < 8:
            out.append(r)
            break
        exact = capacity // -(-capacity // r)
        out.append(exact)
        r -= exact
    return out


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


class Filler:
    """Fills the sequences of each class; ids are ``base`` and up."""

    def __init__(self, base: int, capacity: int = CAPACITY):
        self.next, self.capacity, self.open = base, capacity, defaultdict(list)

    def add(self, piece: tuple) -> list[tuple]:
        """The pieces of the sequence that this one fills, with sequence_id and offset, or none."""
        k = self.capacity // piece[2]
        held = self.open[k]
        held.append(piece)
        if len(held) < k:
            return []
        del self.open[k]
        return self.close(held)

    def close(self, pieces: list[tuple]) -> list[tuple]:
        out, at = [], 0
        for p in pieces:
            out.append((*p[:6], self.next, at))
            at += p[2]
        self.next += 1
        return out

    def rest(self) -> list[tuple]:
        return [p for held in self.open.values() for p in held]

    def first_fit(self, pieces: list[tuple]) -> list[tuple]:
        """Place the last pieces, longest first, each in the first sequence with room for it."""
        bins: list[list[tuple]] = []
        room: list[int] = []
        for p in sorted(pieces, key=lambda p: (-p[2], p[0] is None, p[0], p[1])):
            i = next((i for i, free in enumerate(room) if free >= p[2]), len(bins))
            if i == len(bins):
                bins.append([])
                room.append(self.capacity)
            bins[i].append(p)
            room[i] -= p[2]
        return [q for b in bins for q in self.close(b)]


def pack_tokens(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, slack: float = SLACK, keep_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents (doc_id, text).

    A sequence is padded to ``capacity`` unless its length is a power of two, which stays as it is.
    """

    def run(batches):
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(path)
        fill = Filler(part << 36, capacity)
        end = np.array([end_id], enc.dtype).tobytes()
        rows: list[tuple] = []
        for batch in batches:
            for some in small_slices(batch, "text"):
                raw = enc.encode_bytes(pc.fill_null(some.column("text"), ""))
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), raw, strict=True):
                    ids = np.frombuffer(ids + end, enc.dtype).astype("<u4")
                    at, data = 0, memoryview(ids.tobytes())
                    for n in cut_lengths(len(ids), capacity, slack):
                        rows += fill.add((doc_id, at, n, zlib.crc32(data[4 * at : 4 * (at + n)]), len(ids), part))
                        at += n
                if rows:
                    yield _table(rows)
                    rows = []
        if rest := fill.rest():
            yield _table([(*p, None, None) for p in rest])

    def again(batches, last: bool, level: int):
        fill, base = None, None
        for batch in batches:
            rows: list[tuple] = []
            for p in zip(*(batch.column(c).to_pylist() for c in _NAMES[:6]), strict=True):
                if fill is None:
                    base = p[5] // FAN
                    fill = Filler(level << 60 | base << 36, capacity)
                rows += fill.add((*p[:5], base))
            if rows:
                yield _table(rows)
        if fill and (rest := fill.rest()):
            yield _table(fill.first_fit(rest) if last else [(*p, None, None) for p in rest])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = materialize(source.mapInArrow(run, COLUMNS), "pieces")
    done, level = [made.where("sequence_id is not null")], 0
    left = made.where("sequence_id is null")
    top = left.agg(F.max("grp")).first()[0]
    while top is not None:
        level += 1
        last = top < FAN
        joined = left.groupBy((F.col("grp") / FAN).cast("long")).applyInArrow(_grouped(again, last, level), COLUMNS)
        made = materialize(joined, "pieces")
        done.append(made.where("sequence_id is not null"))
        left, top = made.where("sequence_id is null"), None if last else top // FAN
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.drop("grp").select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", F.col("offset").cast("long").alias("offset"))


def _grouped(again, last: bool, level: int):
    def one(rows: pa.Table) -> pa.Table:
        ordered = rows.sort_by([("doc_id", "ascending"), ("start", "ascending")])
        found = list(again(ordered.to_batches(), last, level))
        return pa.Table.from_batches(found, schema=pa.schema(list(zip(_NAMES, _TYPES, strict=True))))

    return one
