"""Token ids in binary files, coded by a static range asymmetric numeral system (rANS).

All files of a corpus share one table of symbol frequencies, taken from all of its ids. A file holds the documents of
one range of ids, in ascending order, as independent blocks; a block is a grid of steps by lanes, each lane a coder of
its own, whose words share one stream. Every ``SEGMENT`` steps the coder leaves a checkpoint (the lanes' states and the
place in the stream) and a checksum, so that all segments of a file decode side by side, as rows of one array.

File: magic, blocks (one after the other), then a footer (JSON directory and document columns) and its length.
Null text is empty text: it has the end id alone. Rows with equal doc_id are documents of their own, ordered by a hash
of their text; rows without doc_id come first. An empty table gives no files.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumispan.llm.common import filesystem, make_dir, materialize, scratch, small_slices
from lumispan.llm.wordbpe import encoder

MAGIC = b"LSRANS01"
BITS = 20  # frequencies sum to 2**BITS
LANES = 128
SEGMENT = 256  # steps between checkpoints
SEGMENTS = 8  # in a block
BLOCK = LANES * SEGMENT * SEGMENTS
LOW = np.uint64(1 << 31)
U32, U63 = np.uint64(32), np.uint64(63 - BITS)
SLOTS = np.uint64((1 << BITS) - 1)


def scale(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**BITS, at least 1 where there is a count."""
    counts = counts.astype(np.float64)
    total = counts.sum()
    if not total:
        return np.zeros(len(counts), np.int64)
    if (counts > 0).sum() > 1 << BITS:
        raise ValueError("more symbols than slots")
    freq = np.where(counts > 0, np.maximum(1, np.floor(counts * ((1 << BITS) / total))), 0).astype(np.int64)
    over = int(freq.sum()) - (1 << BITS)
    order = np.argsort(-freq, kind="stable")
    if over < 0:
        freq[order[0]] -= over
    for i in order:
        if over <= 0:
            break
        cut = min(over, int(freq[i]) - 1)
        freq[i] -= cut
        over -= cut
    return freq


class Tables:
    """What coder and decoder look up, from the frequencies."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.low = (np.cumsum(freq) - freq).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.most = self.freq << U63
        self.pad = int(np.argmax(freq))

    def encode(self, blocks: np.ndarray) -> list[bytes]:
        """Each row of ``blocks`` (blocks, steps * LANES) as the bytes of one block; steps is a multiple of SEGMENT."""
        n, steps = len(blocks), blocks.shape[1] // LANES
        grid = blocks.reshape(n, steps, LANES)
        x = np.full((n, LANES), LOW)
        words = np.empty((n, steps, LANES), np.uint32)
        out = np.zeros((n, steps, LANES), bool)
        states = np.empty((n, steps // SEGMENT, LANES), np.uint64)
        for t in range(steps - 1, -1, -1):
            s = grid[:, t]
            full = x >= self.most[s]
            out[:, t] = full
            words[:, t] = x
            x = np.where(full, x >> U32, x)
            f = self.freq[s]
            q = x // f
            x = (q << np.uint64(BITS)) + (x - q * f) + self.low[s]
            if t % SEGMENT == 0:
                states[:, t // SEGMENT] = x
        found = []
        for b in range(n):
            heads, body = [], []
            for k in range(steps // SEGMENT):
                span = slice(k * SEGMENT, (k + 1) * SEGMENT)
                part = words[b, span][out[b, span]].astype("<u4").tobytes()
                lead = states[b, k].astype("<u8").tobytes()
                heads.append(struct.pack("<II", len(part), zlib.crc32(part, zlib.crc32(lead))) + lead)
                body.append(part)
            found.append(struct.pack("<I", len(heads)) + b"".join(heads) + b"".join(body))
        return found

    def decode(self, blocks: list[bytes]) -> list[np.ndarray]:
        """The ids of each block, padding included; raises ValueError on a broken checksum."""
        states, streams, starts, counts = [], [], [], []
        at = 0
        for raw in blocks:
            (k,) = struct.unpack_from("<I", raw)
            counts.append(k)
            head, body = 4, 4 + k * (8 + 8 * LANES)
            for _ in range(k):
                size, check = struct.unpack_from("<II", raw, head)
                lead, part = raw[head + 8 : head + 8 + 8 * LANES], raw[body : body + size]
                if zlib.crc32(part, zlib.crc32(lead)) != check:
                    raise ValueError("broken segment")
                states.append(np.frombuffer(lead, "<u8"))
                streams.append(np.frombuffer(part, "<u4"))
                starts.append(at)
                at += size // 4
                head, body = head + 8 + 8 * LANES, body + size
        x = np.array(states, np.uint64).reshape(-1, LANES)
        words = np.concatenate([*streams, np.zeros(LANES, "<u4")]).astype(np.uint64)
        place = np.array(starts, np.int64)
        ids = np.empty((len(x), SEGMENT, LANES), np.uint32)
        for t in range(SEGMENT):
            slot = x & SLOTS
            s = self.slot[slot]
            ids[:, t] = s
            x = self.freq[s] * (x >> np.uint64(BITS)) + slot - self.low[s]
            short = x < LOW
            reads = np.cumsum(short, axis=1)
            x = np.where(short, (x << U32) | words[place[:, None] + np.maximum(reads - 1, 0)], x)
            place += reads[:, -1]
        flat, out, at = ids.reshape(len(ids), -1), [], 0
        for k in counts:
            out.append(flat[at : at + k].reshape(-1))
            at += k
        return out


class FileWriter:
    """One file of documents in order; closes under its final name, so a lost attempt leaves no file that is read."""

    def __init__(self, folder: str, name: str, tables: Tables, group: int = 8):
        self.uri, self.tables, self.group = f"{folder}/{name}", tables, group
        self.fs, self.path = filesystem(self.uri)
        self.out = self.fs.open_output_stream(self.path + ".part")
        self.out.write(MAGIC)
        self.at, self.held, self.n_held = len(MAGIC), [], 0
        self.directory, self.docs, self.n_tokens = [], [], 0

    def add(self, doc_id: int | None, start: int, ids: np.ndarray) -> None:
        self.docs.append((doc_id, start, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_tokens += len(ids)
        if self.n_held >= self.group * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        whole = len(ids) // BLOCK * BLOCK
        for at in range(0, whole, self.group * BLOCK):
            part = ids[at : min(whole, at + self.group * BLOCK)]
            self._put(part.reshape(-1, BLOCK), BLOCK)
        rest = ids[whole:]
        if last and len(rest):
            unit = LANES * SEGMENT
            padded = np.full(-(-len(rest) // unit) * unit, self.tables.pad, rest.dtype)
            padded[: len(rest)] = rest
            self._put(padded.reshape(1, -1), len(rest))
            rest = rest[:0]
        self.held, self.n_held = [rest], len(rest)

    def _put(self, blocks: np.ndarray, n: int) -> None:
        for raw in self.tables.encode(blocks):
            self.out.write(raw)
            self.directory.append((self.at, len(raw), n))
            self.at += len(raw)

    def close(self) -> tuple[str, int, int, int]:
        self._flush(True)
        ids = np.array([d[0] or 0 for d in self.docs], "<i8")
        columns = [ids, np.array([d[0] is not None for d in self.docs], "u1"), np.array([d[1] for d in self.docs], "<i8"), np.array([d[2] for d in self.docs], "<i8")]
        head = json.dumps({"blocks": self.directory, "docs": len(self.docs)}).encode()
        foot = struct.pack("<I", len(head)) + head + b"".join(c.tobytes() for c in columns)
        self.out.write(foot + struct.pack("<I", zlib.crc32(foot)) + struct.pack("<Q", len(foot)))
        self.out.close()
        self.fs.move(self.path + ".part", self.path)
        return self.uri, len(self.docs), self.n_tokens, self.at


def read_file(uri: str, tables: Tables, group: int = 8) -> Iterator[tuple[int | None, int, int, list[np.ndarray]]]:
    """(doc_id, start, n_tokens, parts of its ids) of each document of a file, a few blocks in memory at a time."""
    f, path = filesystem(uri)
    with f.open_input_file(path) as src:
        size = src.size()
        (n,) = struct.unpack("<Q", src.read_at(8, size - 8))
        foot = src.read_at(n, size - 12 - n)
        if struct.unpack("<I", src.read_at(4, size - 12))[0] != zlib.crc32(foot) or src.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{uri}: not a whole file")
        (k,) = struct.unpack_from("<I", foot)
        head, at = json.loads(foot[4 : 4 + k]), 4 + k
        d, columns = head["docs"], []
        for kind in ("<i8", "u1", "<i8", "<i8"):
            columns.append(np.frombuffer(foot, kind, d, at))
            at += d * np.dtype(kind).itemsize

        def parts():
            for i in range(0, len(head["blocks"]), group):
                some = head["blocks"][i : i + group]
                for ids, (_, _, m) in zip(tables.decode([src.read_at(length, off) for off, length, _ in some]), some, strict=True):
                    yield ids[:m]

        stream, held = parts(), np.zeros(0, np.uint32)
        for doc_id, there, start, m in zip(*(c.tolist() for c in columns), strict=True):
            got, need = [], m
            while need:
                if not len(held):
                    held = next(stream)
                got.append(held[:need])
                need -= len(got[-1])
                held = held[len(got[-1]) :]
            yield doc_id if there else None, start, m, got


def tokenize_sorted(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Table of (part, seq, doc_id, part_start, n_tokens, ids), parts in ascending order of doc_id; rows with part null hold a part's counts."""
    schema = "part int, seq long, doc_id long, part_start long, n_tokens long, ids binary, counts binary"

    def run(batches):
        from pyspark import TaskContext

        part, enc, seq, at, counts = TaskContext.get().partitionId(), encoder(path), 0, 0, None
        counts = np.zeros(max(enc.vocab_size, end_id + 1), np.int64)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            for some in small_slices(batch, "text"):
                raw = [x + end for x in enc.encode_bytes(pc.fill_null(some.column("text"), ""))]
                n = np.array([len(x) // enc.dtype.itemsize for x in raw], np.int64)
                counts += np.bincount(np.frombuffer(b"".join(raw), enc.dtype), minlength=len(counts))
                starts = at + np.cumsum(n) - n
                k = len(raw)
                yield pa.RecordBatch.from_arrays([pa.array([part] * k, pa.int32()), pa.array(range(seq, seq + k), pa.int64()), some.column("doc_id").cast(pa.int64()), pa.array(starts), pa.array(n), pa.array(raw, pa.binary()), pa.nulls(k, pa.binary())], names=names)
                seq, at = seq + k, at + int(n.sum())
        if seq:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())), pa.array([counts.tobytes()], pa.binary())], names=names)

    names = [x.split()[0] for x in schema.split(", ")]
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return materialize(ordered.mapInArrow(run, schema), "tokens")


def symbol_counts(tokens: DataFrame) -> dict[int, int]:
    """Count of each id over all documents; at most one entry for each id of the vocabulary."""

    def run(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                counts = np.frombuffer(raw, np.int64)
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["id", "n"])

    found = tokens.where(F.col("counts").isNotNull()).select("counts").mapInArrow(run, "id int, n long")
    return {r.id: r.n for r in found.groupBy("id").agg(F.sum("n").alias("n")).collect()}


def write_corpus(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 1) -> tuple[DataFrame, np.ndarray]:
    """Encode ``docs`` (doc_id, text) into files under ``folder``; returns the manifest (uri, part, seq, n_docs, n_tokens, bytes) and the frequencies."""
    spark = docs.sparkSession
    folder = make_dir(folder or scratch(spark, "rans"))
    tokens = tokenize_sorted(docs, tokenizer_path, end_id)
    counts = symbol_counts(tokens)
    freq = scale(np.bincount(list(counts), list(counts.values()), minlength=max([end_id, *counts]) + 1)) if counts else np.zeros(end_id + 1, np.int64)
    # one row a partition of the sort, so its size follows the number of tasks and not that of documents
    base, bases = 0, {}
    for r in tokens.where("part is not null").groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        bases[r.part] = base
        base += r.n
    wide = np.dtype("<u2" if _fits(tokenizer_path) else "<u4")

    def run(batches):
        tables = Tables(freq)
        writer, last = None, (None, None)
        manifest = []
        for batch in batches:
            for part, seq, doc_id, start, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "doc_id", "part_start", "ids")), strict=True):
                if (part, seq - 1) != last:
                    if writer:
                        manifest.append((*key, *writer.close()))
                    key = (part, seq)
                    writer = FileWriter(folder, f"part-{part:08d}-{seq:012d}-{uuid.uuid4().hex[:8]}.rans", tables)
                last = (part, seq)
                writer.add(doc_id, bases[part] + start, np.frombuffer(raw, wide).astype(np.uint32))
        if writer:
            manifest.append((*key, *writer.close()))
        if manifest:
            part, seq, uri, n_docs, n_tokens, size = zip(*manifest, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(seq, pa.int64()), pa.array(uri), pa.array(n_docs, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(size, pa.int64())], names=["part", "seq", "uri", "n_docs", "n_tokens", "bytes"])

    rows = tokens.where("part is not null").select("part", "seq", "doc_id", "part_start", "ids")
    manifest = rows.mapInArrow(run, "part int, seq long, uri string, n_docs long, n_tokens long, bytes long")
    return materialize(manifest, "rans-manifest"), freq


def _fits(path: str) -> bool:
    return encoder(path).dtype.itemsize == 2


def read_corpus(manifest: DataFrame, freq: np.ndarray, use: Callable | None = None, schema: str = "doc_id long, start long, n_tokens long, ids array<int>") -> DataFrame:
    """Decode all files; ``use(doc_id, start, n, parts)`` gives a row, by default with the ids as an array."""
    use = use or (lambda doc_id, start, n, parts: (doc_id, start, n, np.concatenate(parts).astype(np.int32)))
    types = manifest.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(types)

    def run(batches):
        tables = Tables(freq)
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows = []
                for row in read_file(uri, tables):
                    rows.append(use(*row))
                    if len(rows) == 2048:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    n = max(1, manifest.count())
    return manifest.select("uri").repartition(n).mapInArrow(run, types)


def checksum(doc_id: int | None, start: int, n: int, parts: list[np.ndarray]) -> tuple:
    crc = 0
    for p in parts:
        crc = zlib.crc32(p.astype("<u4").tobytes(), crc)
    return doc_id, start, n, crc


def encoded_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from files written and read back."""
    manifest, freq = write_corpus(docs, tokenizer_path, end_id=end_id)
    return read_corpus(manifest, freq, checksum, "doc_id long, start long, n_tokens long, ids_crc32 long")
