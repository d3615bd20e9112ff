"""Byte-level BPE encoding with content-defined chunk reuse.

A rolling hash over the bytes of a text cuts it where the content says so, hence equal passages of different documents
fall into equal chunks. The chunks of a batch are encoded once each, and a bounded cache carries the ids of chunks over
to the next batches of the worker. Joins are repaired: the bytes around a join are encoded anew, in a window that
grows until each of its ends is a place that no token and no pre-token crosses and where a token of the chunk ends.

Null text is empty text, which has no ids. Rows are independent; repeated rows and ids give repeated results.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumispan.llm.common import small_slices, worker_cache
from lumispan.llm.wordbpe import WordEncoder, byte_alphabet

WIDTH = 32  # bytes under the rolling hash
CACHE_BYTES = 48 << 20


def cut_points(data: np.ndarray, average: int = 512, least: int = 64) -> list[int]:
    """Ends of the content-defined chunks of ``data`` (uint8), each between two UTF-8 characters; the last is its length."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    powers = np.cumprod(np.full(WIDTH, 0x9E3779B1, np.uint64))
    # hash of the WIDTH bytes before each place, from differences of a prefix sum in a wrapping ring
    scaled = data.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) ^ np.uint64(0x94D049BB133111EB)
    h = np.zeros(n, np.uint64)
    for i in range(5):  # doubling: windows of 1, 2, 4, ... 32 bytes
        step = 1 << i
        scaled = scaled.copy()
        scaled[step:] = scaled[step:] + scaled[:-step] * powers[step - 1]
    h = scaled >> np.uint64(33)
    found = np.flatnonzero(h % np.uint64(average) == 0) + 1
    found = found[(found >= least) & (found < n)]
    found = found[(data[found] & 0xC0) != 0x80]
    ends, last = [], 0
    for x in found.tolist():
        if x - last >= least:
            ends.append(x)
            last = x
    return [*ends, n]


class ChunkEncoder:
    """Encodes texts as the library does, chunk by chunk; ``reused`` and ``chunks`` count what the cache saved."""

    def __init__(self, path: str, average: int = 512):
        self.words = WordEncoder(path)
        if self.words.kind != "byte":
            raise ValueError("a byte-level vocabulary is asked for")
        self.average, self.dtype = average, self.words.dtype
        back = {c: b for b, c in byte_alphabet().items()}
        added = {i: a.content for i, a in self.words.full.get_added_tokens_decoder().items()}
        self.pieces = [added[i].encode() if i in added else bytes(back[c] for c in n) for i, n in enumerate(self.words.names)]
        self.size = np.array([len(p) for p in self.pieces], np.int64)
        self.cache: OrderedDict[bytes, np.ndarray] = OrderedDict()
        self.held = 0
        self.chunks = self.reused = 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [i for i, t in enumerate(texts) if t and self.words._safe(t)]
        out = [np.zeros(0, self.dtype)] * len(texts)
        for i in set(range(len(texts))) - set(plain):
            if texts[i]:
                out[i] = np.frombuffer(self.words._whole(texts[i]), self.dtype)
        raws = [texts[i].encode() for i in plain]
        cuts = [cut_points(np.frombuffer(r, np.uint8), self.average) for r in raws]
        keys = [[r[a:b] for a, b in zip([0, *c[:-1]], c, strict=True)] for r, c in zip(raws, cuts, strict=True)]
        need = {k: None for ks in keys for k in ks}
        self.chunks += sum(map(len, keys))
        for k in need:
            if (ids := self.cache.get(k)) is not None:
                self.cache.move_to_end(k)
                need[k] = ids
        new = [k for k, ids in need.items() if ids is None]
        for k, ids in zip(new, self.words.encode([k.decode() for k in new]), strict=True):
            need[k] = self.cache[k] = ids
            self.held += len(k) + ids.nbytes + 200
        self.reused += sum(map(len, keys)) - len(new)
        for i, ids in zip(plain, self._join(raws, cuts, keys, need), strict=True):
            out[i] = ids
        while self.held > CACHE_BYTES:
            k, ids = self.cache.popitem(last=False)
            self.held -= len(k) + ids.nbytes + 200
        return out

    @staticmethod
    def _safe_before(raw: bytes, at: int) -> int:
        """The last place before ``at`` that nothing crosses: before a space that no white space follows; or 0."""
        while at > 0:
            at = raw.rfind(b" ", 0, at)
            if at <= 0:
                return 0
            if at + 1 < len(raw) and 33 <= raw[at + 1] < 127:
                return at
        return 0

    @staticmethod
    def _safe_after(raw: bytes, at: int) -> int:
        while True:
            at = raw.find(b" ", at)
            if at < 0:
                return len(raw)
            if at + 1 < len(raw) and 33 <= raw[at + 1] < 127:
                return at
            at += 1

    def _join(self, raws: list[bytes], cuts: list[list[int]], keys: list[list[bytes]], ids: dict) -> list[np.ndarray]:
        """Splice the ids of the chunks, with those of a window around each join."""
        out: list[np.ndarray] = [None] * len(raws)  # type: ignore[list-item]
        jobs, texts = [], []
        for d, raw in enumerate(raws):
            parts = [ids[k] for k in keys[d]]
            if len(parts) == 1:
                out[d] = parts[0]
                continue
            flat = np.concatenate(parts)
            ends = np.cumsum(self.size[flat])
            windows: list[list[int]] = []
            for cut in cuts[d][:-1]:
                if windows and cut < windows[-1][1]:
                    continue  # the window before already covers this join
                if windows and cut == windows[-1][1]:
                    lo = cut
                else:
                    lo = self._edge(raw, ends, cut, windows[-1][1] if windows else 0, self._safe_before, -1)
                hi = self._edge(raw, ends, cut, len(raw), self._safe_after, 1)
                if lo < hi:
                    windows.append([lo, hi])
            jobs.append((d, flat, ends, windows))
            texts += [raw[a:b].decode() for a, b in windows]
        done = iter(self.words.encode(texts))
        for d, flat, ends, windows in jobs:
            parts, at = [], 0
            for lo, hi in windows:
                parts += [flat[at : np.searchsorted(ends, lo, "right") if lo else 0], next(done)]
                at = int(np.searchsorted(ends, hi, "right"))
            out[d] = np.concatenate([*parts, flat[at:]])
        return out

    @staticmethod
    def _edge(raw: bytes, ends: np.ndarray, cut: int, limit: int, move, way: int) -> int:
        """From a join, the nearest safe place where a token of the chunks ends; ``limit`` if there is none."""
        at = cut
        while True:
            at = move(raw, at if way > 0 else at + 0)
            if at * way >= limit * way:
                return limit
            i = int(np.searchsorted(ends, at))
            if i < len(ends) and ends[i] == at:
                return at
            at += 1 if way > 0 else 0

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


def chunk_encoder(path: str, average: int = 512) -> ChunkEncoder:
    """One a worker process."""
    return worker_cache("chunkbpe", (path, average), lambda: ChunkEncoder(path, average))


def encode_decode(docs: DataFrame, path: str, average: int = 512, use=None, schema: str = "doc_id long, ids array<int>, decoded string") -> DataFrame:
    """Encode each text and decode the ids; ``use(doc_id, ids, decoded)`` gives a row, by default these three."""
    use = use or (lambda doc_id, ids, decoded: (doc_id, ids.astype(np.int32), decoded))
    from pyspark.sql.pandas.types import to_arrow_schema

    types = docs.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(types)

    def run(batches):
        enc = chunk_encoder(path, average)
        for batch in batches:
            for some in small_slices(batch, "text", 2 << 20):
                texts = [t or "" for t in some.column("text").to_pylist()]
                rows = [use(i, ids, enc.decode(ids)) for i, ids in zip(some.column("doc_id").to_pylist(), enc.encode(texts), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, types)


def hashes(doc_id: int, ids: np.ndarray, decoded: str) -> tuple:
    return doc_id, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def round_trip_hashes(docs: DataFrame, path: str) -> DataFrame:
    return encode_decode(docs, path, use=hashes, schema="doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
