"""Document fingerprints from prefix polynomial hashes.

With P[i] the hash of the first i code points, sum(c[j] * B**j) modulo a prime, any two spans compare in constant time,
and the longest common extension of two places is found by binary search. Two primes below 2**31 make a hash of 62 bits.

A fingerprint is the length, the hash of the whole text, and the prefix hashes at the multiples of a step (a power of two
that leaves at most ``MARKS``) together with those of the reversed text, and the span hashes between anchors (windows of
``ANCHOR`` code points chosen by content, about ``MARKS`` of them). The likeness of two fingerprints is the part of the longer
text that is known to be in the other one: the longest common prefix and suffix as far as the marks tell, where the last common
mark is found by binary search, and between them the spans of equal hash. Spans of a text of another size are put together
first, as hashes of neighbouring spans add up. Equal texts have equal fingerprints and likeness 1; two empty texts are equal.
Where both texts are at hand, :func:`shared` takes exact extensions instead, at every anchor.

Null text is empty text. In :func:`compare_with_edits`, repeated doc_ids are ordered by a hash of their text, rows
without doc_id come last, and a table of one row is its own next document.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumispan.llm.common import small_slices

PRIMES = (2147483629, 2147483587)
BASES = (1000003, 998244353)
MARKS = 32
ANCHOR, EVERY = 16, 16  # a window is an anchor by its content, one of EVERY on average


class Powers:
    """Powers of the bases, grown as longer texts come."""

    def __init__(self):
        self.of = [np.ones(1, np.uint64) for _ in PRIMES]

    def get(self, k: int, n: int) -> np.ndarray:
        while len(self.of[k]) < n:
            p = self.of[k]
            step = p[-1] * np.uint64(BASES[k]) % np.uint64(PRIMES[k])
            self.of[k] = np.concatenate([p, p * step % np.uint64(PRIMES[k])])
        return self.of[k][:n]


@functools.lru_cache(maxsize=1)
def powers() -> Powers:
    return Powers()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class PrefixHash:
    """Prefix arrays of a text (code points)."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        self.arrays = []
        for k, prime in enumerate(PRIMES):
            terms = (points + np.uint64(1)) * powers().get(k, max(1, self.n))[: self.n] % np.uint64(prime)
            self.arrays.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms) % np.uint64(prime)]))

    def prefix(self, at: np.ndarray | int) -> np.ndarray:
        """62-bit hashes of the prefixes of these lengths."""
        return self.arrays[0][at] << np.uint64(31) | self.arrays[1][at]

    def span(self, lo: int, n: int, to: int) -> int:
        """Hash of the span [lo, lo + n), moved to power ``to`` >= lo so that spans at different places compare."""
        out = 0
        for k, prime in enumerate(PRIMES):
            p = self.arrays[k]
            d = (int(p[lo + n]) - int(p[lo])) % prime
            out = out << 31 | d * int(powers().get(k, to - lo + 1)[to - lo]) % prime
        return out

    def equal(self, i: int, other: PrefixHash, j: int, n: int) -> bool:
        """Whether n code points from i here and from j there are equal."""
        to = max(i, j)
        return i + n <= self.n and j + n <= other.n and self.span(i, n, to) == other.span(j, n, to)

    def extension(self, i: int, other: PrefixHash, j: int) -> int:
        """Length of the longest common extension from i here and j there."""
        lo, hi = 0, min(self.n - i, other.n - j)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.equal(i, other, j, mid) else (lo, mid - 1)
        return lo


def step_of(n: int) -> int:
    step = 1
    while n // step > MARKS:
        step *= 2
    return step


def fingerprint(points: np.ndarray) -> str:
    """Length, whole hash, prefix marks, suffix marks and spans as text."""
    return Hashed(points).fingerprint()


class Hashed:
    """The prefix hashes of a text and of its reverse."""

    def __init__(self, points: np.ndarray):
        self.points, self.n = points, len(points)
        self.ahead, self.back = PrefixHash(points), PrefixHash(points[::-1])

    def fingerprint(self) -> str:
        return _marked(self.n, self.points, self.ahead, self.back)


def _spans(points: np.ndarray, ahead: PrefixHash) -> str:
    """Place of the first anchor, then level of each anchor and length and hash of the span that follows it."""
    n = len(points)
    every = max(EVERY, step_of(n))
    at, hashes = anchors(points, 0, n, every)
    if not len(at):
        return ""
    first = np.sort(np.unique(hashes, return_index=True)[1])  # a window that comes again adds nothing, in periodic texts for one
    at, hashes = at[first], hashes[first]
    levels = [(int(h) & -int(h)).bit_length() - 1 if h else 63 for h in hashes.tolist()]
    parts = []
    for i, lo in enumerate(at.tolist()):
        if i + 1 < len(at):
            m = int(at[i + 1]) - lo
            parts.append(f"{levels[i]:x}.{m:x}.{_at_zero(ahead, lo, m):x}")
        else:
            parts.append(f"{levels[i]:x}")
    return f"{int(at[0]):x}," + ",".join(parts)


def _at_zero(h: PrefixHash, lo: int, n: int) -> int:
    """Hash of a span as if it began its text."""
    out = 0
    for k, prime in enumerate(PRIMES):
        d = int(h.arrays[k][lo + n]) - int(h.arrays[k][lo])
        out = out << 31 | d * pow(BASES[k], -lo, prime) % prime
    return out


def _read_spans(text: str, level: int) -> list[tuple[int, int, int]]:
    """(place, length, hash) of the spans between anchors of at least this level."""
    if not text:
        return []
    first, *parts = text.split(",")
    at, out, own = int(first, 16), [], None
    for part in parts:
        mark, *rest = part.split(".")
        if int(mark, 16) >= level:
            if own is not None:
                out.append((own[0], own[1], own[2] << 31 | own[3]))
            own = [at, 0, 0, 0]
        if rest:
            n, h = int(rest[0], 16), int(rest[1], 16)
            if own is not None:
                halves = (h >> 31, h & (1 << 31) - 1)
                own = [own[0], own[1] + n, *((own[2 + k] + halves[k] * pow(BASES[k], own[1], p)) % p for k, p in enumerate(PRIMES))]
            at += n
    return out


def _marked(n: int, points: np.ndarray, ahead: PrefixHash, back: PrefixHash) -> str:
    at = np.arange(1, n // step_of(n) + 1) * step_of(n) if n else np.zeros(0, np.int64)
    marks = lambda h: ".".join(f"{x & 0xFFFFFFFF:08x}" for x in h.prefix(at).tolist())
    return f"{n:x}:{int(ahead.prefix(n)):016x}:{marks(ahead)}:{marks(back)}:{_spans(points, ahead)}"


def likeness(a: str, b: str) -> float:
    """0 to 1; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    (na, _, fa, ba, pa_), (nb, _, fb, bb, pb) = a.split(":"), b.split(":")
    n, m = int(na, 16), int(nb, 16)
    if not n or not m:
        return 0.0
    if n < m:
        return likeness(b, a)
    sa, sb = step_of(n), step_of(m)
    step = max(sa, sb)
    same = []
    for x, y in ((fa, fb), (ba, bb)):
        x, y = x.split(".")[step // sa - 1 :: step // sa], y.split(".")[step // sb - 1 :: step // sb]
        lo, hi = 0, min(len(x), len(y))
        while lo < hi:  # marks agree up to a place and not beyond it
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if x[mid - 1] == y[mid - 1] else (lo, mid - 1)
        same.append(lo * step)
    covered, (p, s) = sum(same), same
    level = max(EVERY, step).bit_length() - 1
    there = {t[1:] for t in _read_spans(pb, level)}
    for at, size, h in _read_spans(pa_, level):
        if (size, h) in there:
            covered += max(0, min(at + size, n - s) - max(at, p))
    return min(covered, m) / n


def anchors(points: np.ndarray, lo: int, hi: int, every: int = EVERY) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors within [lo, hi)."""
    if hi - lo < ANCHOR:  # every is a power of two
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = (points[lo:hi] + np.uint64(0x51ED27)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    width = 1
    while width < ANCHOR:  # windows of 1, 2, 4, ... code points
        h = h[:-width] * np.uint64(pow(0xD6E8FEB86659FD93, width, 1 << 64)) + h[width:]
        width *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    at = np.flatnonzero(h & np.uint64(every - 1) == 0)
    return lo + at, h[at]


def shared(x: Hashed, y: Hashed) -> float:
    """The part of the longer text that its passages in the other one cover, 0 to 1: common prefix and suffix, and matches at anchors."""
    if x.n < y.n:
        x, y = y, x
    if not y.n:
        return float(not x.n)
    p = x.ahead.extension(0, y.ahead, 0)
    s = min(x.back.extension(0, y.back, 0), y.n - p)
    covered, at, end = p + s, p, x.n - s
    there, hashes = anchors(y.points, p, y.n - s)
    if len(there):
        values, first = np.unique(hashes, return_index=True)
        here, own = anchors(x.points, p, end)
        place = np.minimum(np.searchsorted(values, own), len(values) - 1)
        both = values[place] == own
        for i, j in zip(here[both].tolist(), there[first[place[both]]].tolist(), strict=True):
            if i < at:
                continue
            ahead = min(x.ahead.extension(i, y.ahead, j), end - i)
            if ahead:
                covered += ahead + min(x.back.extension(x.n - i, y.back, y.n - j), i - at)
                at = i + ahead
    return min(covered, y.n) / x.n


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of each document."""

    def run(batches):
        for batch in batches:
            for some in small_slices(batch, "text", 8 << 20):
                points = [code_points(t or "") for t in some.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array([len(p) for p in points], pa.int64()), pa.array(map(fingerprint, points), pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def edit(text: str, after: str) -> str:
    """``text`` with its last n // 2 code points replaced by the first as many (or all) of ``after``."""
    k = len(text) // 2
    return text[: len(text) - k] + after[:k]


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_edits(docs: DataFrame, per_bucket: int = 1000) -> DataFrame:
    """Each document against its edited text and the next document in descending order of doc_id (after the last: the first).

    Rows are dealt to ranges of doc_id by quantiles; each range also gets the first row of the next one, so that a pass over
    a sorted range sees every neighbour. Texts are shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    n = ids.count()
    if not n:
        return spark.createDataFrame([], EDITED)
    many = min(1 << 16, max(1, n // per_bucket))  # at most so many cut points go to the driver
    cuts = sorted(set(ids.where("doc_id is not null").approxQuantile("doc_id", [i / many for i in range(1, many)], 0.2 / many))) if many > 1 else []
    edges = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def range_of(doc_id: pd.Series) -> pd.Series:
        return pd.Series(len(edges) - np.searchsorted(edges, doc_id.to_numpy(np.int64)), dtype="int32")

    # range 0 holds the largest ids; rows without an id come after all others
    place = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(range_of(F.coalesce("doc_id", F.lit(0))))
    dealt = rows.withColumn("range", place)
    tie = F.xxhash64("text")
    tops = dealt.groupBy("range").agg(F.max("doc_id").alias("top")).collect()  # one row a range
    order = sorted((r["range"], r.top) for r in tops)
    after = {order[i][0]: order[(i + 1) % len(order)] for i in range(len(order))}
    before = spark.createDataFrame([(r, top, at) for at, (r, top) in after.items()], "range int, top long, at int")
    heads = dealt.join(F.broadcast(before), (dealt.range == before.range) & dealt.doc_id.eqNullSafe(before.top))
    first = heads.withColumn("k", F.row_number().over(W.partitionBy(dealt.range).orderBy(tie, "text"))).where("k = 1").select("doc_id", "text", F.col("at").alias("range"), F.lit(True).alias("guest"))
    both = dealt.select("doc_id", "text", "range", F.lit(False).alias("guest")).unionByName(first)
    ordered = both.repartition(len(order), "range").sortWithinPartitions("range", "guest", F.desc_nulls_last("doc_id"), tie, "text").select("doc_id", "text", "range", "guest")

    def run(batches):
        held = None  # (doc_id, text, fingerprint, range) of the row before
        for batch in batches:
            for some in small_slices(batch, "text", 8 << 20):
                out = []
                for doc_id, text, part, guest in zip(*(some.column(c).to_pylist() for c in ("doc_id", "text", "range", "guest")), strict=True):
                    this = Hashed(code_points(text))
                    mark = this.fingerprint()
                    if held is not None and held[3] == part:
                        changed = edit(held[1], text)
                        edited = Hashed(code_points(changed))
                        changed_mark = edited.fingerprint()
                        out.append((held[0], len(held[1]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), held[2], changed_mark, likeness(held[2], changed_mark), likeness(held[2], mark)))
                    held = None if guest else (doc_id, text, mark, part)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    names = [c.split()[0] for c in EDITED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return ordered.mapInArrow(run, EDITED)
