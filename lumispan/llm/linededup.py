"""Fuzzy removal of repeated lines by MinHash.

A line counts as its words in lower case with single spaces between; blank lines are left alone, and with ``least`` over 1
shorter ones as well. Equal lines are one; lines shorter than a shingle are only compared for equality. Signatures over
character shingles fall into bands. Inside a band's bucket an exact upper bound from sizes and parity bits leaves the pairs that
can be similar, of which a spanning forest is verified first by the exact Jaccard similarity of shingle sets, then what still
joins different components. A distributed union-find over the links gives components. Of each component the line at the
smallest (doc_id, line number) stays, all others go.

With 7 bands of 3 rows, lines of similarity 0.8 meet with probability 0.993, of 0.85 with 0.9989, and unrelated lines
(8-shingle similarity below 0.01 as a rule) hardly ever. Null text has no lines and stays null; documents without doc_id stay
as they are; an empty table gives none. Rows that repeat a doc_id are told apart by a hash of their text; equal rows are one
document in this respect, so all or none of a line goes from them. Lines are named by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumispan.llm.common import materialize, small_slices, worker_cache
from lumispan.llm.components import components
from lumispan.llm.jaccard import parity

SHINGLE = 8
BANDS, ROWS = 7, 3
PERCENT = 80
LEAST = 1  # characters of a line that counts: all but blank ones
BLOCK = 2048  # rows of a bucket that are compared in one place; longer buckets are dealt in pairs of blocks
SMALL = 12  # buckets up to this size are compared without arrays
_SEED = np.random.default_rng(20240117)
_A = _SEED.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def line_id(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))


def shingle_hashes(lines: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-shingles of all lines (of a shorter line: of the whole), one after the other, and where each line starts."""
    padded = [x if len(x) >= k else x.ljust(k, "\0") for x in lines]
    size = np.array([len(x) for x in padded], np.int64)
    h = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    h = (h + np.uint64(0x51ED27)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    width, base = 1, 0xD6E8FEB86659FD93
    while width < k:  # windows of 1, 2, 4, ... code points; k is a power of two
        h[:-width] = h[:-width] * np.uint64(pow(base, width, 1 << 64)) + h[width:]
        width *= 2
    ends = np.cumsum(size)
    keep = np.ones(len(h), bool)
    for i in range(1, k):
        keep[ends - i] = False
    h = h[keep]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    counts = size - k + 1
    return h, np.cumsum(counts) - counts


def _small_hashes(lines: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`shingle_hashes`, of 32 bits, for lines of k characters or more."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    h = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4") * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    width, base = 1, 0x27D4EB2F
    while width < k:
        h[:-width] = h[:-width] * np.uint32(pow(base, width, 1 << 32)) + h[width:]
        width *= 2
    ends = np.cumsum(size)
    keep = np.ones(len(h), bool)
    for i in range(1, k):
        keep[ends - i] = False
    h = h[keep]
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    counts = size - k + 1
    return h, np.cumsum(counts) - counts


def band_keys(lines: list[str], most: int = 1 << 16) -> np.ndarray:
    """(lines, BANDS) keys of the bands of the signature of each line of a shingle or more, about ``most`` characters at a time."""
    keys = np.empty((len(lines), BANDS), np.uint64)
    at = total = 0
    for i, line in enumerate(lines):
        total += len(line)
        if total < most and i + 1 < len(lines):
            continue
        h, starts = _small_hashes(lines[at : i + 1])
        for b in range(BANDS):
            key = np.full(len(starts), np.uint64((b + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            for r in range(b * ROWS, (b + 1) * ROWS):
                key = (key ^ np.minimum.reduceat(h * _A[r], starts).astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
                key ^= key >> np.uint64(32)
            keys[at : i + 1, b] = key
        at, total = i + 1, 0
    return keys.view(np.int64)


def shingle_set(line: str, k: int = SHINGLE) -> set[str]:
    return {line[i : i + k] for i in range(max(1, len(line) - k + 1))}


def sets_reach(x: set[str], y: set[str], percent: int = PERCENT) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    common = len(x & y)
    return 100 * common >= percent * (len(x) + len(y) - common)


def jaccard_reaches(a: str, b: str, percent: int = PERCENT, k: int = SHINGLE) -> bool:
    return sets_reach(shingle_set(a, k), shingle_set(b, k), percent)


OCCURRENCE = "doc_id long, mark long, line_no int, line long, keys array<long>"


def occurrences(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """A row for each line that counts; keys are null for lines under a shingle and where the task has given those of the line before."""

    def run(batches):
        seen: set[int] = worker_cache("linededup", "seen", set)
        seen.clear()  # a task that is run again has to give the same rows
        for batch in batches:
            for some in small_slices(batch, "text"):
                ids, marks, nos, names, fresh, texts = [], [], [], [], [], []
                if len(seen) > 200_000:
                    seen.clear()
                for doc_id, mark, text in zip(*(some.column(c).to_pylist() for c in ("doc_id", "mark", "text")), strict=True):
                    for no, raw in enumerate(text.split("\n")):
                        line = normal(raw)
                        if len(line) >= least:
                            name = line_id(line)
                            ids.append(doc_id)
                            marks.append(mark)
                            nos.append(no)
                            names.append(name)
                            if len(line) < SHINGLE or name in seen:  # a line shorter than a shingle is like none but its equals
                                fresh.append(-1)
                            else:
                                seen.add(name)
                                fresh.append(len(texts))
                                texts.append(line)
                if not ids:
                    continue
                keys = band_keys(texts) if texts else np.zeros((0, BANDS), np.int64)
                given = np.array(fresh) >= 0
                offsets = np.concatenate([[0], np.cumsum(np.where(given, BANDS, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1)), mask=pa.array(~given))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(nos, pa.int32()), pa.array(np.array(names, np.uint64).view(np.int64)), lists], names=[c.split()[0] for c in OCCURRENCE.split(", ")])

    return docs.select("doc_id", "mark", "text").mapInArrow(run, OCCURRENCE)


def shared_buckets(keyed: DataFrame) -> DataFrame:
    """Rows (key, id) of the keys that at least two ids have, in one pass over sorted partitions with one row in memory."""

    def run(batches):
        held_k = held_i = None
        was = False
        for batch in batches:
            k, i = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if held_k is not None:
                k, i = np.concatenate([[held_k], k]), np.concatenate([[held_i], i])
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (i[1:] != i[:-1])])
            k, i = k[new], i[new]
            same = k[1:] == k[:-1]
            active = np.concatenate([[was], same])
            active[:-1] |= same
            if active[:-1].any():
                yield pa.RecordBatch.from_arrays([pa.array(k[:-1][active[:-1]]), pa.array(i[:-1][active[:-1]])], names=["key", "id"])
            held_k, held_i, was = k[-1], i[-1], bool(active[-1])
        if was:
            yield pa.RecordBatch.from_arrays([pa.array([held_k], pa.int64()), pa.array([held_i], pa.int64())], names=["key", "id"])

    return keyed.repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, "key long, id long")


def line_texts(docs: DataFrame, least: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for some in small_slices(batch, "text"):
                found = {line_id(x): x for t in some.column("text").to_pylist() for raw in t.split("\n") if len(x := normal(raw)) >= least}
                yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(found.keys(), np.uint64, len(found)).view(np.int64)), pa.array(found.values(), pa.string())], names=["id", "line"])

    return docs.select("text").mapInArrow(run, "id long, line string")


def sketches(texts: DataFrame) -> DataFrame:
    """(id, size, bits): how many shingles each line has and the parity bits of their hashes."""

    def run(batches):
        for batch in batches:
            for some in small_slices(batch, "line", 1 << 20):
                h, starts = shingle_hashes(some.column("line").to_pylist())
                sets = [np.unique(x) for x in np.split(h, starts[1:])]
                yield pa.RecordBatch.from_arrays([some.column("id"), pa.array(list(map(len, sets)), pa.int32()), pa.array(list(map(parity, sets)), pa.binary())], names=["id", "size", "bits"])

    return texts.select("id", "line").mapInArrow(run, "id long, size int, bits binary")


class Bucket:
    """The rows of one bucket, or of two of its blocks, and which pairs of them can be similar."""

    def __init__(self, component: np.ndarray, block: np.ndarray, size: np.ndarray, bits: list[bytes], percent: int):
        self.component, self.block, self.size, self.percent = component, block, size, percent
        self.two = block.min() != block.max()
        width = np.array([len(x) for x in bits])
        self.words: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # rows and bits by width; of the next width, folded, as well
        for w in np.unique(width).tolist():
            mine, more = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
            table = np.frombuffer(b"".join(bits[i] for i in mine.tolist()), "<u8").reshape(len(mine), -1)
            if len(more):
                halves = np.frombuffer(b"".join(bits[i] for i in more.tolist()), "<u8").reshape(len(more), 2, -1)
                table = np.concatenate([table, halves[:, 0] ^ halves[:, 1]])
            self.words[w] = (np.concatenate([mine, more]), table)
        self.width, self.place = width, {w: {r: i for i, r in enumerate(rows.tolist())} for w, (rows, _) in self.words.items()}

    def likeness(self, r: int) -> np.ndarray:
        """The most that the similarity of each row to row ``r`` can be; 0 where it is too little or of no use."""
        out = np.zeros(len(self.size))
        for w in (self.width[r], self.width[r] // 2):
            if w not in self.words:
                continue
            rows, table = self.words[w]
            apart = np.bitwise_count(table ^ table[self.place[w][r]]).sum(axis=1, dtype=np.int64)
            both = self.size[rows] + self.size[r]
            common = np.minimum((both - apart) // 2, np.minimum(self.size[rows], self.size[r]))
            fits = (100 * common >= self.percent * (both - common)) & (self.component[rows] != self.component[r])
            if w < self.width[r]:  # rows as wide as this one have been compared unfolded
                fits &= self.width[rows] == w
            if self.two:
                fits &= self.block[rows] != self.block[r]
            out[rows[fits]] = (common / (both - common))[fits]
        return out

    def forest(self) -> list[tuple[int, int]]:
        """A forest that joins the components whose rows can be similar, by the likeliest pairs (Prim)."""
        order = np.argsort(self.component, kind="stable")
        edges = np.flatnonzero(np.diff(self.component[order])) + 1
        members = np.split(order, edges)
        group = np.empty(len(order), np.int64)
        for g, rows in enumerate(members):
            group[rows] = g
        best, source = np.zeros(len(order)), np.zeros(len(order), np.int64)
        todo, found = np.ones(len(order), bool), []
        while todo.any():
            r = int(np.argmax(np.where(todo, best, -1)))
            if best[r]:
                found.append((int(source[r]), r))
            todo[members[group[r]]] = False
            for q in members[group[r]].tolist():
                near = self.likeness(q)
                closer = near > best
                best[closer], source[closer] = near[closer], q
        return found

    def every(self) -> list[tuple[int, int]]:
        return [(r, int(q)) for r in range(len(self.size)) for q in np.flatnonzero(self.likeness(r)) if r < q]


def _few(component: list[int], block: list[int], size: list[int], bits: list[bytes], percent: int, all_pairs: bool) -> list[tuple[int, int]]:
    """As :class:`Bucket`, for buckets of few rows."""
    whole, found, n = [int.from_bytes(x, "little") for x in bits], [], len(size)
    two = len(set(block)) > 1
    for i in range(n):
        for j in range(i + 1, n):
            a, b = size[i], size[j]
            if component[i] == component[j] or two and block[i] == block[j] or 100 * min(a, b) < percent * max(a, b):
                continue
            x, y, w = whole[i], whole[j], len(bits[i])
            if w > len(bits[j]):
                w = len(bits[j])
                x = x >> 8 * w ^ x & (1 << 8 * w) - 1
            elif w < len(bits[j]):
                y = y >> 8 * w ^ y & (1 << 8 * w) - 1
            common = min(a, b, (a + b - (x ^ y).bit_count()) // 2)
            if 100 * common >= percent * (a + b - common):
                found.append((common / (a + b - common), i, j))
    if all_pairs or len(found) < 2:
        return [(i, j) for _, i, j in found]
    parent = {c: c for c in component}
    out = []
    for _, i, j in sorted(found, key=lambda x: -x[0]):
        a, b = component[i], component[j]
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        if a != b:
            parent[a] = b
            out.append((i, j))
    return out


def candidates(rows: DataFrame, all_pairs: bool, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Pairs (u, v) of the rows (key, id, component, size, bits) of a bucket that can be similar and differ in their components.

    Of each bucket a forest that joins its components, or ``all_pairs``. Buckets of more than ``block`` rows are cut into
    blocks by a hash of the id, and every two blocks meet in a place of their own.
    """
    long = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("parts")), "long")
    dealt = rows.withColumn("parts", F.lit(1)) if long.isEmpty() else rows.join(long, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    turn = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = dealt.select("key", "id", "component", "size", "bits", "block", turn).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "component", "size", "bits", "block")

    def pairs(rows):
        if len(rows[0]) <= SMALL:
            found = _few(*rows[1:], percent, all_pairs)
        else:
            b = Bucket(*(np.array(c) for c in rows[1:4]), rows[4], percent)
            found = b.every() if all_pairs else b.forest()
        u = [min(rows[0][i], rows[0][j]) for i, j in found]
        return u, [max(rows[0][i], rows[0][j]) for i, j in found]

    def run(batches):
        held, last, us, vs = None, None, [], []
        for batch in batches:
            k, i, j = (batch.column(c).to_numpy() for c in ("key", "i", "j"))
            cuts = np.flatnonzero((k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            columns = [batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("id", "component", "block", "size", "bits")]
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(k)], strict=True):
                mine, name = [c[a:b] for c in columns], (int(k[a]), int(i[a]), int(j[a]))
                if name == last:
                    held = [x + y for x, y in zip(held, mine, strict=True)]
                    continue
                if held and len(held[0]) > 1:
                    u, v = pairs(held)
                    us += u
                    vs += v
                held, last = mine, name
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
                us, vs = [], []
        if held and len(held[0]) > 1:
            u, v = pairs(held)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "u long, v long").distinct()


def line_components(docs: DataFrame, seen: DataFrame, percent: int = PERCENT, least: int = LEAST, most_broadcast: int = 500_000) -> DataFrame:
    """(id, component) of the lines that are linked to others."""
    active = materialize(shared_buckets(seen.where("keys IS NOT NULL").select(F.explode("keys").alias("key"), F.col("line").alias("id"))), "buckets")
    ids = materialize(active.select("id").distinct(), "ids")
    few = ids.count() <= most_broadcast  # a list of checked size filters the scan; a longer one joins
    ids_or = F.broadcast(ids) if few else ids
    # each of these lines is read from one document that has it
    owners = seen.select(F.col("line").alias("id"), "doc_id").join(ids_or, "id", "left_semi").groupBy("id").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    owners = materialize(owners, "owners")
    some = docs.join(F.broadcast(owners) if few else owners, "doc_id", "left_semi")  # no longer than ``ids``
    texts = materialize(line_texts(some, least).join(ids_or, "id", "left_semi").dropDuplicates(["id"]), "line-texts")
    rows = materialize(active.join(sketches(texts), "id"), "bucket-rows")

    def run(batches):
        for batch in batches:
            u, v, a, b = (batch.column(c).to_pylist() for c in ("u", "v", "a", "b"))
            sets: dict[str, set[str]] = {}  # a line is in many pairs of a batch
            for line in (*a, *b):
                if line not in sets:
                    sets[line] = shingle_set(line)
            keep = [i for i in range(len(u)) if sets_reach(sets[a[i]], sets[b[i]], percent)]
            yield pa.RecordBatch.from_arrays([pa.array([u[i] for i in keep], pa.int64()), pa.array([v[i] for i in keep], pa.int64())], names=["u", "v"])

    def verify(pairs: DataFrame) -> DataFrame:
        x, y = texts.select(F.col("id").alias("u"), F.col("line").alias("a")), texts.select(F.col("id").alias("v"), F.col("line").alias("b"))
        return materialize(pairs.join(x, "u").join(y, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long"), "line-links")

    links = verify(candidates(rows.withColumn("component", F.col("id")), False, percent))
    parts = components(links)
    # what the first pass left apart: buckets whose rows are in different components
    placed = rows.join(parts, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"), "size", "bits")
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    left = materialize(placed.join(mixed, "key"), "mixed")
    if left.isEmpty():
        return parts
    return components(links.unionByName(verify(candidates(left, True, percent))))


def _without(text: Column, drop: Column) -> Column:
    """``text`` without its lines of the numbers in ``drop``; the lines are bound once, and numbers are taken off by a hash set."""
    bound = F.transform(F.array(F.split(text, "\n", -1)), lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop.cast("array<int>")), lambda i: F.get(lines, i)), "\n"))
    return F.get(bound, F.lit(0))


def dedup_lines(docs: DataFrame, percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """``docs`` (doc_id, text and any others) with repeated lines taken out of text, and n_lines and n_dropped of each."""
    clean = docs.withColumn("__id", F.col("doc_id").cast("long"))
    source = clean.where("text IS NOT NULL AND __id IS NOT NULL").select(F.col("__id").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("mark"), F.col("text").cast("string").alias("text"))
    seen = materialize(occurrences(source, least), "lines")
    parts = line_components(source, seen, percent, least)
    # equal lines and their components share the first place; the aggregates combine before the shuffle
    place = F.struct("doc_id", "mark", "line_no")
    first = seen.groupBy("line").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    first = materialize(first, "firsts")
    # lines without a component stay out of the joins by component
    joined = first.join(parts, first.line == parts.id).select("line", "first", "last", "component")
    best = joined.groupBy("component").agg(F.min("first").alias("best"))
    linked = joined.join(best, "component").select("line", "best", "last").where("last != best")
    alone = first.where("last != first").join(parts, first.line == parts.id, "left_anti").select("line", F.col("first").alias("best"), "last")
    kept = materialize(linked.unionByName(alone), "kept")
    gone = seen.select("doc_id", "mark", "line_no", "line").join(kept.select("line", "best"), "line").where(place != F.col("best"))
    drop = gone.groupBy("doc_id", "mark").agg(F.collect_set("line_no").alias("drop")).select(F.col("doc_id").alias("__doc"), F.col("mark").alias("__mark"), "drop")
    full = clean.withColumn("__m", F.xxhash64(F.col("text").cast("string"))).join(drop, (F.col("__id") == F.col("__doc")) & (F.col("__m") == F.col("__mark")), "left")
    lines = F.split("text", "\n", -1)
    left = F.when(F.col("drop").isNull(), F.col("text")).otherwise(_without(F.col("text").cast("string"), F.col("drop")))
    names = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    return full.select(*names, left.alias("text"), F.coalesce(F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"))
