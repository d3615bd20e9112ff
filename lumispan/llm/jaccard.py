"""Exact n-gram Jaccard join by grouped prefixes.

Words are maximal runs without ASCII white space, lower-cased in A-Z only; a document's set holds the hashes of its distinct
shingles. Equal sets are one document. In one order for all shingles (the frequent ones last, then by hash), sets whose
Jaccard similarity reaches the threshold share a shingle of their prefixes, so documents with the same prefix and size form
a group that is joined as one row. Pairs of groups pass a length and a position filter; members are then verified on their
whole texts.

Links are wanted as components, so what is one component already is not compared again. A first pass links each posting of a
shingle to the smallest one of nearly its size, verifies, and takes components; a second one verifies all pairs whose
components still differ. Both only skip pairs that cannot change a component.

Documents without words, or with null text, have an empty set and no link. Sets, not ids, are what is linked: rows with the
same doc_id and other texts are documents of their own, rows with null doc_id link like all others and only give no name. A
component without any doc_id has none. Repeated rows are one document. An empty table gives none, other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumispan.llm.common import materialize, small_slices, worker_cache
from lumispan.llm.components import components

N = 5
PERCENT = 80
FREQUENT = 1 << 16  # shingles ranked by their counts; all others keep the order of their hashes


class Hasher:
    """Sorted distinct 64-bit hashes of the word shingles of texts."""

    def __init__(self, n: int = N):
        self.n = n
        self.powers = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(n)], np.uint64)

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        """The set of each text of a column. Arrow cuts the words and numbers the distinct ones, which are hashed once a call."""
        column = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        lists = pc.ascii_split_whitespace(column)
        counts = lists.value_lengths().to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[coded.indices.to_numpy()]
        starts = np.cumsum(counts) - counts
        counts = np.where(pc.equal(column, "").to_numpy(zero_copy_only=False), 0, counts)
        whole = self._windows(h, self.n) if len(h) >= self.n else np.zeros(0, np.uint64)
        out = []
        for a, c in zip(starts.tolist(), counts.tolist(), strict=True):
            x = whole[a : a + c - self.n + 1] if c >= self.n else self._windows(h[a : a + c], c) if c else whole[:0]
            x = np.sort(x)
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x)
        return out

    def _windows(self, h: np.ndarray, k: int) -> np.ndarray:
        total = np.full(len(h) - k + 1, np.uint64(k))
        for i in range(k):
            x = h[i : len(h) - k + 1 + i] * self.powers[i]
            total += x ^ (x >> np.uint64(29))
        total ^= total >> np.uint64(32)
        total *= np.uint64(0xBF58476D1CE4E5B9)
        total ^= total >> np.uint64(29)
        return total


def prefix_length(size: int, percent: int = PERCENT) -> int:
    """Shingles that have to be in the prefix of a set of this size."""
    return size - (percent * size + 99) // 100 + 1


def frequent_shingles(docs: DataFrame, n: int = N, keep: int = FREQUENT, least: int = 2) -> np.ndarray:
    """Hashes of the most counted shingles, the rarest of them first.

    Every document is counted; a task passes on what it meets ``least`` times among half a million. The result only orders shingles, and any order is exact.
    """

    def run(batches):
        hasher = worker_cache("jaccard", n, lambda: Hasher(n))
        held, size = [], 0

        def fold():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            h, c = h[c >= least].view(np.int64), c[c >= least]
            for at in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[at : at + 100_000]), pa.array(c[at : at + 100_000], pa.int64())], names=["shingle", "n"])

        for batch in batches:
            for some in small_slices(batch, "text"):
                new = hasher.sets(some.column("text"))
                held += new
                size += sum(map(len, new))
                if size > 500_000:
                    yield from fold()
                    held, size = [], 0
        if held:
            yield from fold()

    counted = docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "shingle").limit(keep).toPandas()  # at most ``keep`` rows
    return rows["shingle"].to_numpy(np.int64).view(np.uint64)[::-1].copy()


def parity(shingles: np.ndarray) -> bytes:
    """Bits that say of each bucket whether an odd number of the set's hashes falls into it; two to four bits a shingle.

    A larger one folds to a smaller one. Two sets of a and b elements whose bits differ in d places share at most
    (a + b - d) / 2 elements, so most pairs that cannot link go without a look at their texts.
    """
    bits = max(64, 1 << (2 * max(1, len(shingles)) - 1).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 > 0, bitorder="little").tobytes()


def most_common(a: int, b: int, x: bytes, y: bytes) -> int:
    """The most elements that sets of a and b elements with these parity bits can share."""
    u, v = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    v = np.bitwise_xor.reduce(v.reshape(-1, len(u)), axis=0)
    return (a + b - int(np.bitwise_count(u ^ v).sum())) // 2


SIGNED = "doc_id long, text_hash long, n_shingles long, whole binary, signature binary, bits binary, prefix array<long>"


def signatures(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """Size, digest of the set, digest of prefix and size, and prefix of each document (doc_id, text_hash, text)."""
    frequent = frequent_shingles(docs, n)

    def run(batches):
        hasher = worker_cache("jaccard", n, lambda: Hasher(n))
        rank = np.sort(frequent)
        place = np.argsort(frequent, kind="stable")
        for batch in batches:
            for some in small_slices(batch, "text"):
                sizes, wholes, signs, bits, prefixes = [], [], [], [], []
                for s in hasher.sets(some.column("text")):
                    sizes.append(len(s))
                    bits.append(parity(s))
                    wholes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    k = prefix_length(len(s), percent) if len(s) else 0
                    at = np.minimum(np.searchsorted(rank, s), max(0, len(rank) - 1))
                    often = rank[at] == s if len(rank) else np.zeros(len(s), bool)
                    p = s[~often][:k]
                    if len(p) < k:
                        late = s[often]
                        p = np.concatenate([p, late[np.argsort(place[at[often]], kind="stable")][: k - len(p)]])
                    prefixes.append(p.view(np.int64))
                    signs.append(hashlib.blake2b(p.tobytes() + len(s).to_bytes(8, "little"), digest_size=16).digest())
                flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
                offsets = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(wholes, pa.binary()), pa.array(signs, pa.binary()), pa.array(bits, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=names)

    names = [c.split()[0] for c in SIGNED.split(", ")]
    return docs.mapInArrow(run, SIGNED)


def possible(pairs: DataFrame, signed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those pairs (u, v) whose sizes and parity bits leave a link possible."""
    a = signed.select(F.col("row").alias("u"), F.col("n_shingles").alias("nu"), F.col("bits").alias("bu"))
    b = signed.select(F.col("row").alias("v"), F.col("n_shingles").alias("nv"), F.col("bits").alias("bv"))

    def run(batches):
        for batch in batches:
            u, v = batch.column("u").to_pylist(), batch.column("v").to_pylist()
            keep = []
            for i, (p, q, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("nu", "nv", "bu", "bv")), strict=True)):
                common = min(p, q, most_common(p, q, x, y))
                if 100 * common >= percent * (p + q - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([u[i] for i in keep], pa.int64()), pa.array([v[i] for i in keep], pa.int64())], names=["u", "v"])

    return pairs.distinct().join(a, "u").join(b, "v").select("u", "v", "nu", "nv", "bu", "bv").mapInArrow(run, "u long, v long")


def verified(pairs: DataFrame, docs: DataFrame, signed: DataFrame, n: int = N, percent: int = PERCENT, most_broadcast: int = 500_000) -> DataFrame:
    """Those pairs (u, v) of rows of ``signed`` whose sets reach the threshold, from their whole texts."""
    pairs = materialize(possible(pairs, signed, percent), "pairs")
    ids = pairs.select(F.explode(F.array("u", "v")).alias("row")).distinct()
    # a list of ids of checked size filters the scan; a longer one joins
    few = ids.count() <= most_broadcast
    held = lambda d: F.broadcast(d) if few else d
    keys = signed.select("row", F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).join(held(ids), "row", "left_semi")
    texts = docs.join(held(keys), docs.doc_id.eqNullSafe(F.col("id")) & docs.text_hash.eqNullSafe(F.col("hash"))).select("row", "text")
    texts = materialize(texts.dropDuplicates(["row"]), "texts")
    a = texts.select(F.col("row").alias("u"), F.col("text").alias("a"))
    b = texts.select(F.col("row").alias("v"), F.col("text").alias("b"))

    def run(batches):
        hasher = worker_cache("jaccard", n, lambda: Hasher(n))
        for batch in batches:
            for some in small_slices(batch, "b"):
                u, v = some.column("u").to_numpy(), some.column("v").to_numpy()
                keep = np.zeros(len(u), bool)
                run_of = np.cumsum(np.concatenate([[True], u[1:] != u[:-1]])) - 1  # consecutive pairs of a document share its set
                firsts = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
                for at in range(0, len(firsts), 64):
                    mine = firsts[at : at + 64]
                    left = hasher.sets(some.column("a").take(pa.array(mine)))
                    lo, hi = int(mine[0]), int(firsts[at + 64]) if at + 64 < len(firsts) else len(u)
                    for i, sb in enumerate(hasher.sets(some.column("b").slice(lo, hi - lo)), lo):
                        sa = left[run_of[i] - at]
                        common = len(np.intersect1d(sa, sb, assume_unique=True))
                        keep[i] = common and 100 * common >= percent * (len(sa) + len(sb) - common)
                yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], names=["u", "v"])

    return materialize(pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long"), "links")


def near_duplicates(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) of each document (doc_id, text).

    component_id is the smallest doc_id that links reach; one text of each component, that with the smallest doc_id, is kept,
    and so is every document without words. ``text_hash`` is Spark's xxhash64 of the text, which tells rows of one doc_id apart.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    signed = materialize(signatures(docs, n, percent).withColumn("row", F.monotonically_increasing_id()), "signed")
    # equal sets are one representative, equal prefixes and sizes one group; the aggregates combine before the shuffle
    some = signed.where("n_shingles > 0").select("row", "whole", "signature", "doc_id")
    reps = materialize(some.groupBy("whole", "signature").agg(F.min("row").alias("row"), F.min("doc_id").alias("least"), F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("leader")), "reps")
    groups = reps.groupBy("signature").agg(F.min("row").alias("gid"), F.count("*").alias("members"))
    heads = signed.join(groups.select(F.col("gid").alias("row")), "row", "left_semi")
    postings = materialize(heads.select(F.col("row").alias("gid"), F.col("n_shingles").cast("int").alias("size"), "prefix"), "heads").select("gid", "size", F.posexplode("prefix").alias("pos", "shingle"))
    shared = postings.groupBy("shingle").agg(F.min("gid").alias("lo"), F.max("gid").alias("hi")).where("lo < hi").select("shingle")
    active = materialize(postings.join(shared, "shingle"), "postings")

    inside = reps.join(groups.where("members > 1"), "signature").where("row != gid").select(F.col("gid").alias("u"), F.col("row").alias("v"))
    band = active.withColumn("band", F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(100.0 / percent)) * 2))
    centres = band.groupBy("shingle", "band").agg(F.min(F.struct("gid", "size", "pos")).alias("c"))
    star = band.join(centres, ["shingle", "band"]).where("gid != c.gid").where(_may_link("size", "pos", "c.size", "c.pos", percent)).select(F.col("c.gid").alias("u"), F.col("gid").alias("v"))
    links = verified(inside.unionByName(star), docs, signed, n, percent)
    parts = components(links)

    # second pass: every pair with different components, members of groups included
    member = materialize(reps.join(groups, "signature").join(parts.withColumnRenamed("id", "row"), "row", "left").select("row", "gid", F.coalesce("component", "row").alias("component")), "members")
    spans = member.groupBy("gid").agg(F.min("component").alias("clo"), F.max("component").alias("chi"))
    loose = member.join(spans.where("clo < chi").select("gid"), "gid")
    a, b = loose.alias("a"), loose.alias("b")
    within = a.join(b, (F.col("a.gid") == F.col("b.gid")) & (F.col("a.row") < F.col("b.row")) & (F.col("a.component") != F.col("b.component"))).select(F.col("a.row").alias("u"), F.col("b.row").alias("v"))
    kinds = active.join(spans, "gid")
    mixed = kinds.groupBy("shingle").agg(F.min("clo").alias("lo"), F.max("chi").alias("hi")).where("lo < hi").select("shingle")
    left = materialize(kinds.join(mixed, "shingle"), "mixed")
    p, q = left.alias("p"), left.alias("q")
    different = (F.col("p.clo") != F.col("q.clo")) | (F.col("p.chi") != F.col("q.chi")) | (F.col("p.clo") != F.col("p.chi"))
    group_pairs = p.join(q, (F.col("p.shingle") == F.col("q.shingle")) & (F.col("p.gid") < F.col("q.gid")) & different & _may_link("p.size", "p.pos", "q.size", "q.pos", percent)).select(F.col("p.gid").alias("g"), F.col("q.gid").alias("h")).distinct()
    m1, m2 = member.select(F.col("gid").alias("g"), F.col("row").alias("x"), F.col("component").alias("cx")), member.select(F.col("gid").alias("h"), F.col("row").alias("y"), F.col("component").alias("cy"))
    across = group_pairs.join(m1, "g").join(m2, "h").where("cx != cy").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
    more = verified(within.unionByName(across), docs, signed, n, percent)
    parts = components(links.unionByName(more))

    placed = reps.join(parts.withColumnRenamed("id", "row"), "row", "left").select("whole", "least", "leader", F.coalesce("component", "row").alias("component"))
    first = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.min_by("leader", F.struct(F.col("least").isNull(), "least", "leader")).alias("stays"))
    by_set = placed.join(first, "component").select("whole", "component_id", "stays")
    out = signed.select("row", "doc_id", "text_hash", "n_shingles", "whole").join(by_set, "whole", "left")
    worded = F.col("n_shingles") > 0
    return out.select("doc_id", "n_shingles", F.when(worded, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(worded, F.col("row").eqNullSafe(F.col("stays"))).otherwise(True).alias("kept"), "text_hash")


def _may_link(size: str, pos: str, other: str, at: str, percent: int):
    """Length filter and position filter: what both have left from this shingle on can still make the overlap that is needed."""
    a, b = F.col(size), F.col(other)
    need = F.ceil(F.lit(percent) * (a + b) / F.lit(100 + percent))
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (F.least(a - F.col(pos), b - F.col(at)) >= need)
