"""Operators of the llm subpackage against brute force on small messy tables."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lumispan.llm import chunkbpe, fingerprint, graphdedup, jaccard, langid, linededup, packing, rans, toxicity, warc, wordbpe

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
BASE = "the quick brown fox jumps over the lazy dog while seven small birds sing about a very long and rather warm summer evening by the old river"
TEXTS = [
    BASE, BASE, BASE.upper(), BASE + " today", BASE.replace("fox", "cat"), "", None, " \n\t", "a", "Ünïcode 中文 text\nwith lines\n\nand <|endoftext|> inside", "x" * 3000, "one two three four", "one two three four",
    "\n".join([BASE, "short", BASE.replace("birds", "bird"), "another line that nobody else has written down here"]), "word, " * 4000, "الكلمات العربية هنا", "  double  spaces \r\n and tabs\t\tend ", "🙂 emoji 🙂 " * 30,
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, label string, v string, score double"


@pytest.fixture(scope="module")
def docs(spark):
    """Texts with nulls, ties and repeats, and columns whose names clash with those that operators use."""
    return spark.createDataFrame([(i * 3, t, None if i % 5 == 0 else "en", None, None, 1, "x", None, 0.5) for i, t in enumerate(TEXTS)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_library():
    rng = np.random.default_rng(4)
    parts = ["ab", "É", "word.", " ", " ", "  ", "\n", "\n", " \n", "\n'll", "Of,", "!!", "1", "_x", "\x02", "\u3000", "'s", "<|endoftext|>", "\x1c", "\xa0", "中", "İ", ".,", "don't"]
    texts = [t for t in TEXTS if t] + ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(600)]
    for path in (WORD, BYTE):
        e = wordbpe.WordEncoder(path, entries=50)
        want = [x.ids for x in e.full.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for i in range(0, len(texts), 40) for x in e.encode(texts[i : i + 40])] == want
    c = chunkbpe.ChunkEncoder(BYTE, 16)
    assert [x.tolist() for x in c.encode(texts)] == want
    assert [c.decode(np.array(x)) for x in want] == [c.words.full.decode(x, skip_special_tokens=False) for x in want]
    assert c.reused > 0


def test_rans_files(docs, empty):
    t = Tokenizer.from_file(WORD)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rans.encoded_documents(docs, WORD).collect()}
    start, want = 0, {}
    for i, x in enumerate(TEXTS):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        want[i * 3], start = (start, len(ids), crc(ids)), start + len(ids)
    assert got == want
    assert rans.encoded_documents(empty, WORD).count() == 0


def test_rans_blocks():
    rng = np.random.default_rng(0)
    ids = rng.zipf(1.3, 4 * rans.LANES * rans.SEGMENT) % 50
    tables = rans.Tables(rans.scale(np.bincount(ids, minlength=50)))
    blocks = tables.encode(ids.reshape(2, -1))
    assert np.concatenate(tables.decode(blocks)).tolist() == ids.tolist()
    broken = blocks[0][:-3] + bytes([blocks[0][-3] ^ 1]) + blocks[0][-2:]
    with pytest.raises(ValueError):
        tables.decode([broken])
    one = rans.Tables(rans.scale(np.array([0, 9])))
    assert one.decode(one.encode(np.ones((1, rans.LANES * rans.SEGMENT), int)))[0].tolist() == [1] * (rans.LANES * rans.SEGMENT)


def test_warc(spark, empty):
    html = ["<p>a</p>", "<p>a</p>", "", None, "<p>é</p>", "<p>a</p>"]
    pages = spark.createDataFrame([(i, None if i == 1 else f"http://x/{i} y", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.read_warc(warc.write_warc(pages)).collect()}
    assert [(got[i].record_type, got[i].refers_to) for i in range(6)] == [("response", None), ("revisit", 0), ("response", None), ("revisit", 2), ("response", None), ("revisit", 0)]
    assert all(got[i].payload_digest == warc.digest((h or "").encode()) and got[i].payload_bytes == len((h or "").encode()) for i, h in enumerate(html))
    assert bytes(got[4].payload).decode() == html[4] and got[0].url == "http://x/0%20y" and got[1].url is None
    index = warc.write_warc(pages, min_bytes=5)
    assert {r.record_type for r in index.where("payload_bytes < 5").collect()} == {"response"}
    assert {r.page_id for r in warc.read_warc(index.where("page_id IN (1, 4)")).collect()} == {1, 4}
    assert warc.read_warc(warc.write_warc(pages.limit(0))).count() == 0


def test_chunk_round_trip(docs, empty):
    t = Tokenizer.from_file(BYTE)
    for r in chunkbpe.encode_decode(docs, BYTE).collect():
        x = TEXTS[r.doc_id // 3] or ""
        assert r.ids == t.encode(x, add_special_tokens=False).ids and r.decoded == x
    assert chunkbpe.round_trip_hashes(empty, BYTE).count() == 0


def classes(n, linked):
    parent = list(range(n))
    for a, b in linked:
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        parent[max(a, b)] = min(a, b)
    find = lambda x: x if parent[x] == x else find(parent[x])
    return [find(i) for i in range(n)]


def test_vector_graph(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 8))
    x = np.vstack([base, base[:20] + rng.normal(size=(20, 8)) * 0.05, base[:5] * 3])
    rows = [(i, [float(v) for v in r], int(i % 40 % 2)) for i, r in enumerate(x)] + [(100, None, 0), (101, [0.0] * 8, 0), (102, [float("nan")] * 8, 1), (103, [1.0, None], 1), (104, [float(v) for v in x[0]], None), (105, [], 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    u = graphdedup.unit(x)
    links = [(i, j) for i, j in itertools.combinations(range(len(x)), 2) if rows[i][2] == rows[j][2] and u[i] @ u[j] >= 0.98]
    count, part = collections.Counter(itertools.chain(*links)), classes(len(x), links)
    want = {i: (count[i], part[i], part[i] == i) for i in range(len(x))} | {i: (0, i, True) for i in range(100, 106)}
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in graphdedup.near_duplicates(d).collect()} == want
    assert graphdedup.near_duplicates(d.limit(0)).count() == 0


def vector_groups(spark, groups, size):
    """Nodes of one label in groups of near copies that lie far from each other, and their true links."""
    rng = np.random.default_rng(5)
    x = graphdedup.unit(np.repeat(rng.normal(size=(groups, 32)), size, axis=0) + 0.01 * rng.normal(size=(groups * size, 32)))
    i, j = np.nonzero(np.triu(x @ x.T >= 0.98, 1))
    return spark.createDataFrame([("a", 32, k, v.tolist()) for k, v in enumerate(x)], "label string, width int, node long, v array<double>"), set(zip(i.tolist(), j.tolist(), strict=True))


@pytest.mark.parametrize("size", [60, 500])
def test_groups_of_near_vectors_are_all_reached(spark, size):
    nodes, want = vector_groups(spark, 10, size)
    assert len(want) == 10 * size * (size - 1) // 2
    got = {(r.u, r.v) for r in graphdedup.near_links(nodes).collect()}
    assert got <= want and len(got) >= 0.99 * len(want)


@pytest.mark.parametrize("most", [50, 4000])
def test_labels_of_low_recall_are_compared_exactly(spark, monkeypatch, most):
    nodes, want = vector_groups(spark, 3, 60)
    easy = nodes.selectExpr("'b' AS label", "width", "node + 1000 AS node", "v")
    nodes = nodes.unionByName(easy).selectExpr("*", "node % 100 IN (0, 7) AS asked")
    full = graphdedup.near_links

    def poor(left, *args):  # finds all of label b and nothing of label a
        return full(left, *args).where("u >= 1000")

    monkeypatch.setattr(graphdedup, "near_links", poor)
    monkeypatch.setattr(graphdedup, "MOST_ASKED", 50)
    monkeypatch.setattr(graphdedup, "MOST_SHARD", most)
    got = [(r.u, r.v) for r in graphdedup.audited_links(nodes, tries=1).collect()]
    assert len(got) == len(set(got)) and {x for x in got if x[0] < 1000} == want
    assert len(got) == 2 * len(want)
    if most < 180:
        return
    none = graphdedup.audited_links(nodes.withColumn("asked", nodes.node < 0), tries=1)  # no evidence at all
    assert {(r.u, r.v) for r in none.where("u < 1000").collect()} == want


def test_vector_graph_measures_labels_without_links_in_the_audit(spark, monkeypatch):
    """A large label whose only links are between vectors that the audit does not ask for, and a search that finds nothing."""
    monkeypatch.setattr(graphdedup, "MOST_SHARD", 20)
    monkeypatch.setattr(graphdedup, "near_links", lambda nodes, *_: nodes.sparkSession.createDataFrame([], "u long, v long"))
    rng = np.random.default_rng(9)
    x = rng.normal(size=(150, 32)).astype(np.float32)
    x[77] = x[33] * 1.01 + 0.001
    d = spark.createDataFrame([(i + 1, v.tolist(), 1 + (i % 100 == 99)) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r.vec_id: r for r in graphdedup.near_duplicates(d).collect()}
    assert {i: r.n_links for i, r in got.items() if r.n_links} == {34: 1, 78: 1} and got[78].component_id == 34 and not got[78].kept


def test_jaccard(docs, empty):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in TEXTS:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if (c := len(sets[i] & sets[j])) and 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c)]
    part = classes(len(sets), links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == {3 * i: (len(s), 3 * part[i]) for i, s in enumerate(sets)}
    assert jaccard.near_duplicates(empty).count() == 0



def test_jaccard_of_repeated_and_null_ids(spark):
    """Rows are named by their sets: an id with several texts keeps the links of each, null ids link as well."""
    other = " ".join(f"word{i}" for i in range(40))
    a, b, c = " ".join(f"a{i}" for i in range(40)), other, " ".join(f"c{i}" for i in range(40))
    rows = [(1, a), (2, a + " z"), (2, b), (3, b + " z"), (None, c), (None, c + " z"), (9, c + " y"), (None, "alone " * 3), (4, None), (None, ""), (3, b + " z")]
    got = [tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", "component_id", "kept").collect()]
    want = [(1, 1, True), (2, 1, False), (2, 2, True), (3, 2, False), (3, 2, False), (None, 9, False), (None, 9, False), (9, 9, True), (None, None, True), (4, 4, True), (None, None, True)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_parity_never_undercounts():
    rng = np.random.default_rng(9)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 300)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.7], rng.integers(0, 1 << 63, rng.integers(1, 900)).astype(np.uint64)]))
        assert jaccard.most_common(len(a), len(b), jaccard.parity(a), jaccard.parity(b)) >= len(np.intersect1d(a, b))


def test_language(spark, empty):
    en, de = "the house and the garden are very old and quiet", "das haus und der garten sind sehr alt und ruhig"
    train = spark.createDataFrame([(i, (en, de)[i % 2], ("en", "de")[i % 2]) for i in range(60)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    asked = spark.createDataFrame([(1, en, "zz"), (2, de, None), (3, None, "en"), (4, "123 !?", "en"), (5, f"{en} {en} {de}", "en"), (6, "½ ² Ⅳ ①", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(asked, model, with_spans=True).collect()}
    assert [got[i].lang_pred for i in range(1, 7)] == ["en", "de", "und", "und", "en", "und"]
    assert [s.lang for s in got[5].spans] == ["en", "de"] and 0.5 < got[5].score < 0.8 and got[3].score == 0
    assert langid.identify(empty).count() == 0
    unlearnt = langid.predict(asked, langid.fit(train.limit(0))).collect()
    assert {r.lang_pred for r in unlearnt} == {"und"}


def test_language_against_a_plain_viterbi(spark):
    rng = np.random.default_rng(1)
    model = langid.Model(["a", "b", "c"], rng.normal(size=(langid.BUCKETS, 3)), {})
    labeller = langid.Labeller(model, switch=2.0)
    texts = [" ".join(rng.choice(["foo", "bar", "baz", "qux", "zip", "zap"], n)) for n in (1, 2, 7, 30, 0)]
    words, labels = labeller.label(texts)
    for w, got in zip(words, labels, strict=True):
        s = np.array([labeller.scores[labeller.ids[x]] for x in w], float).reshape(len(w), 3)
        best = max((sum(s[i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in itertools.pairwise(p)) for p in itertools.product(range(3), repeat=len(w))), default=0) if len(w) <= 7 else None
        if best is not None and len(w):
            value = sum(s[i, k] for i, k in enumerate(got)) - 2.0 * sum(a != b for a, b in itertools.pairwise(got))
            assert abs(value - best) < 1e-4


def test_ordinal_regression():
    rng = np.random.default_rng(3)
    n, f = 3000, 6
    x = rng.random((n, f)) < 0.3
    w = np.array([3.0, 1.5, -2.0, 0.0, 0.5, 4.0])
    y = np.searchsorted([1.0, 3.5], x @ w + rng.logistic(size=n))
    r, c = np.nonzero(x)
    got, theta = toxicity.fit_ordinal(r, c, y, f, ridge=1e-6)
    assert np.allclose(got, w, atol=0.5) and np.allclose(theta, [1.0, 3.5], atol=0.4)
    odds = toxicity.Model(np.arange(f), got, theta).grade_odds(np.array([-100.0, 0.0, 100.0]))
    assert np.allclose(odds.sum(axis=1), 1) and odds[0, 0] > 0.99 and odds[2, 2] > 0.99 and (odds >= 0).all()


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(200)] + [(4, 0, 1), (None, 1, 1), (9, None, 1)], "doc_id long, toxic int, quality int")
    texts = spark.createDataFrame([(i, f"plain words number {i} " + ("awful " * (i % 3 + 1) if i % 4 == 0 else "fine")) for i in range(200)] + [(900, None), (901, "awful awful")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.severities(texts, labels).collect()}
    assert all(got[i].toxic == (i % 4 == 0) for i in range(200)) and not got[900].toxic and got[901].toxic
    assert toxicity.severities(empty, labels).count() == 0
    assert {r.severity < 0.01 for r in toxicity.severities(docs, labels.limit(0)).collect()} == {True}


def test_packing(docs, empty):
    t = Tokenizer.from_file(BYTE)
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack_tokens(docs, BYTE, end_id=0).collect():
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    for i, x in enumerate(TEXTS):
        ids, at = [*t.encode(x or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(by[3 * i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for rows in seq.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == list(itertools.accumulate([0, *(r.length for r in rows[:-1])])) and sum(r.length for r in rows) <= 1024
    assert packing.pack_tokens(empty, BYTE, 0).count() == 0
    assert all(sum(packing.cut_lengths(n)) == n for n in range(5000))


def test_lines(docs, empty):
    kept, want = [], {}
    for i, t in enumerate(TEXTS):
        out = []
        for raw in (t or "").split("\n"):
            line = linededup.normal(raw)
            if len(line) >= linededup.LEAST:
                if any(linededup.jaccard_reaches(line, k) for k in kept):
                    continue
                kept.append(line)
            out.append(raw)
        want[3 * i] = None if t is None else "\n".join(out)
    got = linededup.dedup_lines(docs)
    assert set(docs.columns) <= set(got.columns)
    assert {r.doc_id: r.text for r in got.collect()} == want
    assert linededup.dedup_lines(empty).count() == 0


def test_short_lines_are_removed(spark):
    texts = ["Menu\n\nHome page two\n日本語の文です。\nfirst", "menu \n\nhome page  two\n日本語の文です。\nsecond", "Menu\nHome"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_dropped) for r in linededup.dedup_lines(docs).collect()}
    assert got == {0: (texts[0], 0), 1: ("\nsecond", 3), 2: ("Home", 1)}


def test_likeness_of_fingerprints_follows_the_texts():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(words, n))
    mark = lambda t: fingerprint.fingerprint(fingerprint.code_points(t))
    hashed = lambda t: fingerprint.Hashed(fingerprint.code_points(t))
    gaps = []
    for n in (30, 200, 2000, 9000):
        a, b = text(n), text(n)
        half = len(a) // 2
        for c in (a[:half] + b[half:], b[:half] + a[half:], "new " + a[: half // 2] + " other " + a[half // 2 :] + " end", a[half:] + a[:half], a + " " + b, b[:99] + a + b[:99], b):
            near, exact = fingerprint.likeness(mark(a), mark(c)), fingerprint.shared(hashed(a), hashed(c))
            assert near == fingerprint.likeness(mark(c), mark(a)) and 0 <= near <= exact + 0.02
            gaps.append(exact - near)
    assert np.mean(gaps) < 0.12
    for t in ("", "x", "x" * 100_000, "abab" * 20_000, " \n"):
        assert fingerprint.likeness(mark(t), mark(t)) == 1.0 and len(mark(t)) < 2000
    assert fingerprint.likeness(mark(""), mark("a")) == 0.0


def test_fingerprints(spark, docs, empty):
    rows = sorted(((i * 3, t or "") for i, t in enumerate(TEXTS)), reverse=True)
    got = {r.doc_id: r for r in fingerprint.compare_with_edits(docs, per_bucket=4).collect()}
    for k, (i, t) in enumerate(rows):
        changed = fingerprint.edit(t, rows[(k + 1) % len(rows)][1])
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert got[i].edited_fingerprint == fingerprint.fingerprint(fingerprint.code_points(changed))
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert got[i].near_edited == fingerprint.likeness(got[i].fingerprint, got[i].edited_fingerprint)
        assert got[i].near_next == fingerprint.likeness(got[i].fingerprint, fingerprint.fingerprint(fingerprint.code_points(rows[(k + 1) % len(rows)][1])))
    assert got[0].fingerprint == got[3].fingerprint and got[3].near_next == 1.0 and got[0].near_edited > 0.4
    assert fingerprint.compare_with_edits(empty).count() == 0
    alone = fingerprint.compare_with_edits(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_shared_passages():
    rng = np.random.default_rng(3)
    of = lambda n, lo=97: "".join(map(chr, rng.integers(lo, lo + 26, n)))
    hashed = lambda t: fingerprint.Hashed(fingerprint.code_points(t))
    near = lambda a, b: fingerprint.shared(hashed(a), hashed(b))
    head, tail, body = of(30_000), of(777), of(5000)
    assert near(head + of(970_000), head + of(970_000, 65)) == 0.03
    for k in (0, 1, 7, 1000):  # against the common prefix and suffix, letter by letter
        a, b = body[:k] + "A" + of(900) + tail, body[:k] + "B" + of(900, 65) + tail
        want = next(i for i in range(len(a)) if a[i] != b[i]) + next(i for i in range(len(a)) if a[-1 - i] != b[-1 - i])
        assert near(a, b) == want / len(a)
    assert near("A" + body + "C", "B" + body + "D") == 5000 / 5002
    assert near(body[:2500] + body[2500:], body[2500:] + body[:2500]) > 0.97
    assert near(body, of(5000, 65)) == 0 and near("", "") == 1 and near("", "a") == 0 and near("a" * 50, "a" * 40) == 0.8


def test_prefix_hashes():
    a, b = fingerprint.code_points("xxhello world!"), fingerprint.code_points("hello worms")
    p, q = fingerprint.PrefixHash(a), fingerprint.PrefixHash(b)
    assert p.extension(2, q, 0) == len("hello wor") and p.equal(2, q, 0, 9) and not p.equal(2, q, 0, 10)


@pytest.mark.parametrize("most_local", [0, 1000])
def test_components_by_one_task_or_by_stars(spark, most_local):
    from lumispan.llm.components import components

    rng = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(200 + i, 201 + i) for i in range(40)] + [(5, 5), (300, 7), (300, 7)]
    least = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in least:
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    found = components(spark.createDataFrame(edges, "u long, v long").repartition(4), most_local=most_local).collect()
    assert len(found) == len(least) and {r.id: r.component for r in found} == least
    none = components(spark.createDataFrame([], "u long, v long"), most_local=most_local)
    assert none.count() == 0


@pytest.mark.parametrize("block", [2048, 7])
def test_components_of_lines_against_brute_force(spark, monkeypatch, block):
    """A chain whose ends are not alike, a group of near copies larger than the buckets that are compared without arrays, and strangers."""
    rng = np.random.default_rng(11)
    of = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    monkeypatch.setattr(linededup, "candidates", lambda rows, every, percent, f=linededup.candidates: f(rows, every, percent, block))
    chain = [of(240)]
    for _ in range(5):
        chain.append(chain[-1][12:] + of(12))
    base, group = of(300), []
    for _ in range(60):
        at = int(rng.integers(0, 280))
        group.append(base[:at] + of(int(rng.integers(1, 20))) + base[at + int(rng.integers(0, 20)) :])
    lines = chain + group + [of(100) for _ in range(20)] + ["short", "short"]
    sets = [linededup.shingle_set(x) for x in lines]
    links = [(i, j) for i, j in itertools.combinations(range(len(lines)), 2) if linededup.sets_reach(sets[i], sets[j])]
    part = classes(len(lines), links)
    assert part[5] == part[0] and not linededup.sets_reach(sets[0], sets[5])
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_dropped for r in linededup.dedup_lines(docs).collect()}
    assert got == {i: int(part[i] != i) for i in range(len(lines))}


def test_bounds_of_lines_never_hide_a_link():
    rng = np.random.default_rng(12)
    lines = ["".join(map(chr, rng.integers(97, 123, 150)))]
    for _ in range(59):
        x = lines[int(rng.integers(0, len(lines)))]
        at, n = int(rng.integers(0, len(x))), int(rng.integers(1, 40))
        lines.append(x[:at] + "".join(map(chr, rng.integers(97, 123, n))) + x[at:] if rng.random() < 0.5 else x[:at] + x[at + n :] + "padding")
    h, starts = linededup.shingle_hashes(lines)
    sets = [np.unique(x) for x in np.split(h, starts[1:])]
    size, bits, own = [len(x) for x in sets], [jaccard.parity(x) for x in sets], list(range(len(lines)))
    exact = {(i, j) for i, j in itertools.combinations(own, 2) if linededup.jaccard_reaches(lines[i], lines[j])}
    one = [0] * len(lines)
    bucket = linededup.Bucket(np.array(own), np.array(one), np.array(size), bits, 80)
    every = set(bucket.every())
    assert exact <= every and every == set(linededup._few(own, one, size, bits, 80, True))
    few = linededup._few(own, one, size, bits, 80, False)
    assert classes(len(lines), bucket.forest()) == classes(len(lines), few) == classes(len(lines), every)


def test_recall_of_bands():
    """Of the lines of similarity 0.8 or more, at least 0.97 meet in a band."""
    rng = np.random.default_rng(13)
    met = total = 0
    for _ in range(600):
        a = "".join(map(chr, rng.integers(97, 123, int(rng.integers(60, 400)))))
        at, n = int(rng.integers(0, len(a))), int(rng.integers(1, 1 + len(a) // 14))
        b = a[:at] + a[at + n :]
        if linededup.jaccard_reaches(a, b):
            k = linededup.band_keys([a, b])
            total, met = total + 1, met + bool((k[0] == k[1]).any())
    assert total > 300 and met >= 0.97 * total
