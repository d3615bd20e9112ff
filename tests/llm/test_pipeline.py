"""The pipeline's stages on the smallest tables, each against a plain version of itself on what the stages before it kept."""

import collections
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pyspark.sql.functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lumispan.llm import langid, linededup, toxicity

DIR = "/root/testdata/sf0.001"


def smallest(n, links):
    """The smallest member of each item's component."""
    part = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if part[i] != part[j]:
                part[i] = part[j] = min(part[i], part[j])
                changed = True
    return part


def plain_language(spark, rows):
    """Ids of the texts whose main language, by a Viterbi pass over one word after the other, has its share of the letters."""
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{DIR}/documents.parquet").schema)
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    keep = set()
    for r in rows:
        words = ["".join(x) for alpha, x in itertools.groupby((r.text or "").lower(), str.isalpha) if alpha]
        if not words:
            continue
        scorer = langid.Labeller(model)
        scorer.learn(sorted(set(words)))
        best, back = np.zeros(len(model.langs), np.float32), []
        for at, w in enumerate(words):
            jump = best.max() - np.float32(langid.SWITCH)
            back.append(np.where(best < jump, best.argmax(), np.arange(len(best))))
            best = (np.maximum(best, jump) if at else best) + scorer.scores[scorer.ids[w]]
        state, letters = int(best.argmax()), collections.Counter()
        for at in range(len(words) - 1, -1, -1):
            letters[state] += len(words[at])
            state = int(back[at][state])
        if max(letters.values()) >= corpus_pipeline.LEAST_SHARE * sum(letters.values()):
            keep.add(r.doc_id)
    return keep


def plain_toxicity(spark, rows):
    """Ids of the texts of which grade 0 is at least as likely as the others."""
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{DIR}/documents.parquet").schema)
    model = toxicity.learn(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    weight = dict(zip(map(int, model.place), map(float, model.weight), strict=True))
    score = [sum(weight.get(f, 0.0) for f in sorted({f for w in toxicity.words(r.text) for f in toxicity.features(w)})) for r in rows]
    odds = model.grade_odds(np.array(score))
    return {r.doc_id for r, o in zip(rows, odds, strict=True) if o[0] >= 0.5 - 1e-12}


def plain_lines(rows):
    """Text by id without the lines that are like an earlier one, by all pairs of lines; documents without any line left go."""
    places = sorted((r.doc_id, i, linededup.normal(x)) for r in rows for i, x in enumerate(r.text.split("\n")) if x.strip())
    lines = list(dict.fromkeys(x for *_, x in places))
    sets = [linededup.shingle_set(x) for x in lines]
    links = [(i, j) for i, j in itertools.combinations(range(len(lines)), 2) if 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j])) and linededup.sets_reach(sets[i], sets[j])]
    of, seen, gone = dict(zip(lines, smallest(len(lines), links), strict=True)), set(), set()
    for doc, i, x in places:
        if of[x] in seen:
            gone.add((doc, i))
        seen.add(of[x])
    out = {r.doc_id: "\n".join(x for i, x in enumerate(r.text.split("\n")) if (r.doc_id, i) not in gone) for r in rows}
    return {r.doc_id: out[r.doc_id] for r in rows if out[r.doc_id].strip() or out[r.doc_id] == r.text}


def plain_copies(rows):
    """The smallest ids of the groups of texts that link by their sets of 5-word shingles, by all pairs."""
    rows = sorted(rows, key=lambda r: r.doc_id)
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if (c := len(sets[i] & sets[j])) and 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c)]
    return {rows[i].doc_id for i, p in enumerate(smallest(len(rows), links)) if i == p}


def check_packing(rows, pieces):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    of, used = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        of[p.doc_id].append(p)
        used[p.sequence_id].append((p.offset, p.length))
    assert set(of) == {r.doc_id for r in rows}
    for r in rows:
        ids, at = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 0], 0
        for p in sorted(of[r.doc_id], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes()))
            at += p.length
        assert at == len(ids)
    for places in used.values():
        places.sort()
        assert [a for a, _ in places] == [0, *itertools.accumulate(n for _, n in places)][:-1] and sum(n for _, n in places) <= 1024
    tokens = sum(n for places in used.values() for _, n in places)
    assert 1024 * len(used) <= 1.03 * tokens + 1024, "little padding"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, schema = docs.columns, docs.schema
    rows = docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, spark.createDataFrame(rows, schema), DIR)
        assert out.columns == columns
        got = out.collect()
        if name == "line dedup":
            assert {r.doc_id: r.text for r in got} == plain_lines(rows)
        else:
            kept = {"language ID": lambda: plain_language(spark, rows), "toxicity": lambda: plain_toxicity(spark, rows), "n-gram Jaccard join": lambda: plain_copies(rows)}[name]()
            text = {r.doc_id: r.text for r in rows}
            assert {r.doc_id for r in got} == kept and all(r.text == text[r.doc_id] for r in got), name
        assert len(got) > 0.5 * len(rows)
        rows = got
    check_packing(rows, corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame(rows, schema), DIR).collect())


def test_stages_of_messy_tables(spark):
    """Nulls in any column, empty texts, repeated rows and a clashing column pass every stage; an empty table stays empty."""
    base = spark.read.parquet(f"{DIR}/documents.parquet").limit(40)
    extra = [(None, "a text without an id of its own", "en", "s", 1), (None, None, None, None, None), (7001, None, "en", "s", 0), (7002, "", None, None, 0), (7003, "the very same row, twice over", "en", "s", 1), (7003, "the very same row, twice over", "en", "s", 1)]
    messy = base.unionByName(spark.createDataFrame(extra, base.schema)).withColumn("score", F.lit("x")).withColumn("component_id", F.lit(None).cast("long"))
    for table in (messy, messy.limit(0)):
        docs, some = table, table is messy
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, DIR)
            assert docs.columns == messy.columns, name
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            assert (docs.count() > 0) == some, name
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, DIR).count() > 0) == some


def test_documents_with_short_lines_left_stay(spark):
    long = "a line that is repeated in several documents"
    texts = [long, f"{long}\nroses\nare red", f"{long}\n \u00a0\t", "a\n\nb"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_lines(spark, docs, "").collect()}
    assert got == {0: long, 1: "roses\nare red", 3: "a\n\nb"}
