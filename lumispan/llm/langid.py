"""Language identification of mixed-language texts.

Words are runs of letters. The ranges of Unicode scripts narrow the languages that a word may have; hashed character n-grams
score it for each of those; and a Viterbi pass over the words, with a penalty for each switch, labels spans. The language of
a text is that of most letters, its score their share.

A model learns from at most ``most_docs`` texts with a language (bounded, by a hash of their ids
and texts, so the same at every size; rows that repeat both count once).
A text that is null or has no letter gets ``und`` and score 0. An empty training set gives a model that says ``und``. Ties go
to the language that comes first by name.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumispan.llm.common import small_slices, with_columns, worker_cache

BUCKETS = 1 << 16
SWITCH = 9.0  # nats
WORD_BOUND = 6.0  # most that a word can speak for one language against another
MOST_DOCS = 4000
RARE = 0.002  # a language has a script if so much of its letters is in it
_LETTERS = re.compile(r"[^\W\d_]+")  # of texts without _NUMBERS
_NUMBERS = r"[\p{Nl}\p{No}]"  # such as fractions and Roman numerals: \w has them, but they are no letters

# First code points of ranges and the scripts of the letters in them.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0780, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x1380, "Other"), (0x1780, "Khmer"), (0x1800, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"),
    (0xF900, "Han"), (0xFB00, "Latin"), (0xFB10, "Other"), (0xFF21, "Latin"), (0xFF5B, "Other"), (0x20000, "Han"), (0x30000, "Other"),
]
_FIRST = [a for a, _ in SCRIPTS]


def script(word: str) -> str:
    """The script of the word's first letter beyond ASCII, or Latin."""
    for c in word:
        if c > "\x7f":
            return SCRIPTS[bisect_right(_FIRST, ord(c)) - 1][1]
    return "Latin"


def grams(word: str) -> list[int]:
    """Buckets of the 2- to 4-grams of the word with its ends marked, and of the word."""
    w = f"^{word}$"
    found = [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in [*found, "=" + word]]


@dataclass
class Model:
    langs: list[str]
    weight: np.ndarray  # (BUCKETS, languages) log probabilities against their mean
    scripts: dict[str, np.ndarray]  # the languages that a script leaves


def fit(docs: DataFrame, most_docs: int = MOST_DOCS) -> Model:
    """Learn from (doc_id, text, lang); rows without text or lang are left out."""
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select(F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    limit = rows.select("h").orderBy("h").limit(most_docs).agg(F.max("h")).first()[0]
    if limit is None:
        return Model([], np.zeros((BUCKETS, 0)), {})

    def run(batches):
        count: dict[str, np.ndarray] = {}
        letters: Counter = Counter()
        for batch in batches:
            for text, lang in zip(pc.replace_substring_regex(batch.column("text"), _NUMBERS, " ").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                words = Counter(_LETTERS.findall(text.lower()))
                mine = count.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for w, n in words.items():
                    np.add.at(mine, grams(w), n)
                    letters[lang, script(w)] += n * len(w)
        langs, keys, names, n = [], [], [], []
        for lang, c in count.items():
            at = np.flatnonzero(c)
            langs += [lang] * len(at)
            keys += at.tolist()
            names += [None] * len(at)
            n += c[at].tolist()
        for (lang, s), m in letters.items():
            langs.append(lang)
            keys.append(-1)
            names.append(s)
            n.append(m)
        if langs:
            yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(keys, pa.int32()), pa.array(names, pa.string()), pa.array(n, pa.int64())], names=["lang", "key", "script", "n"])

    # at most BUCKETS rows a language and one a script
    table = rows.where(F.col("h") <= limit).dropDuplicates(["h"]).select("text", "lang").repartition(16).mapInArrow(run, "lang string, key int, script string, n long").groupBy("lang", "key", "script").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(table["lang"].unique())
    weight = np.full((BUCKETS, len(langs)), 0.1)
    share: dict[str, np.ndarray] = {}
    for i, lang in enumerate(langs):
        mine = table[table["lang"] == lang]
        counts = mine[mine["key"] >= 0]
        weight[counts["key"].to_numpy(), i] += counts["n"].to_numpy()
        in_scripts = mine[mine["key"] < 0]
        for s, n in zip(in_scripts["script"], in_scripts["n"], strict=True):
            share.setdefault(s, np.zeros(len(langs)))[i] = n / in_scripts["n"].sum()
    weight = np.log(weight / weight.sum(axis=0))
    return Model(langs, weight - weight.mean(axis=1, keepdims=True), {s: x >= RARE for s, x in share.items() if (x >= RARE).any()})


class Labeller:
    """Scores of words, kept while they come again, and the Viterbi pass over many texts at once."""

    def __init__(self, model: Model, switch: float = SWITCH, entries: int = 300_000):
        self.model, self.switch, self.entries = model, switch, entries
        self.reset()

    def reset(self) -> None:
        self.ids: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.model.langs)), np.float32)

    def learn(self, words: list[str]) -> None:
        m = self.model
        while len(self.scores) < len(self.ids) + len(words):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        at = len(self.ids)
        lists = [grams(w) for w in words]
        flat = np.fromiter((g for x in lists for g in x), np.int64)
        starts = np.cumsum([0, *map(len, lists[:-1])])
        total = np.add.reduceat(m.weight[flat], starts, axis=0)
        total -= total.max(axis=1, keepdims=True)
        total = np.maximum(total, -WORD_BOUND)
        for i, w in enumerate(words):
            allowed = m.scripts.get(script(w))
            if allowed is not None and not allowed.all():
                total[i] = np.where(allowed, total[i] - total[i][allowed].max(), -2 * WORD_BOUND - 2 * self.switch)
            self.ids[w] = at + i
        self.scores[at : at + len(words)] = total

    def label(self, texts: list[str | None]) -> tuple[list[list[str]], list[np.ndarray]]:
        """The words of each text and the language of each word."""
        words = [_LETTERS.findall(t.lower()) if t else [] for t in texts]
        if len(self.ids) > self.entries:
            self.reset()
        get, missing = self.ids.get, set()
        for w in words:
            missing.update(w)
        missing = [w for w in missing if w not in self.ids]
        for at in range(0, len(missing), 4096):  # a word has some thirty grams
            self.learn(missing[at : at + 4096])
        size = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-size, kind="stable")
        order = order[size[order] > 0]
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(texts)
        if not len(order):
            return words, out
        starts = np.concatenate([[0], np.cumsum(size[order])])[:-1]
        flat = np.fromiter((get(x) for i in order for x in words[i]), np.int64, int(size.sum()))
        sizes = size[order]
        best = self.scores[flat[starts]].copy()
        active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")  # texts with at least so many words
        lead, moved = [], []
        for t in range(1, int(sizes[0])):
            a = active[t]
            now = best[:a]
            top = now.argmax(axis=1)
            jump = now[np.arange(a), top] - np.float32(self.switch)
            turn = now < jump[:, None]
            lead.append(top.astype(np.int8))
            moved.append(turn)
            best[:a] = np.where(turn, jump[:, None], now) + self.scores[flat[starts[:a] + t]]
        state = best.argmax(axis=1)
        labels = np.empty(len(flat), np.int8)
        labels[starts + sizes - 1] = state
        for t in range(int(sizes[0]) - 1, 0, -1):
            a = active[t]
            s = labels[starts[:a] + t]
            labels[starts[:a] + t - 1] = np.where(moved[t - 1][np.arange(a), s], lead[t - 1], s)
        for j, i in enumerate(order):
            out[i] = labels[starts[j] : starts[j] + sizes[j]]
        return words, out


def _decide(words: list[str], labels: np.ndarray, langs: list[str]) -> tuple[str, float]:
    if not len(labels):
        return "und", 0.0
    letters = np.bincount(labels, np.fromiter(map(len, words), np.int64, len(words)), len(langs))
    i = int(letters.argmax())
    return langs[i], float(letters[i] / letters.sum())


def spans(text: str, labels: np.ndarray, langs: list[str]) -> list[tuple[str, int, int]]:
    """(language, start, end) of each run of words of one language, as code points of the lower-cased text."""
    out: list[tuple[str, int, int]] = []
    for m, s in zip(_LETTERS.finditer(text.lower()), labels.tolist(), strict=True):
        if out and out[-1][0] == langs[s]:
            out[-1] = (langs[s], out[-1][1], m.end())
        else:
            out.append((langs[s], m.start(), m.end()))
    return out


def predict(docs: DataFrame, model: Model, with_spans: bool = False, switch: float = SWITCH) -> DataFrame:
    """``docs`` with lang_pred and score of each text, and its spans if asked for."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS by languages
    fields = "lang_pred string, score double" + ", spans array<struct<lang:string,start:int,end:int>>" * with_spans

    def columns(batches):
        m = shared.value
        labeller = worker_cache("langid", (id(m), switch), lambda: Labeller(m, switch))  # holds ``m``, so its id stays its own
        for batch in batches:
            for some in small_slices(batch, "text", 1 << 20):
                texts = pc.replace_substring_regex(some.column("text"), _NUMBERS, " ").to_pylist()
                if m.langs:
                    words, labels = labeller.label(texts)
                else:
                    words, labels = [[]] * len(texts), [np.zeros(0, np.int8)] * len(texts)
                found = [_decide(w, x, m.langs) for w, x in zip(words, labels, strict=True)]
                new = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
                if with_spans:
                    kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
                    new.append(pa.array([[dict(zip(("lang", "start", "end"), s, strict=True)) for s in spans(t or "", x, m.langs)] if len(x) else [] for t, x in zip(texts, labels, strict=True)], kind))
                yield some, new

    return with_columns(docs, fields, columns)


def held_out(doc_id: Column) -> Column:
    """Whether a row is in the third of the ids that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, most_docs: int = MOST_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred and score; the model learns from the rows of ``docs`` that are not held out."""
    model = fit(docs.where(~held_out(F.col("doc_id"))), most_docs)
    return predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
