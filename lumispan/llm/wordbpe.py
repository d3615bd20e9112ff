"""Batch encoding with the ``tokenizers`` library that encodes each distinct word once per worker.

Both pre-tokenizers handled here never join what stands on two sides of certain spaces and line ends, so the ids of a text are
the ids of its pieces between those, one after the other. Arrow cuts a column of texts into pieces and numbers the distinct
ones; a bounded cache holds their ids, and the ids of the texts are gathered from those. A word of Latin letters with
punctuation after it is learnt as two parts, since the same letters come with other punctuation too. Any text, or tokenizer
file, for which that is not certain goes through the library whole.
"""

from __future__ import annotations

import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lumispan.llm.common import worker_cache

CACHE_ENTRIES = 100_000
_ODD_SPACE = re.compile(r" (?:\s|$)")
_CUT = re.compile(r" (?=\S)")
_CONTROL = re.compile("[\x01\x1c-\x1f]")
_WHITE = r"\t\x0b-\r\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"  # but space and line feed
LITERAL = "\x02"  # leads a piece that no space stands before
_PLAIN = r"\A(?P<lead>[\n\x02]?)(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)\z"  # ASCII punctuation but the apostrophe


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    rest = (b for b in range(256) if b not in out)
    return out | {b: chr(256 + i) for i, b in enumerate(rest)}


def segments(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The parts of ``pool`` that begin at ``start`` and are ``size`` long, one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat((start - ends + size).astype(np.int32), size) + np.arange(total, dtype=np.int32)]


class Store:
    """The ids of words: a place for each in one array."""

    def __init__(self, dtype: np.dtype):
        self.index: dict[str, int] = {}
        self.start, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool, self.used = np.zeros(4096, dtype), 0

    def find(self, words: list[str]) -> np.ndarray:
        """The number of each word, -1 where it is not held."""
        return np.fromiter(map(self.index.get, words, itertools.repeat(-1)), np.int64, len(words))

    def add(self, words: list[str], ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Hold new words, whose ids are parts of ``ids``."""
        n, k = len(self.index), len(words)
        while len(self.start) < n + k:
            self.start, self.size = np.concatenate([self.start, self.start]), np.concatenate([self.size, self.size])
        while len(self.pool) < self.used + len(ids):
            self.pool = np.concatenate([self.pool, self.pool])
        self.pool[self.used : self.used + len(ids)] = ids
        self.start[n : n + k], self.size[n : n + k] = start + self.used, size
        self.used += len(ids)
        self.index.update(zip(words, range(n, n + k), strict=True))
        return np.arange(n, n + k)


class WordEncoder:
    """``encode(texts)`` gives one array of unsigned ids a text, equal to the library's with add_special_tokens=False."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        self.vocab_size = self.full.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.vocab_size <= 1 << 16 else "<u4")
        self.entries = entries
        self.cache = Store(self.dtype)
        self.older = Store(self.dtype)  # the one before; what is used again moves on
        self.first: dict[str, bytes] = {}
        self.added = [a.content for a in self.full.get_added_tokens_decoder().values()]
        self.kind = self._kind()
        vocab = self.full.get_vocab(with_added_tokens=True)
        names = [""] * (max(vocab.values()) + 1)
        for k, v in vocab.items():
            names[v] = k
        self.names = names
        self.opens = np.array([n.startswith("Ġ") for n in names])
        self.closes = np.array([n.endswith("</w>") for n in names])
        if self.kind != "other":
            # the same merges without normalizer and pattern, for words that need neither
            self.alphabet = byte_alphabet() | {32: " "}
            self.space = names.index("Ġ") if self.kind == "byte" else -1
            self.bare = Tokenizer(self.full.model)
            self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.tail: dict[str, np.ndarray] = {}
            self.mark, self.line_end = self._ids("\x01"), self._ids("\n")
            added = "".join(f"|{re.escape(a)}" for a in self.added)
            self.plain = _PLAIN if self.kind == "byte" else _PLAIN.replace(r"[\n\x02]?", "")  # only byte-level pieces have leads
            self.odd = (rf"[ \n](?:[ \n{_WHITE}]|\z)|\x02" if self.kind == "byte" else rf"[\x01{_WHITE}]") + added

    def _kind(self) -> str:
        from tokenizers import models

        part = lambda x: json.loads(x.__getstate__()) if x is not None else {}
        pre, norm, post, model = part(self.full.pre_tokenizer), part(self.full.normalizer), part(self.full.post_processor), self.full.model
        if not isinstance(model, models.BPE) or model.dropout or post.get("type", "ByteLevel") != "ByteLevel":
            return "other"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm and not model.end_of_word_suffix:
            return "byte"
        if [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and model.end_of_word_suffix == "</w>" and [p["type"] for p in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"]:
            return "word"
        return "other"

    def _whole(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, self.dtype) for x in self.encode_bytes(texts)]

    def encode_bytes(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids as little-endian integers of ``self.dtype``; an Arrow column has no nulls."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if self.kind == "other":
            return [np.array(e.ids, self.dtype).tobytes() for e in self.full.encode_batch(column.to_pylist(), add_special_tokens=False)]
        if len(self.cache.index) > self.entries:
            self.older, self.cache = self.cache, Store(self.dtype)
        for held in (self.first, self.tail):
            if len(held) > self.entries // 4:
                held.clear()
        odd = pc.match_substring_regex(column, self.odd).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(column)
        for plain, encode in ((~odd, self._encode_plain), (odd, self._encode_odd)):
            if plain.any():
                for i, ids in zip(np.flatnonzero(plain).tolist(), encode(column.filter(pa.array(plain))), strict=True):
                    out[i] = ids
        return out

    def _known(self, words: list[str]) -> np.ndarray:
        """The numbers in the cache of distinct words, learnt where they are new."""
        at = self.cache.find(words)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            lost = [words[i] for i in miss.tolist()]
            held = self.older.find(lost)
            again, new = np.flatnonzero(held >= 0), np.flatnonzero(held < 0)
            if len(again):
                start, size = self.older.start[held[again]], self.older.size[held[again]]
                at[miss[again]] = self.cache.add([lost[i] for i in again.tolist()], segments(self.older.pool, start, size), np.cumsum(size) - size, size)
            if len(new):
                at[miss[new]] = self._learn([lost[i] for i in new.tolist()])
        return at

    def _encode_plain(self, column: pa.Array) -> list[bytes]:
        """Texts in which every space and line end is a place to cut."""
        if self.kind == "byte":
            column = pc.binary_join_element_wise(LITERAL, pc.replace_substring(column, "\n", " \n"), "")
        else:
            column = pc.replace_substring(column, "\n", " ")
        lists = pc.split_pattern(column, " ")
        coded = lists.flatten().dictionary_encode()
        codes, lasts = coded.indices.to_numpy(), np.cumsum(lists.value_lengths().to_numpy()) - 1
        at = self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[codes]
        size = self.cache.size[at]
        raw = segments(self.cache.pool, self.cache.start[at], size).tobytes()
        ends = (np.cumsum(size)[lasts] * self.dtype.itemsize).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _encode_odd(self, column: pa.Array) -> list[bytes]:
        texts = column.to_pylist()
        out: list[bytes] = [b""] * len(texts)
        for i, text in enumerate(texts):
            words = self._pieces(text)
            if words is None:
                out[i] = self._whole(text)
                continue
            head = self._head(text) if self.kind == "byte" else b""
            distinct = list(set(words))
            known = dict(zip(distinct, self._known(distinct).tolist(), strict=True))
            at = np.fromiter(map(known.get, words), np.int64, len(words))
            out[i] = head + segments(self.cache.pool, self.cache.start[at], self.cache.size[at]).tobytes()
        return out

    def _safe(self, text: str) -> bool:
        return LITERAL not in text and not any(a in text for a in self.added)

    def _head(self, text: str) -> bytes:
        head = text[: m.start()] if (m := _CUT.search(text)) else text
        ids = self.first.get(head)
        if ids is None:
            ids = self.first[head] = self._whole(head)
        return ids

    def _pieces(self, text: str) -> list[str] | None:
        if not self._safe(text):
            return None
        if self.kind == "word":
            return None if _CONTROL.search(text) else text.split()
        return (_CUT.split(text) if _ODD_SPACE.search(text) else text.split(" "))[1:]  # what is before goes to ``_head``

    def _learn(self, words: list[str]) -> np.ndarray:
        """Their numbers in the cache."""
        found = np.empty(len(words), np.int64)
        for at in range(0, len(words), 8192):
            some = words[at : at + 8192]
            parts = pc.extract_regex(pa.array(some, pa.string()), self.plain)
            plain = parts.is_valid().to_numpy(zero_copy_only=False)
            number = np.empty(len(some), np.int64)
            if plain.any():
                number[plain] = self._learn_plain([some[i] for i in np.flatnonzero(plain).tolist()], parts.filter(parts.is_valid()))
            if not plain.all():
                odd = [some[i] for i in np.flatnonzero(~plain).tolist()]
                ids = (self._learn_byte if self.kind == "byte" else self._learn_word)(odd)
                size = np.fromiter(map(len, ids), np.int64, len(ids))
                number[~plain] = self.cache.add(odd, np.concatenate(ids), np.cumsum(size) - size, size)
            found[at : at + 8192] = number
        return found

    def _learn_plain(self, words: list[str], parts: pa.StructArray) -> np.ndarray:
        """Learn words of Latin letters, with ASCII punctuation after them or not."""
        lead, stem, tail = (parts.field(c) for c in ("lead", "stem", "tail"))
        led = pc.not_equal(lead, "")
        stems = pc.if_else(led, pc.binary_join_element_wise(LITERAL, stem, ""), stem).dictionary_encode()
        names = stems.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = self.cache.find(names)
        for lone in (False, True):
            new = [i for i in np.flatnonzero(at < 0).tolist() if (names[i][0] == LITERAL) == lone]
            if new:
                ids, size = self._bare([names[i] for i in new], lone)
                at[new] = self.cache.add([names[i] for i in new], ids, np.cumsum(size) - size, size)
        tails = tail.dictionary_encode()
        ends = [self._tail(t) for t in tails.dictionary.to_pylist()]
        line_end = pc.equal(lead, "\n").to_numpy(zero_copy_only=False)
        at = at[stems.indices.to_numpy()]
        number = at.copy()
        more = np.flatnonzero(line_end | led.to_numpy(zero_copy_only=False) | pc.not_equal(tail, "").to_numpy(zero_copy_only=False))
        if len(more):
            # their ids are three parts of one array: a line end or nothing, the stem's, the tail's
            extra = np.concatenate([self.line_end, *ends])
            sizes = np.array([len(e) for e in ends])
            base = np.array([self.cache.used, *(self.cache.used + len(self.line_end) + np.cumsum(sizes) - sizes)])
            which = tails.indices.to_numpy()[more]
            start = np.stack([np.full(len(more), base[0]), self.cache.start[at[more]], base[1:][which]], axis=1).ravel()
            size = np.stack([np.where(line_end[more], len(self.line_end), 0), self.cache.size[at[more]], sizes[which]], axis=1)
            ids = segments(np.concatenate([self.cache.pool[: self.cache.used], extra]), start, size.ravel())
            total = size.sum(axis=1)
            todo = [words[i] for i in more.tolist()]
            fresh = np.array([w not in self.cache.index for w in todo])  # a literal alone is its own stem
            number[more[fresh]] = self.cache.add([w for w, f in zip(todo, fresh.tolist(), strict=True) if f], ids, (np.cumsum(total) - total)[fresh], total[fresh])
        return number

    def _tail(self, text: str) -> np.ndarray:
        if text not in self.tail:
            self.tail[text] = self._ids(text)
        return self.tail[text]

    def _bare(self, stems: list[str], lone: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of Latin letters, one after the other, and how many each has; ``lone``: no space leads them."""
        text = " ".join(stems)
        text = (text.lower() if self.kind == "word" else text).encode().decode("latin-1").translate(self.alphabet)
        if lone:
            text = text.replace(self.alphabet[2], "").replace(" ", " Ġ ")
        elif self.kind == "byte":
            text = "Ġ" + text.replace(" ", " Ġ")
        ids = np.array(self._fast(self.bare, [text])[0], self.dtype)
        if lone:
            gap = ids == self.space
            return ids[~gap], np.diff(np.flatnonzero(gap), prepend=-1, append=len(ids)) - 1
        if self.kind == "byte":  # a word begins, or ends, where the vocabulary says so
            return ids, np.diff(np.flatnonzero(self.opens[ids]), append=len(ids))
        return ids, np.diff(np.flatnonzero(self.closes[ids]), prepend=-1)

    @staticmethod
    def _fast(tokenizer, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self._fast(self.full, [text])[0], self.dtype)

    def _learn_byte(self, words: list[str]) -> list[np.ndarray]:
        """A piece begins with its space, and only there does one of its tokens begin with a space, unless it holds more."""
        found: dict[str, np.ndarray] = {}
        plain = [w for w in words if " " not in w and w[:1] not in (LITERAL, "\n")]
        if plain:
            ids = self._ids(" " + " ".join(plain))
            at = np.flatnonzero(self.opens[ids])
            if len(at) == len(plain):
                found = dict(zip(plain, np.split(ids, at[1:]), strict=True))
        rest = [w for w in words if w not in found]
        texts = [w.removeprefix(LITERAL) if w[:1] in (LITERAL, "\n") else " " + w for w in rest]
        found.update(zip(rest, (np.array(x, self.dtype) for x in self._fast(self.full, texts)), strict=True))
        return [found[w] for w in words]

    def _learn_word(self, words: list[str]) -> list[np.ndarray]:
        ids = self._ids(" \x01 ".join(words))
        at = np.flatnonzero(ids == self.mark[0])
        if len(self.mark) == 1 and len(at) == len(words) - 1:
            parts = np.split(ids, at)
            return [parts[0], *(x[1:] for x in parts[1:])]
        return [self._ids(w) for w in words]


def encoder(path: str) -> WordEncoder:
    """One encoder a worker process and file, held while tasks of this kind run there."""
    return worker_cache("wordbpe", path, lambda: WordEncoder(path))
