"""BPE encoding and decoding with a public word-end vocabulary, by a pair occurrence index.

The distinct words of a batch are laid out as one array of symbols with links to neighbours. An index maps each ranked
pair to all its positions; ranks are taken in ascending order, a rank is applied at all its positions at once, and the
pairs that this makes go into the lists of their ranks. Words known from earlier batches of the partition are looked up
in a cache of bounded size: one array of ids for all words, and what a word contributes to the texts of ids and tokens.
Encoding and decoding are one map over the rows, so a task holds one vocabulary.

Defined results: null and empty texts have no tokens and decode to ''; rows that repeat are encoded each; the special
tokens' own texts become those tokens, as the tokenizers library does by default. The vocabulary file must be readable
under its path on every executor, as an installed package is.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretrail.llm.common import map_texts

WORD_END = "</w>"
CACHE_BYTES = 48 << 20  # what a partition remembers of words before it starts afresh, about
CHUNK = 1 << 20  # characters of text worked on at once, if no single text is longer
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def byte_letters() -> list[str]:
    """The letter that stands for each byte in such vocabularies: printable ones for themselves, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        self.tokens: list[str] = [""] * (1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in ids.items():
            self.tokens[i] = token
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.specials.items():
            self.tokens[i] = token
        self.special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        letters = byte_letters()
        self.inside = np.array([ids[c] for c in letters], np.int64)
        self.last = np.array([ids[c + WORD_END] for c in letters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], np.int64)
        self.right = np.array([ids[b] for _, b in merges], np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        keys = self.left << 32 | self.right
        self.by_key = np.argsort(keys, kind="stable")
        self.keys = keys[self.by_key]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for pairs that never merge."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.by_key[at], -1)

    def words(self, text: str) -> list[str]:
        """Normalised words of a text; special tokens stand as themselves."""
        if self.special and "<|" in text:
            out = []
            for part in self.special.split(text):
                out += [part] if part in self.specials else self._plain(part)
            return out
        return self._plain(text)

    @staticmethod
    def _plain(text: str) -> list[str]:
        if text.isascii():
            return _ASCII_WORD.findall(text.lower())
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return _WORD.findall(text.replace("Σ", "σ").lower())  # no special sigma at word ends

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word (none empty, no special tokens)."""
        if not words:
            return []
        encoded = [w.encode() for w in words]
        raw = np.frombuffer(b"".join(encoded), np.uint8)
        ends = np.cumsum([len(e) for e in encoded]) - 1
        sym = self.inside[raw]
        sym[ends] = self.last[raw[ends]]
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends] = -1
        before[0] = -1
        before[ends[:-1] + 1] = -1
        alive = np.ones(n, bool)
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            rank = self.ranks(sym[at], sym[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.r_[0, cuts]].tolist(), np.split(at, cuts), strict=True):
                if r not in lists:
                    lists[r] = []
                    heapq.heappush(active, r)
                lists[r].append(part)

        enter(np.flatnonzero(after >= 0))
        while active:
            r = heapq.heappop(active)
            a, b = self.left[r], self.right[r]
            at = np.unique(np.concatenate(lists.pop(r)))
            at = at[alive[at] & (sym[at] == a) & (after[at] >= 0)]
            at = at[sym[after[at]] == b]
            if a == b and len(at) > 1:  # of overlapping pairs the first counts
                taken, used = [], -1
                for p, q in zip(at.tolist(), after[at].tolist(), strict=True):
                    if p != used:
                        taken.append(p)
                        used = q
                at = np.array(taken)
            if not len(at):
                continue
            gone = after[at]
            sym[at] = self.made[r]
            alive[gone] = False
            beyond = after[gone]
            after[at] = beyond
            before[beyond[beyond >= 0]] = at[beyond >= 0]
            enter(np.unique(np.r_[before[at][before[at] >= 0], at[beyond >= 0]]))
        ids = sym[alive].astype(np.int32)
        sizes = np.add.reduceat(alive, np.r_[0, ends[:-1] + 1])
        return np.split(ids, np.cumsum(sizes)[:-1])


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class WordCache:
    """Codes of words, and for each code its ids, and their texts as decimal numbers and as tokens."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.clear()

    def clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.flat, self.ends, self.n_ids = np.zeros(1 << 12, np.int32), np.zeros(1 << 10, np.int64), 0
        self.numbers: list[str] = []
        self.tokens: list[str] = []
        self.size = 0

    def learn(self, words: list[str]) -> None:
        """Add words that have no code yet, each once."""
        made = iter(self.vocab.encode_words([w for w in words if w not in self.vocab.specials]))
        for w in words:
            ids = np.array([self.vocab.specials[w]], np.int32) if w in self.vocab.specials else next(made)
            code, end = len(self.codes), self.n_ids + len(ids)
            if end > len(self.flat):
                self.flat = np.r_[self.flat, np.zeros(max(len(self.flat), len(ids)), np.int32)]
            if code + 2 > len(self.ends):
                self.ends = np.r_[self.ends, np.zeros(len(self.ends), np.int64)]
            self.flat[self.n_ids:end] = ids
            self.ends[code + 1] = self.n_ids = end
            self.codes[w] = code
            self.numbers.append(" ".join(map(str, ids.tolist())))
            self.tokens.append(" ".join([self.vocab.tokens[i] for i in ids.tolist()]))
            self.size += 300 + 4 * len(ids) + len(w) + len(self.numbers[-1]) + len(self.tokens[-1])

    def coded(self, texts: list[str | None]) -> list[list[int]]:
        """The codes of the words of each text."""
        split = [self.vocab.words(t) if t else [] for t in texts]
        self.learn([w for w in dict.fromkeys(w for words in split for w in words) if w not in self.codes])
        return [list(map(self.codes.__getitem__, words)) for words in split]

    def ids(self, codes: list[int]) -> np.ndarray:
        c = np.array(codes, np.int64)
        starts, n = self.ends[c], self.ends[c + 1] - self.ends[c]
        to = np.cumsum(n)
        return self.flat[np.repeat(starts - (to - n), n) + np.arange(to[-1] if len(to) else 0)]


def _chunks(texts: list[str | None]):
    chunk, size = [], 0
    for t in texts:
        if chunk and size + len(t or "") > CHUNK:
            yield chunk
            chunk, size = [], 0
        chunk.append(t)
        size += len(t or "")
    if chunk:
        yield chunk


FIELDS = {"ids": "array<int>", "decoded": "string", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}


def encoder(path: str, fields: tuple[str, ...] = ("ids",)):
    """A function from texts to Arrow arrays of the ``fields``; it remembers the words it has met."""
    import pyarrow as pa

    cache = WordCache(vocabulary(path))
    types = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def work(texts: list[str | None]) -> list[pa.Array]:
        out: dict[str, list] = {f: [] for f in fields}
        for chunk in _chunks(texts):
            if cache.size > CACHE_BYTES:
                cache.clear()
            for codes in cache.coded(chunk):
                tokens = " ".join(map(cache.tokens.__getitem__, codes)) if fields != ("ids",) else ""
                if "ids" in out:
                    out["ids"].append(cache.ids(codes))
                if "n_tokens" in out:
                    c = np.array(codes, np.int64)
                    out["n_tokens"].append(int((cache.ends[c + 1] - cache.ends[c]).sum()))
                if "decoded" in out:
                    out["decoded"].append(tokens)
                if "decoded_sha256" in out:
                    out["decoded_sha256"].append(sha(tokens))
                if "ids_sha256" in out:
                    out["ids_sha256"].append(sha(" ".join(map(cache.numbers.__getitem__, codes))))
        return [pa.array(out[f], types.get(f, pa.string())) for f in fields]

    return work


def encode(docs: DataFrame, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
           fields: tuple[str, ...] = ("ids",)) -> DataFrame:
    """``keep`` columns and ``fields`` (ids: array of int; decoded: the text they stand for) of every row's whole text."""
    path = path or default_vocabulary()
    return map_texts(docs, keep, text, lambda: encoder(path, fields), ", ".join(f"{f} {FIELDS[f]}" for f in fields))


def decode(ids: Column, path: str | None = None) -> Column:
    """The text of ids: this vocabulary names no decoder, so tokens stand with blanks between, word ends included."""
    path = path or default_vocabulary()

    @F.pandas_udf("string")
    def joined(batch: pd.Series) -> pd.Series:
        tokens = vocabulary(path).tokens
        return pd.Series([" ".join([tokens[i] for i in x.tolist()]) if x is not None else "" for x in batch], dtype=str)

    return joined(ids)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return encode(docs, path, fields=("n_tokens", "ids_sha256", "decoded_sha256"))
