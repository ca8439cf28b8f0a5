"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The model is a set of at most ``EXAMPLES`` labelled documents of each class (those with the smallest hashes of the id, of
at most ``EXAMPLE_BYTES`` each; a documented bound on labelled rows, so the driver may gather it and it can be broadcast),
as TF-IDF vectors over all their words; inverse document frequencies are counted over all documents. Examples are put in
an order in which alike ones are neighbours and cut into blocks of ``BLOCK``. For every word of more examples than there
are blocks the index has the largest weight in each block; the postings of rarer words, most of the vocabulary, are all
read, so the index is no larger than the postings. So the largest cosine a block can hold is known before its other
postings are read: a few blocks of the highest bounds are read first, and then only those whose bound reaches the cosine of
the last neighbour so far. The neighbours are those of the full cosine over all examples.

A neighbour's vote is the square of the part of its cosine that comes from words which tell labels apart (each word
weighted by its association, the phi coefficient among the examples), times what an example stands for in the whole
label table. Votes are shrunk to the base rate, so a score is a calibrated probability; the neighbours are the evidence.
A score depends on the text alone. Examples of the very same text don't vote: a labelled row would else be its own
neighbour, and its score its label.

Defined results: a text without any known word (a null or empty one too) has the rate of such examples; without labels all
scores are 0; a row without id isn't held out. Labels of one document that differ count as the highest. Rows that repeat
are scored each.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretrail.llm.common import pieces, ship

EXAMPLES = 1500
EXAMPLE_BYTES = 1 << 16
NEIGHBOURS = 15
BLOCK = 64  # examples
FIRST = 3  # blocks read before any is skipped
SEEDS = 24  # examples that the others are arranged around
SHRINK = 0.5
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if isinstance(text, str) else []


def same(text: str | None) -> bytes:
    return hashlib.blake2b((text or "").encode(), digest_size=16).digest()


@dataclass
class Model:
    """Examples in the order of the index. ``term``, ``example``, ``weight`` are the postings, by term and example."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    phi: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    stands_for: np.ndarray
    texts: dict[bytes, list[int]]  # of which examples a text is
    term: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    base: float  # rate among all labelled documents
    bare: float  # rate among examples without words
    scale: float = 0.0  # weight of the base rate among the votes
    read: list[int] = field(default_factory=lambda: [0, 0])  # postings read, postings there, of all queries

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if k not in ("ends", "row", "starts", "block_max", "by_example", "_dense")}

    @property
    def blocks(self) -> int:
        return -(-len(self.ids) // BLOCK)

    @cached_property
    def ends(self) -> np.ndarray:
        """Where the postings of each term start, and the end of the last."""
        return np.searchsorted(self.term, np.arange(len(self.idf) + 1))

    @cached_property
    def row(self) -> np.ndarray:
        """The row of each common term in ``starts`` and ``block_max``; -1 for terms in no more examples than blocks."""
        common = np.diff(self.ends) > self.blocks
        return np.where(common, np.cumsum(common) - 1, -1)

    @cached_property
    def starts(self) -> np.ndarray:
        """Where the postings of each common term in each block start; one more column for the ends."""
        key = self.term * np.int64(self.blocks) + self.example // BLOCK
        grid = np.flatnonzero(self.row >= 0)[:, None] * self.blocks + np.arange(self.blocks + 1)
        return np.searchsorted(key, grid).astype(np.int32)

    @cached_property
    def block_max(self) -> np.ndarray:
        """The largest weight of each common term in each block, rounded up."""
        row = self.row[self.term]
        at = np.flatnonzero(row >= 0)
        out = np.zeros((int(self.row.max(initial=-1)) + 1, max(1, self.blocks)), np.float32)
        np.maximum.at(out, (row[at], self.example[at] // BLOCK),
                      np.nextafter(self.weight[at].astype(np.float32), np.float32(2)))
        return out

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Known terms of a text and their weights in a vector of length 1."""
        words = words_of(text)
        codes = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        terms, n = np.unique(codes[codes >= 0], return_counts=True)
        x = (1 + np.log(n)) * self.idf[terms]
        return terms, x / np.sqrt(x @ x) if len(x) else x

    def _cosines(self, starts: np.ndarray, x: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """What common terms add to the cosines with all examples of ``blocks``; ``starts`` are those of these terms.

        Blocks next to each other are read in one go.
        """
        if not len(blocks):
            return np.zeros(len(self.ids))
        blocks = np.sort(blocks)
        gaps = np.flatnonzero(np.diff(blocks) > 1)
        low = starts[:, blocks[np.concatenate([[0], gaps + 1])]].ravel()
        high = starts[:, blocks[np.concatenate([gaps, [-1]])] + 1].ravel()
        return self._products(low, high, np.repeat(x, len(gaps) + 1))

    def _products(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """For all examples, the sums over the postings from each ``low`` to its ``high`` of the weights times ``x``."""
        n = high - low
        ends = np.cumsum(n, dtype=np.int64)
        if not len(ends):
            return np.zeros(len(self.ids))
        self.read[0] += int(ends[-1])
        at = np.repeat(low - (ends - n), n)
        at += np.arange(len(at))
        product = np.repeat(x, n)
        product *= self.weight[at]
        return np.bincount(self.example[at], product, len(self.ids))

    @cached_property
    def by_example(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms and telling weights of the examples, one after the other, and where each starts."""
        order = np.argsort(self.example, kind="stable")
        term = self.term[order]
        return term, self.weight[order] * self.phi[term], np.searchsorted(self.example[order], np.arange(len(self.ids) + 1))

    def telling(self, terms: np.ndarray, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The part of the cosines with the examples ``at`` that comes from telling words."""
        term, weight, starts = self.by_example
        n = starts[at + 1] - starts[at]
        ends = np.cumsum(n)
        entry = np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1])
        query = self._dense
        query[terms] = x
        out = np.add.reduceat(query[term[entry]] * weight[entry], ends - n)
        query[terms] = 0
        return out

    @cached_property
    def _dense(self) -> np.ndarray:
        return np.zeros(len(self.idf))

    def nearest(self, text: str | None, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k examples of highest cosine (ties: the smaller id), their cosines and the telling parts of these."""
        terms, x = self.vector(text)
        if not len(terms):
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        self.read[1] += int((self.ends[terms + 1] - self.ends[terms]).sum())
        row = self.row[terms]
        is_common = row >= 0
        rare, common, row = terms[~is_common], x[is_common], row[is_common]
        cos = self._products(self.ends[rare], self.ends[rare + 1], x[~is_common])
        bounds, starts = common @ self.block_max[row], self.starts[row]
        bounds += np.maximum.reduceat(cos, np.arange(0, len(cos), BLOCK))
        order = np.argsort(-bounds, kind="stable")
        own = self.texts.get(same(text), [])
        cos += self._cosines(starts, common, order[:FIRST])
        cos[own] = 0
        least = np.partition(cos, len(cos) - k)[len(cos) - k] if len(cos) >= k else 0.0
        rest = order[FIRST:]
        rest = rest[(bounds[rest] >= least - 1e-9) & (bounds[rest] > 0)]
        if len(rest):
            cos += self._cosines(starts, common, rest)
            cos[own] = 0
        least = np.partition(cos, len(cos) - k)[len(cos) - k] if len(cos) > k else 0.0
        at = np.flatnonzero((cos > 0) & (cos >= least - 1e-11))
        near = np.round(cos[at], 12)
        best = np.lexsort((self.ids[at], -near))[:k]
        at, near = at[best], near[best]
        return at, near, self.telling(terms, x, at) if len(at) else near

    def score(self, text: str | None) -> tuple[float, list[tuple[int, float]]]:
        """Score and evidence of a text."""
        at, cos, part = self.nearest(text)
        if not len(at):
            return self.bare, []
        votes = part ** 2 * self.stands_for[at]
        total = votes.sum() + self.scale
        score = (votes @ self.toxic[at] + self.scale * self.base) / total if total > 0 else self.base
        return float(score), [(int(i), round(float(c), 6)) for i, c in zip(self.ids[at[:3]], cos[:3], strict=True)]


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string")) % 5 == 0


def _term_counts(batches: Iterator[pd.DataFrame], vocabulary: dict[str, int]) -> Iterator[pd.DataFrame]:
    total = np.zeros(len(vocabulary), np.int64)
    for batch in batches:
        for text, n in Counter(batch["text"]).items():  # copies are split into words once
            words = set(words_of(text))
            codes = np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int64, len(words))
            total[codes[codes >= 0]] += n
    terms = np.flatnonzero(total)
    yield pd.DataFrame({"term": terms, "n": total[terms]})


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Model:
    """Learns from labels of documents outside the held-out fifth; the driver gets the examples, and a count a word."""
    ship(docs.sparkSession)
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(
        (F.max("toxic") > 0).cast("int").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    fit_docs = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= EXAMPLE_BYTES).select("doc_id")
    usable = usable.join(fit_docs, "doc_id", "left_semi")
    chosen = [usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples) for y in (0, 1)]
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(
        F.coalesce(F.octet_length("text"), F.lit(0)) <= EXAMPLE_BYTES).join(
        F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = sample.toArrow().sort_by("doc_id")
    ids, toxic, texts = (rows[c].to_pylist() for c in ("doc_id", "toxic", "text"))
    vocabulary = {w: i for i, w in enumerate(sorted({w for t in texts for w in words_of(t)}))}
    df, n_docs = np.zeros(len(vocabulary)), 0
    if vocabulary:
        shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
        counted = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(
            lambda it: _term_counts(it, shared.value), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        df[counted["term"].to_numpy()] = counted["n"].to_numpy()
        n_docs = docs.count()
        shared.destroy()
    return model_of(ids, toxic, texts, vocabulary, np.log((n_docs + 1) / (df + 1)) + 1, totals)


def model_of(ids: list[int], toxic: list[int], texts: list[str | None], vocabulary: dict[str, int], idf: np.ndarray,
             totals: dict[int, int]) -> Model:
    """The model of the examples; ``totals`` are the labelled documents of each class that they stand for."""
    y = np.array(toxic, np.int64)
    per = np.array([totals.get(c, 0) / max(1, (y == c).sum()) for c in (0, 1)])
    base = totals.get(1, 0) / max(1, sum(totals.values()))
    none = np.zeros(0)
    model = Model(vocabulary, idf, np.zeros(len(idf)), none, none, none, {}, none, none, none, base, base)
    vectors = [model.vector(t) for t in texts]
    used = np.array([i for i, (t, _) in enumerate(vectors) if len(t)], np.int64)
    bare = y[[i for i, (t, _) in enumerate(vectors) if not len(t)]]
    if len(bare):
        model.bare = float(per[1] * bare.sum() / max(per[bare].sum(), 1e-12))
    order = used[arranged([vectors[i] for i in used], len(idf))]
    model.ids = np.array(ids, np.int64)[order] if len(order) else np.zeros(0, np.int64)
    model.toxic, model.stands_for = y[order].astype(float), per[y[order]]
    for place, i in enumerate(order.tolist()):
        model.texts.setdefault(same(texts[i]), []).append(place)
    at = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
    term = np.concatenate([np.zeros(0, np.int64), *(vectors[i][0] for i in order)])
    x = np.concatenate([none, *(vectors[i][1] for i in order)])
    by_term = np.lexsort((at, term))
    model.term, model.example, model.weight = term[by_term], at[by_term].astype(np.int64), x[by_term]
    model.phi = association(term, y[order][at] if len(order) else y[:0], len(idf), y)
    if len(order):
        every = np.arange(len(order))
        parts = [model.telling(*vectors[i], every) for i in order[::max(1, len(order) // 200)]]
        parts = np.concatenate(parts)
        usual = np.median(parts[parts > 0]) if (parts > 0).any() else 0.0
        model.scale = float(SHRINK * model.stands_for.mean() * usual ** 2)
        model.read = [0, 0]
    return model


def arranged(vectors: list[tuple[np.ndarray, np.ndarray]], terms: int) -> np.ndarray:
    """An order of the vectors in which alike ones are neighbours: by the seed they are nearest to, and by how near."""
    if not vectors:
        return np.zeros(0, np.int64)
    seeds = np.zeros((terms, min(SEEDS, len(vectors))), np.float32)
    for j in range(seeds.shape[1]):
        t, x = vectors[j * len(vectors) // seeds.shape[1]]
        seeds[t, j] = x
    near = np.stack([x @ seeds[t] for t, x in vectors])
    return np.lexsort((-near.max(1), near.argmax(1)))


def association(term: np.ndarray, toxic: np.ndarray, terms: int, labels: np.ndarray) -> np.ndarray:
    """Phi coefficient, without its sign, of each term and the label: from 0 (none) to 1, at any number of examples."""
    r = [np.bincount(term[toxic == y], minlength=terms).astype(float) for y in (0, 1)]
    m = [max(1, int((labels == y).sum())) for y in (0, 1)]
    n = m[0] + m[1]
    with_term = r[0] + r[1]
    return np.abs(r[1] * (m[0] - r[0]) - r[0] * (m[1] - r[1])) / np.sqrt(
        np.maximum(1e-9, with_term * (n - with_term) * m[0] * m[1]))


def _scores(model: Model):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())]))

    def work(batch: pa.Array) -> pa.Array:
        done: dict[bytes, tuple] = {}  # copies are scored once
        out = []
        for piece in pieces(batch, batch):
            texts = piece.to_pylist()
            keys = list(map(same, texts))
            for key, text in dict(zip(keys, texts, strict=True)).items():
                if key not in done:
                    done[key] = model.score(text)
            evidence = [[{"doc_id": i, "cosine": c} for i, c in done[key][1]] for key in keys]
            out.append(pa.StructArray.from_arrays(
                [pa.array([done[key][0] for key in keys], pa.float64()), pa.array(evidence, kind)], ["score", "evidence"]))
        return pa.concat_arrays(out)

    return work


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, score and evidence (nearest examples with their cosines) of every row.

    Python gets the texts alone and returns the scores alone, so wide rows cost no more than their texts.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        yield from map(_scores(shared.value), batches)

    kind = "score double, evidence array<struct<doc_id:bigint,cosine:double>>"
    # Not taken as deterministic: a filter on the score, moved below the columns, would score every text once more.
    score = F.arrow_udf(run, kind, F.ArrowUDFType.SCALAR_ITER).asNondeterministic()
    return docs.select(*keep, score(F.col(text).cast("string")).alias("_scored")).select(
        *keep, "_scored.score", "_scored.evidence")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence of every row."""
    return scored(docs, fit(docs, labels)).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
