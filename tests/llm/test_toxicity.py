import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from caretrail.llm import common
from caretrail.llm import toxicity as t
from caretrail.llm.queries import op10_toxicity


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = op10_toxicity(spark, sf_dir).select("doc_id", "held_out", "score", "predicted").collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == held_out(r.doc_id) for r in rows)
    test = [(labels[r.doc_id], r.score) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    pos, neg = [s for y, s in test if y], [s for y, s in test if not y]
    auc = np.mean([[(p > n) + 0.5 * (p == n) for n in neg] for p in pos])
    assert auc > 0.85
    assert np.mean([s >= 0.5 for s in neg]) < 0.02 and np.mean([s >= 0.5 for s in pos]) > 0.6
    assert abs(np.mean([s for _, s in test]) - len(pos) / len(test)) < 0.05  # calibrated


def plain(texts, ids, toxic, idf, totals, query, k=t.NEIGHBOURS):
    """Score and neighbours (id, cosine) by a full comparison, from the definition."""
    def vector(text):
        counts = Counter(w for w in re.findall(r"[^\W\d_]+", (text or "").lower()) if w in idf)
        x = {w: (1 + math.log(n)) * idf[w] for w, n in counts.items()}
        length = math.sqrt(sum(v * v for v in x.values()))
        return {w: v / length for w, v in x.items()}

    vectors = [vector(x) for x in texts]
    m = [max(1, toxic.count(0)), max(1, toxic.count(1))]
    phi = {}
    for w in idf:
        r = [sum(w in v for v, y in zip(vectors, toxic, strict=True) if y == c) for c in (0, 1)]
        a, n = r[0] + r[1], m[0] + m[1]
        phi[w] = abs(r[1] * (m[0] - r[0]) - r[0] * (m[1] - r[1])) / math.sqrt(max(1e-9, a * (n - a) * m[0] * m[1]))
    per = [totals[0] / m[0], totals[1] / m[1]]
    q = vector(query)
    near = []
    for i, y, text, v in zip(ids, toxic, texts, vectors, strict=True):
        cos = round(sum(x * v.get(w, 0) for w, x in q.items()), 12)
        if cos > 0 and text != query:
            near.append((-cos, i, sum(x * v.get(w, 0) * phi[w] for w, x in q.items()) ** 2 * per[y], y))
    near = sorted(near)[:k]
    return [(i, -c) for c, i, _, _ in near], [(w, y) for _, _, w, y in near], totals[1] / sum(totals.values())


EVERYWHERE = ["aaa", "aab", "aac", "aad", "aae", "aaf"]


def made_up(n, seed=3):
    """Texts of four kinds with words of their own, and a few words that all have."""
    rng = random.Random(seed)
    common = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(8)]
    return [" ".join(rng.choices(common[(i % 4) * 12:(i % 4) * 12 + 12], k=rng.randint(1, 30)) + ["vile"] * (i % 5 == 0) + EVERYWHERE)
            for i in range(n)]


def test_scores_against_brute_force():
    """Every neighbour, cosine and score by the definition, with blocks skipped on the way."""
    texts = made_up(700)
    texts[9] = texts[5]
    ids, toxic = list(range(0, 1400, 2)), [int(i % 5 == 0) for i in range(700)]
    words = sorted({w for x in texts for w in t.words_of(x)})
    idf = {w: 1 + i / 10 for i, w in enumerate(words)}
    totals = {0: 3000, 1: 400}
    model = t.model_of(ids, toxic, texts, {w: i for i, w in enumerate(words)}, np.array([idf[w] for w in words]), totals)
    assert model.blocks == 11 and (np.diff(model.starts, axis=1) >= 0).all()
    for query in [*texts[:60], *made_up(40, 8), "vile", "waa waa unknown"]:
        near, votes, base = plain(texts, ids, toxic, idf, totals, query)
        at, cos, _ = model.nearest(query)
        assert [i for i, _ in near] == model.ids[at].tolist()
        assert np.allclose(cos, [c for _, c in near])
        total = sum(w for w, _ in votes) + model.scale
        assert total > 0 or query == "waa waa unknown"
        if near:
            want = (sum(w * y for w, y in votes) + model.scale * base) / total
            assert abs(model.score(query)[0] - want) < 1e-9
    assert model.read[0] < 0.8 * model.read[1], "blocks that can't hold a neighbour aren't read"
    assert model.score("unknown") == (model.bare, [])


def test_an_example_does_not_vote_on_itself(spark):
    docs = [(i, f"one two three four{chr(97 + i)}") for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(12)], "doc_id long, toxic int")
    rows = {r.doc_id: r for r in t.toxicity(df, labels).collect()}
    assert all(e.doc_id != i for i, r in rows.items() for e in r.evidence)


def test_edges(spark):
    docs = [(i, f"{'vile rude' if i % 3 == 0 else 'kind nice'} text{i % 7}") for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, "x " * 30_000 + "vile"), (None, "rude vile"), (1003, "vile"), (1003, "vile")]
    df = spark.createDataFrame([(*d, 0.5, "x") for d in docs], "doc_id long, text string, score double, toxic string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(1, None), (None, 1), (0, 0)],
                                   "doc_id long, toxic int")
    rows = t.toxicity(df, labels).collect()
    assert len(rows) == len(docs)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[None].predicted == 1 and by_id[1003].predicted == 1 and by_id[4].predicted == 0
    assert by_id[1000].score == by_id[1001].score and by_id[3].evidence[0].cosine > 0.4
    assert by_id[None].held_out is False
    assert all(not held_out(e.doc_id) for r in rows for e in r.evidence)
    assert {r.score for r in t.toxicity(df, labels.limit(0)).collect()} == {0.0}
    assert t.toxicity(df.limit(0), labels).count() == 0


def test_every_word_of_the_examples_counts(spark):
    """Neighbours and cosines of all words by brute force, with few labelled examples and words that tell nothing."""
    docs = [(i, f"word{'abcdefgh'[i % 8]}x {'grim' if i % 4 == 0 else 'calm'} rare{chr(97 + i)}z") for i in range(24)]
    docs += [(100, "rarebz"), (101, "rareez unheard"), (102, "unheard"), (103, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(24)], "doc_id long, toxic int")
    model = t.fit(df, labels)
    train = [(i, x) for i, x in docs if i < 24 and not held_out(i)]
    assert set(model.vocabulary) == {w for _, x in train for w in t.words_of(x)}
    counts = Counter(w for _, x in docs for w in set(t.words_of(x)))
    idf = {w: math.log((len(docs) + 1) / (counts[w] + 1)) + 1 for w in model.vocabulary}
    toxic = [int(i % 4 == 0) for i, _ in train]
    totals = {c: toxic.count(c) for c in (0, 1)}
    rows = {r.doc_id: r for r in t.scored(df, model).collect()}
    for i, text in docs:
        near, votes, base = plain([x for _, x in train], [j for j, _ in train], toxic, idf, totals, text)
        assert [(e.doc_id, e.cosine) for e in rows[i].evidence] == [(j, round(c, 6)) for j, c in near[:3]]
        if near:
            total = sum(w for w, _ in votes) + model.scale
            want = (sum(w * y for w, y in votes) + model.scale * base) / total if total else base
            assert abs(rows[i].score - want) < 1e-9
    assert rows[102].evidence == [] and rows[101].evidence


def rare_worded(n):
    """Texts with common words and words that few or no others have."""
    def letters(i):
        return "".join(chr(97 + int(d)) for d in str(i))
    return [f"{x} pair{letters(i // 2)} " + " ".join(f"own{letters(10 * i + j)}" for j in range(20)) for i, x in enumerate(made_up(n))]


def test_the_index_is_no_larger_than_its_postings():
    """A row a word and a column a block made it many times as large; rare words are read whole, with the same scores."""
    texts = rare_worded(200)
    toxic = [int(i % 5 == 0) for i in range(200)]
    words = sorted({w for x in texts for w in t.words_of(x)})
    idf = {w: 1 + i / 10_000 for i, w in enumerate(words)}
    totals = {0: 3000, 1: 400}
    model = t.model_of(list(range(200)), toxic, texts, {w: i for i, w in enumerate(words)}, np.array(list(idf.values())), totals)
    assert model.blocks == 4 and len(words) > 2000
    assert 0 < len(model.block_max) and model.starts.size + model.block_max.size < len(model.term)
    for query in [*texts[:20], *made_up(10, 8), *rare_worded(30)[20:], "owna", "paira owna vile"]:
        near, votes, base = plain(texts, range(200), toxic, idf, totals, query)
        at, cos, _ = model.nearest(query)
        assert [i for i, _ in near] == model.ids[at].tolist() and np.allclose(cos, [c for _, c in near])
        total = sum(w for w, _ in votes) + model.scale
        assert abs(model.score(query)[0] - (sum(w * y for w, y in votes) + model.scale * base) / total) < 1e-9


def test_texts_are_scored_piece_by_piece(monkeypatch):
    texts = made_up(80)
    toxic = [int(i % 5 == 0) for i in range(80)]
    words = sorted({w for x in texts for w in t.words_of(x)})
    model = t.model_of(list(range(80)), toxic, texts, {w: i for i, w in enumerate(words)}, np.ones(len(words)), {0: 64, 1: 16})
    given = [*texts, None, "", *texts[:30]]
    want, asked, score = [model.score(x) for x in given], [], t.Model.score
    monkeypatch.setattr(common, "PIECE", 500)
    monkeypatch.setattr(t.Model, "score", lambda self, x: asked.append(x) or score(self, x))
    got = t._scores(model)(pa.array(given, pa.string())).to_pylist()
    assert [(r["score"], [(e["doc_id"], e["cosine"]) for e in r["evidence"]]) for r in got] == want
    assert len(asked) == len({x or "" for x in given}), "copies are scored once, in whatever piece"
    assert t._scores(model)(pa.array([], pa.string())).to_pylist() == []
