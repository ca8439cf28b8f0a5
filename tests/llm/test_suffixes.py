import hashlib
import random

import numpy as np
import pytest

from caretrail.llm import suffixes as m
from caretrail.llm.queries import op8_suffix_dedup


def brute(docs):
    """By (doc_id, text) in order: bytes, removed, spans, sha of the rest."""
    seen, out = set(), []
    for i, text in sorted(docs, key=lambda d: -1 if d[0] is None else d[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - m.LENGTH + 1):
            w = data[p:p + m.LENGTH]
            if w in seen:
                gone[p:p + m.LENGTH] = b"\1" * m.LENGTH
            seen.add(w)
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_whole_table(spark, sf_dir, texts):
    got = sorted(map(tuple, op8_suffix_dedup(spark, sf_dir).collect()), key=repr)
    want = brute(texts.items())
    assert got == want and sum(r[2] for r in want) > 1000


def edge_docs():
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("abcdefgh é🙂") for _ in range(n))
    passage, exact = letters(400), letters(90) + "0123456789"
    docs = [(1, None), (2, ""), (3, "x" * 99), (4, "y" * 100), (5, "y" * 100), (6, "z" * 30_000), (7, "ab" * 300),
            (8, letters(50) + passage + letters(50)), (9, letters(10) + passage[100:300] + letters(30)), (None, letters(300)),
            (10, passage), (11, passage), (12, passage[:60] + letters(40)), (13, letters(5) + exact), (14, exact + letters(5))]
    docs += [(50 + i, letters(rng.randint(0, 80)) + passage[rng.randint(0, 100):rng.randint(250, 400)] + letters(60))
             for i in range(40)]
    docs += [(100, "\x00" * 150 + "a" * 120), (101, "q" + "\x00" * 120), (102, (letters(130) + "|") * 3)]
    return docs


@pytest.mark.parametrize("crowd, shard", [(4000, 4_000_000), (3, 2000)])
def test_edges_against_brute_force(spark, monkeypatch, crowd, shard):
    monkeypatch.setattr(m, "CROWD", crowd)
    monkeypatch.setattr(m, "SHARD", shard)
    docs = edge_docs()
    df = spark.createDataFrame([(*d, b"x", 1) for d in docs], "doc_id long, text string, kept binary, start int")
    assert sorted(map(tuple, m.digests(df).collect()), key=repr) == brute(docs)


def test_repeated_rows_and_empty_table(spark):
    text = "some text of more than a hundred bytes " * 4
    df = spark.createDataFrame([(1, text), (1, text), (2, "short")], "doc_id long, text string")
    rows = m.without_repeated_bytes(df).collect()
    assert len(rows) == 3 and len({r.n_removed for r in rows if r.doc_id == 1}) == 1
    once = " ".join(map(str, range(100)))
    for parts in (1, 6):
        df = spark.createDataFrame([(1, once), (1, once), (1, once), (2, once), (2, once)], "doc_id long, text string")
        rows = m.without_repeated_bytes(df.repartition(parts)).collect()
        assert sorted((r.doc_id, r.n_removed) for r in rows) == [(1, 0)] * 3 + [(2, len(once))] * 2
    both = [(1, once), (2, "x" + once[50:200] + "y"), (2, "x" + once[50:200] + "y")]
    rows = m.without_repeated_bytes(spark.createDataFrame(both, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(1, 0), (2, 150), (2, 150)]
    assert m.without_repeated_bytes(df.limit(0)).count() == 0


def test_suffix_array_and_prefixes():
    rng = random.Random(3)
    for n, letters in ((1, "a"), (300, "a"), (2000, "ab"), (3000, "abcdefgh")):
        raw = bytes(rng.choice(letters.encode()) for _ in range(n))
        raw += raw[: n // 2]
        text = np.frombuffer(raw, np.uint8)
        order = m.suffix_array(text)
        heads = [raw[i:i + m.LENGTH] for i in order.tolist()]
        assert heads == sorted(heads) and sorted(order.tolist()) == list(range(len(raw)))
        shared = m.common_prefixes(text, order, np.array([0]), np.array([len(raw)]))
        for k in range(1, len(order)):
            a, b = heads[k - 1], heads[k]
            want = next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert shared[k] == want
