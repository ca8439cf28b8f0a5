import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from caretrail.llm import graphs, near
from caretrail.llm.queries import ORACLE_SQL, op2_minhash_near_dedup
from caretrail.llm.shingles import Shingler
from checks.run import compare


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    label = list(range(len(docs)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                label[root(i)] = root(j)
    members = {}
    for i, (d, _) in enumerate(docs):
        members.setdefault(root(i), []).append(d)
    small = {r: min((d for d in m if d is not None), default=None) for r, m in members.items()}
    return sorted(((d, len(sets[i]), small[root(i)], d == small[root(i)]) for i, (d, _) in enumerate(docs)), key=repr)


def test_twin(spark, con, sf_dir):
    name = "op2_minhash_near_dedup"
    ok, said = compare(spark, con, sf_dir, name, op2_minhash_near_dedup, ORACLE_SQL[name])
    assert ok, said


def edge_docs():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    base = [word() for _ in range(120)]
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One  TWO"), (6, "one"), (7, "É x"), (8, "é x"),
            (9, "a b c d e"), (None, "a b c d e"), (None, "no id"), (10, "w " * 30_000), (11, "w w w w w"),
            (12, "twice"), (12, "twice"), (13, "\x00 \x1f y")]
    for i in range(60):  # a crowd around one text, linked and not
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = word()
        docs.append((100 + i, " ".join(w)))
    common = [word() for _ in range(12)]
    docs += [(200 + i, " ".join([*common, *[word() for _ in range(rng.randint(3, 60))]])) for i in range(40)]
    return docs


@pytest.mark.parametrize("rounds, block", [(3, 1024), (0, 7)])
def test_edges_against_brute_force(spark, monkeypatch, rounds, block):
    monkeypatch.setattr(near, "ROUNDS", rounds)
    monkeypatch.setattr(near, "BLOCK", block)
    docs = edge_docs()
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, node int, sketch string")
    got = near.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()
    want = brute(docs)
    if rounds:
        assert sorted(map(tuple, got), key=repr) == [(a, b, c, k if c is not None or a is not None else True) for a, b, c, k in want]
        kept = near.without_near_duplicates(df)
        assert kept.columns == df.columns
        # null ids stand for themselves here: (None, "no id") stays, the other one joins 9
        assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(
            {d for d, _, _, k in want if k and d is not None} | {None}, key=repr)
    else:
        assert {r.doc_id: r.component_id for r in got} == {d: c for d, _, c, _ in want}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near.near_duplicates(df).count() == 0 and near.without_near_duplicates(df).count() == 0


def test_hashes_tell_shingles_apart(texts):
    for t, s in zip(texts.values(), Shingler().sets(list(texts.values())), strict=True):
        assert len(s) == len(shingles(t))


def test_words_that_collide_as_polynomials(spark):
    """Two words of 1,024 letters whose sums over powers of any odd base are equal modulo 2^64 (Thue-Morse)."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    pairs = [(one, two), (one[:64], two[:64]), ("a" * 8, "a" * 9), ("\x00", "\x00\x00"), (one[:128], two[:128])]
    for a, b in pairs:
        x, y = Shingler().sets([a, b])
        assert x[0] != y[0]
    df = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 1}


def test_union_estimate(spark):
    rng = random.Random(1)
    rows, true = [], []
    for _ in range(50):
        a = {rng.getrandbits(62) for _ in range(400)}
        b = set(list(a)[:rng.randint(100, 400)]) | {rng.getrandbits(62) for _ in range(60)}
        rows.append((sorted(a)[:near.K], sorted(b)[:near.K]))
        true.append(len(a & b) / len(a | b))
    got = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>").select(
        near.union_estimate(F.col("a"), F.col("b")).alias("e")).collect()
    assert statistics.mean(abs(r.e - t) for r, t in zip(got, true, strict=True)) < 0.1


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "a long, b long")
    got = {r.node: r.label for r in graphs.components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100)}
