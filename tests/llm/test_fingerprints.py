import hashlib
import re
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from caretrail.llm import fingerprints as f
from caretrail.llm.queries import op6_document_fingerprints


def order(docs):
    return sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), d[1] or ""))


def edited(text, following):
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def jaccard(a, b):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t))
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def check(rows, docs):
    docs = [(i, t or "") for i, t in order(docs)]
    assert len(rows) == len(docs)
    want, error, prints = [], [], {}
    for (i, text), (_, following) in pairwise([*docs, docs[0]]):
        e = edited(text, following)
        want.append((i, len(text), hashlib.sha256(e.encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in rows), key=repr) == sorted(want, key=repr)
    by_id = {r.doc_id: r for r in rows}
    for (i, text), (_, following) in pairwise([*docs, docs[0]]):
        r = by_id[i]
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint or len(by_id) < len(rows)
        error.append(abs(r.near_edited - jaccard(text, edited(text, following))))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    return sum(error) / len(error)


def test_whole_table(spark, sf_dir, texts):
    assert check(op6_document_fingerprints(spark, sf_dir).collect(), list(texts.items())) < 0.15


DOCS = [(1, None), (2, ""), (5, " \t\n"), (9, "one"), (10, "one two three four"), (11, "a b c d e"), (40, "é🙂 " * 50),
        (1000, "w " * 20_000), (1001, "same text here for two rows"), (1001, "same text here for two rows"),
        (None, "no id"), (-7, "A b C d e f g h i j k l")]


@pytest.mark.parametrize("cell", [1, 3, 2000])
def test_edges(spark, cell):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    base = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = f.with_next(base, "doc_id", ["text"], cell).collect()
    docs = [(i, t or "") for i, t in order(DOCS)]
    assert sorted(((r.doc_id, r.text, r.next_text) for r in got), key=repr) == sorted(
        ((i, t, n) for (i, t), (_, n) in pairwise([*docs, docs[0]])), key=repr)


def test_edge_prints(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("sketch", F.lit(1)).withColumn("_w", F.lit(2))
    rows = f.fingerprints(df).collect()
    assert check(rows, DOCS) < 0.5
    assert {r.fingerprint for r in rows if r.doc_id in (1, 2, 5)} == {""}
    assert f.fingerprints(df.limit(0)).count() == 0
    alone = f.fingerprints(df.where("doc_id = 11")).first()
    assert alone.near_next == 1.0 and alone.n_chars == 9


def test_sketches_merge_and_contain(spark):
    a = " ".join(f"x{i}" for i in range(600))
    b = " ".join(f"x{i}" for i in range(300, 5000))
    df = spark.createDataFrame([(a, b, "tiny text", a + " " + b)], "a string, b string, c string, u string")
    for c in "abcu":
        df = f.with_sketch(df, c, f"s{c}")
    row = df.select(
        f.containment(F.col("sa"), F.col("sb")).alias("inside"), f.containment(F.col("sb"), F.col("sa")).alias("outside"),
        (F.size(F.array_except(f.merged(F.col("sa"), F.col("sb")), "su")) == 0).alias("merged"),
        (f.merged(F.col("sc"), F.col("sa")) == F.col("sa")).alias("small_goes")).first()
    assert abs(row.inside - 0.5) < 0.2 and row.outside < 0.15 and row.merged and row.small_goes
