import re

from pyspark.sql import functions as F

from caretrail.llm import decontaminate as d
from caretrail.llm.queries import ORACLE_SQL, op9_benchmark_decontamination
from checks.run import compare


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=10):
    grams = {}
    for item, text in items:
        w = words(text)
        for p in range(len(w) - min(window, len(w)) + 1 if w else 0):
            grams.setdefault(tuple(w[p:p + window]), set()).add("" if item is None else str(item))
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for m in {len(g) for g in grams}:
            for p in range(len(w) - m + 1):
                if (g := tuple(w[p:p + m])) in grams:
                    hit.update(range(p, p + m))
                    found |= grams[g]
        out.append((i, len(w), len(hit), len(found), bool(hit)))
    return sorted(out, key=repr)


def test_twin(spark, con, sf_dir):
    name = "op9_benchmark_decontamination"
    ok, said = compare(spark, con, sf_dir, name, op9_benchmark_decontamination, ORACLE_SQL[name])
    assert ok, said


LONG = " ".join(f"w{i}" for i in range(40))
ITEMS = [(1, LONG), (2, "Short item here"), (3, ""), (4, None), (5, "ÉA b"), (None, "nameless thing"), (6, LONG)]
DOCS = [(1, None), (2, ""), (3, "... !!"), (4, "a short ITEM here, b"), (5, "x " * 30_000 + LONG.upper() + " y"),
        (6, "éa b"), (7, "Éa, b"), (None, "nameless thing"), (8, LONG[:60]), (9, "same"), (9, "same"), (9, "short item here"),
        (10, " ".join(f"w{i}" for i in range(3, 13)))]


def frames(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("w", F.lit(1))
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


def test_edges_against_brute_force(spark):
    docs, items = frames(spark)
    for passes in (500_000, 10):
        got = d.contamination(docs, items, max_windows=passes).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got), key=repr) == brute(DOCS, ITEMS)


def test_removal(spark):
    docs, items = frames(spark)
    kept = d.decontaminate(docs, items)
    assert kept.columns == docs.columns
    clean = {(i, t) for i, t in DOCS if not brute([(i, t)], ITEMS)[0][4]}
    assert {(r.doc_id, r.text) for r in kept.collect()} == clean
    cut = {(r.doc_id, r.text) for r in d.decontaminate(docs, items, remove="spans").collect()}
    assert (4, "a b") in cut and (7, "") in cut and (6, "éa b") in cut and (1, None) in cut
    assert (5, "x " * 30_000 + "y") in cut


def test_empty_tables(spark):
    docs, items = frames(spark)
    got = d.contamination(docs, items.limit(0)).collect()
    assert len(got) == len(DOCS) and not any(r.contaminated for r in got)
    assert d.contamination(docs.limit(0), items).count() == 0
