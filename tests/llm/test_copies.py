import hashlib
import re

import pytest

from caretrail.llm import copies
from caretrail.llm.queries import ORACLE_SQL, op11_exact_dedup

COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
BLANK = re.compile(r"[\x20\x09-\x0D]")


def brute(docs):
    groups = {}
    for n, (i, t) in enumerate(docs):
        groups.setdefault(BLANK.sub("", t or ""), []).append((-len(t or ""), i is None, i or 0, n, i))
    out = []
    for norm, rows in groups.items():
        rows.sort()
        out += [(r[4], rows[0][4], len(rows), k == 0, hashlib.sha256(norm.encode()).hexdigest()) for k, r in enumerate(rows)]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_whole_table(spark, sf_dir, texts, con):
    got = rows(op11_exact_dedup(spark, sf_dir))
    assert got == brute(texts.items()) and sum(not r[3] for r in got) > 5
    assert got == sorted(con.execute(
        f"select {', '.join(COLUMNS)} from ({ORACLE_SQL['op11_exact_dedup']})").fetchall(), key=repr)


SAME = "p" * 64  # length and prefix alike, the rest not
DOCS = [(1, None), (2, ""), (3, " \t\r\n\x0b\x0c"), (4, "a b"), (5, "ab"), (6, "a  b"), (7, "a\xa0b"), (8, SAME + "x"), (9, SAME + "y"),
        (10, SAME + " x"), (11, "é🙂 " * 9), (12, "é🙂" * 9), (13, "w " * 30_000), (14, "w" * 30_000), (None, "ab"), (5, "ab"), (5, "ab"),
        (20, "twin"), (20, "twin"), (None, "alone"), (None, "no id"), (None, "no id")] + [(100 + i, "hot text") for i in range(60)]


@pytest.mark.parametrize("slots", [1 << 15, copies.SLOTS])
def test_edges(spark, slots):
    df = spark.createDataFrame([(*d, 1, "x", True) for d in DOCS],
                               "doc_id long, text string, group_size int, _slot string, kept boolean")
    from pyspark.sql import functions as F

    groups = copies.exact_groups(df, carried=[F.col("doc_id"), F.sha2(copies.normalised(F.col("text")), 256).alias(
        "text_sha256")], slots=slots)
    assert rows(groups) == brute(DOCS)
    kept = copies.without_copies(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.where("doc_id is not null").collect()) == sorted(
        (i, t) for (i, t) in dict.fromkeys(DOCS) if i is not None and (i, i, True) in {(r[0], r[1], r[3]) for r in brute(DOCS)}
        and hashlib.sha256(BLANK.sub("", t or "").encode()).hexdigest() in {r[4] for r in brute(DOCS) if r[0] == i and r[3]})
    assert copies.digests(df.limit(0)).count() == 0


def test_only_rows_that_share_length_and_prefix_are_hashed_whole(spark):
    docs = [(1, "short"), (2, "other"), (3, SAME + "1"), (4, SAME + "2"), (5, "q" * 65), (6, SAME + "1")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("text", "_norm")
    sized = df.selectExpr("doc_id", "_norm", "octet_length(_norm) as _size", "xxhash64(substring(_norm, 1, 64)) as _head")
    lengths = copies.shared_keys(sized, ["_size"], 1 << 20)
    first = copies.with_mark(sized, ["_size"], lengths, 1 << 20, "m").where("m")
    assert {r.doc_id for r in first.collect()} == {1, 2, 3, 4, 5, 6}
    heads = copies.shared_keys(first, ["_size", "_head"], 1 << 20)
    last = copies.with_mark(sized, ["_size", "_head"], heads, 1 << 20, "m").where("m")
    assert {r.doc_id for r in last.collect()} == {3, 4, 6}
