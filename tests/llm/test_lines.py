import random
from collections import Counter

from pyspark.sql import functions as F

from caretrail.llm import lines as m
from caretrail.llm.queries import ORACLE_SQL, op1_line_dedup
from checks.run import compare


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs, edits=2, least=24):
    """Cleaned text of every (doc_id, text) with unique ids."""
    seen, first = {}, []
    for i, t in sorted(docs, key=lambda d: -1 if d[0] is None else d[0]):
        for pos, line in enumerate((t or "").split("\n")):
            if len(line.encode()) >= least and line not in seen:
                seen[line] = (i, pos)
                first.append(((-1 if i is None else i, line.encode()), line))
    first.sort()
    gone = {y for n, (_, y) in enumerate(first) for _, x in first[:n]
            if abs(len(x.encode()) - len(y.encode())) <= edits and distance(x.encode(), y.encode()) <= edits}
    return {i: None if t is None else "\n".join(
        x for pos, x in enumerate(t.split("\n")) if len(x.encode()) < least or (seen[x] == (i, pos) and x not in gone))
        for i, t in docs}


def test_twin(spark, con, sf_dir):
    ok, said = compare(spark, con, sf_dir, "op1_line_dedup", op1_line_dedup, ORACLE_SQL["op1_line_dedup"])
    assert ok, said


def test_edit_distance(spark):
    rng = random.Random(7)
    pairs = []
    for _ in range(600):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(5, 40)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(b) + 1)
            b[at:at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "x"])
        b = "".join(b)
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        pairs.append((a, b, distance(a, b)))
    df = spark.createDataFrame(pairs, "a string, b string, d int").select(
        F.col("a").cast("binary").alias("a"), F.col("b").cast("binary").alias("b"), "d")
    for edits in (1, 2, 3):
        near = df.where(F.octet_length("a") - F.octet_length("b") <= edits)
        got = near.select("d", m.edit_distance(F.col("a"), F.col("b"), edits).alias("e")).collect()
        assert all(r.d == r.e if r.d <= edits else r.e > edits for r in got)
        assert sum(r.d <= edits for r in got) > 50


BASE = "a line of text that is long enough to be compared"


def test_edges(spark):
    rng = random.Random(2)
    docs = [(1, None), (2, ""), (3, "\n\n"), (4, f"short\n{BASE}\nshort"), (5, f"short\n{BASE}!\n\nother words, long enough to count"),
            (6, BASE), (7, BASE.replace("text", "test") + "\nnew"), (None, "z" * 30), (8, "z" * 29), (9, "x" * 2_000), (13, "y" * 70_000),
            (10, "x" * 2_001), (11, "é" * 12 + "\n" + "é" * 11 + "è"), (12, f"{BASE}\n{BASE}\n{BASE[1:]}")]
    for i in range(40):  # a crowd of variants of one line
        w = list(BASE)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = rng.choice("qwxyz")
        docs.append((100 + i, "".join(w) + "\nend"))
    df = spark.createDataFrame([(*d, "k", 1) for d in docs], "doc_id long, text string, line string, _x int")
    out = m.without_repeats(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == brute(docs)
    assert m.without_repeats(df.limit(0)).count() == 0


def test_repeated_rows_are_cleaned_alike(spark):
    df = spark.createDataFrame([(1, BASE), (1, BASE), (2, BASE), (2, "x\ny"), (2, "x\ny")], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in m.without_repeats(df).collect())
    assert got == [(1, BASE), (1, BASE), (2, ""), (2, "x\ny"), (2, "x\ny")]


def test_a_crowd_makes_no_rows_of_its_pairs(spark):
    """Many variants of one line, near each other or only alike at a segment: joins give a row a line and key at most."""
    rng = random.Random(5)
    docs = [(i, BASE[:30] + "".join(rng.choice("etaoin") for _ in range(20))) for i in range(50)]
    docs += [(200 + i, BASE[:-2] + f"{i:03d}") for i in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    firsts = m.first_rows(df)
    keys = [r.key for r in m.meeting_lines(df, firsts).collect()]
    assert len(keys) <= 8 * len(docs) and max(Counter(keys).values()) >= 50
    got = m.without_repeats(df)
    assert {r.doc_id: r.text for r in got.collect()} == brute(docs)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line and "key#" in line]
    assert joins and all("Join LeftSemi" in line for line in joins), joins


def test_pairs_at_every_place_and_length(spark):
    """Lines of every length around the borders of the cells, each with a copy of up to two edits anywhere."""
    rng = random.Random(11)
    docs = []
    for n in [*range(24, 52), 63, 64, 65, 66, 80, 81, 82, 160, 161]:
        for _ in range(6):
            a = [rng.choice("abcdefghij ") for _ in range(n)]
            b = list(a)
            for _ in range(rng.randint(1, 2)):
                at = rng.choice([0, n // 3, n // 2, 2 * n // 3, n - 1, rng.randrange(n)])
                b[min(at, len(b)):at + rng.randint(0, 1)] = rng.choice(["", "é", "x", "y"])
            docs += [(len(docs), "".join(a)), (len(docs) + 1, "".join(b))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    assert {r.doc_id: r.text for r in m.without_repeats(df).collect()} == want
    assert sum(t == "" for t in want.values()) > 150
    for edits, least in ((1, 5), (3, 10)):
        few = docs[:120]
        got = m.without_repeats(df.where(F.col("doc_id") < len(few)), edits, least)
        assert {r.doc_id: r.text for r in got.collect()} == brute(few, edits, least), edits
