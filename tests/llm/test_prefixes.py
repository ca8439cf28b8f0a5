import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from caretrail.llm import prefixes
from caretrail.llm.queries import ORACLE_SQL, op13_conversation_trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows):
    """The contract over (conv_id, turn, role, text), with every prefix as a tuple."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[-1] for t in sorted(turns)] for c, turns in convs.items()}
    built = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    nodes, children, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            nodes[built[c][:d]].append(c)
    for way in nodes:
        if way:
            children[way[:-1]] += 1
    for way, members in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", way[-1][1])) if way else 0
        for d in range(len(way) + 1):
            leaves[way[:d]] += children[way] == 0
            saved[way[:d]] += (len(members) - 1) * words
    return sorted(((min(m), len(w), min(nodes[w[:-1]]) if w else None, len(m), children[w], leaves[w], saved[w], hashlib.sha256(
        ",".join(str(c) for c in m if len(built[c]) == len(w)).encode()).hexdigest()) for w, m in nodes.items()), key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def source(df):
    return [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]


def test_whole_table(spark, sf_dir, con):
    con.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    got = rows_of(op13_conversation_trie(spark, sf_dir))
    assert got == brute(source(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    assert got == sorted(con.execute(f"select {', '.join(COLUMNS)} from ({ORACLE_SQL['op13_conversation_trie']})").fetchall(), key=repr)


def edge_rows():
    odd = [(1, None, None, None), (1, 0, "u", "a b"), (1, 0, "u", "a b"), (None, 1, "u", "x"), (0, 0, "u", ""), (0, 1, "a", " q w "),
           (20, 5, "u", "z"), (21, 5, "u", "z"), (22, 5, "u", "z"), (-3, 0, "u", "x"), (-20, 0, "u", "x"), (-23, 2, "", "\xa0é \x0b🙂")]
    hot = [(c, t, "u", f"same {t}") for c in range(200, 240) for t in range(5)]
    return odd + hot + [(40, t, "u", f"w{t} " * 3) for t in range(50)] + [(60, t, "u", f"w{t} " * 3) for t in range(30)] + [
        (62, 0, "u", "w " * 20_000)]


@pytest.mark.parametrize("sizes", [(prefixes.SHARD, prefixes.SEGMENT), (7, 4), (1, 1)])
def test_edges(spark, sizes):
    """Any size of shards and segments gives the same trie."""
    df = spark.createDataFrame([(*r, 1, b"k") for r in edge_rows()],
                               "conv_id long, turn long, role string, text string, depth int, hash binary")
    assert rows_of(prefixes.trie(df, *sizes)) == brute(source(df))


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefixes.trie(df).count() == 0


def test_walk_intersects_once_a_node():
    shard = prefixes.Shard([[b"a", b"b"], [b"a"], [b"a", b"c"], [b"d"]], [b""] * 4, [False] * 4)
    nodes = {(at, members): ends for at, _, _, members, ends in shard.walk()}
    assert nodes == {(0, 0b1111): 0, (1, 0b0111): 0b0010, (2, 0b0001): 1, (2, 0b0100): 0b0100, (1, 0b1000): 0b1000}
    assert shard.postings[0] == {b"a": 0b0111, b"d": 0b1000}
