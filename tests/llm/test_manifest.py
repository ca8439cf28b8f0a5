import hashlib
import zlib

import pytest

from caretrail.llm import manifest
from caretrail.llm.queries import ORACLE_SQL, op12_merkle_manifest

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def mark(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r):
    return sha("".join(mark(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")))


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i // 8 * 8:i // 8 * 8 + 8]
        out.append(("".join(run[:i % 8]), "".join(run[i % 8 + 1:])))
        i //= 8
    return out


def brute(rows):
    """The contract, row by row, without a kept state."""
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r["lang"] == x), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
              for x in langs]
    trees = [tree([leaf(r) for r in g]) for g in groups]
    top, out = tree([t[-1][0] for t in trees]), []
    for k, (group, own) in enumerate(zip(groups, trees, strict=True)):
        for i, r in enumerate(group):
            path = siblings(own, i) + siblings(top, k)
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            digest = leaf({**r, "text": lowered(r["text"])}) if changed else leaf(r)
            for left, right in path:
                digest = sha(left + digest + right)
            out.append((r["doc_id"], leaf(r), own[-1][0], top[-1][0], sha("".join(a + b for a, b in path)), digest,
                        digest == top[-1][0]))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_whole_table(spark, sf_dir, con):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = rows_of(op12_merkle_manifest(spark, sf_dir))
    assert got == brute(docs) and 0 < sum(r[-1] for r in got) < len(got)
    assert got == sorted(con.execute(f"select {', '.join(COLUMNS)} from ({ORACLE_SQL['op12_merkle_manifest']})").fetchall(), key=repr)


def edge_rows():
    odd = [(None, None, None, None, None), (None, "Text", None, "s", 4), (1, "", "en", "s", 0), (2, None, "en", None, None),
           (3, "ABC" * 20_000, "en", "s", 60_000), (3, "ABC" * 20_000, "en", "s", 60_000), (4, "same", "en", "s", 4),
           (4, "Same", "en", "s", 4), (-5, "ÀB🙂", "de", "s", 3), (6, "Lone", "zz", "s", 4)]
    return odd + [(100 + i, f"Row {i}", "hot", "s", i) for i in range(75)] + [(7, "X", "", "s", 1)]


@pytest.mark.parametrize("height", [1, 2, 3])
def test_edges(spark, height):
    """Any height of the subtrees gives the same tree; with 1 the climb takes several rounds."""
    df = spark.createDataFrame([(*r, 1, "g") for r in edge_rows()],
                               "doc_id long, text string, lang string, source string, n_chars long, n int, `group` string")
    assert rows_of(manifest.digests(df, height)) == brute([r.asDict() for r in df.collect()])


def test_one_row_and_none(spark):
    df = spark.createDataFrame([edge_rows()[-1]], "doc_id long, text string, lang string, source string, n_chars long")
    (row,) = rows_of(manifest.digests(df))
    assert row[1:4] == (row[1],) * 3 and row[4] == sha("")
    assert manifest.digests(df.limit(0)).count() == 0


def test_folding_takes_the_kept_state_and_right_siblings_only():
    leaves = [sha(str(i)).encode() for i in range(20)]
    tree_ = manifest.Subtree(leaves, 2)
    for slot in (0, 7, 8, 19):
        assert tree_.folded(slot, leaves[slot]) == tree_.top
        changed = [*leaves]
        changed[slot] = sha("new").encode()
        assert tree_.folded(slot, sha("new").encode()) == manifest.Subtree(changed, 2).top
    for runs in tree_.levels:  # left siblings aren't read again
        for run, _ in runs:
            run[0] = b"gone"
    assert tree_.folded(19, leaves[19]) == tree_.top
