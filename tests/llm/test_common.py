import pyarrow as pa

from caretrail.llm import common


def test_workers_get_texts_in_pieces(spark):
    """Not a whole batch at once: every row once, in order, and a long text by itself."""
    def size_at_once():
        return lambda texts: [pa.array([sum(len(x or "") for x in texts)] * len(texts), pa.int64())]

    sizes = [600_000] * 6 + [0, None, 5, 3_000_000, 7]
    rows = [(i, None if n is None else "x" * n) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = common.map_texts(df, ("doc_id",), "text", size_at_once, "total long").collect()
    assert [r.doc_id for r in got] == list(range(len(sizes)))
    assert max(r.total for r in got if r.doc_id not in (9, 10)) < 2 * common.PIECE
    assert all(r.total >= (n or 0) for r, n in zip(got, sizes, strict=True))


def test_pieces_of_an_empty_and_of_a_sliced_batch(monkeypatch):
    monkeypatch.setattr(common, "PIECE", 4)
    texts = pa.array(["zzzzzzz", "aa", None, "bbbb", "c", ""], pa.string())
    assert [p.to_pylist() for p in common.pieces(texts[1:], texts[1:])] == [["aa", None], ["bbbb", "c", ""]]
    assert [len(p) for p in common.pieces(texts[:0], texts[:0])] == [0]
