import zlib

import numpy as np

from caretrail.llm import sharding
from caretrail.llm.queries import op4_sharding


def check(rows, texts, shards=16):
    """The law ``rows``, gapless slots, sizes and checksums; ``texts`` are (doc_id, text)."""
    data = [(t or "").encode() for _, t in texts]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted(
        (i is None, i or 0, len(b) + 1, zlib.crc32(b)) for (i, _), b in zip(texts, data, strict=True))
    by_shard = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(shards)}
    assert sum(map(len, by_shard.values())) == len(rows)
    assert all(slots == list(range(len(slots))) for slots in by_shard.values())
    counts = [len(s) for s in by_shard.values()]
    assert max(counts) - min(counts) <= 1
    assert all(r.law == "rows" and r.grown_shard is None for r in rows)
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.place for r in order] == sorted(r.place for r in order)


def test_whole_table(spark, sf_dir, texts):
    check(op4_sharding(spark, sf_dir).collect(), list(texts.items()))


def test_curve_visits_every_cell_by_single_steps():
    for n, bits in ((2, 3), (3, 2), (3, 4)):
        points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
        place = sharding.hilbert_index(points, bits)
        assert sorted(place.tolist()) == list(range(1 << bits * n))
        walk = points[np.argsort(place)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_sources_with_one_prefix_are_told_apart(spark):
    """Sixteen sources that start alike: a shard holds few of them, so files prune on source."""
    rows = [(i, "x", "en", f"https://site{i % 16:02d}.example") for i in range(1600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = sharding.document_shards(df).collect()
    check(got, [r[:2] for r in rows])
    source, by_shard = {r[0]: r[3] for r in rows}, {}
    for r in got:
        by_shard.setdefault(r.shard, set()).add(source[r.doc_id])
    assert max(map(len, by_shard.values())) <= 2


def test_places_by_the_definition(spark):
    """A row's place is the curve's at the steps of its values: rank of the whole text, quantile of the size."""
    rows = [(i, "t" * (i % 7), f"l{i % 3}", f"s{i % 5}" if i % 11 else None) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.place, r.size) for r in sharding.document_shards(df).collect()}
    sizes = sorted(r[1].count("t") + 1 for r in rows)
    bounds = {sizes[max(0, int(np.ceil(len(sizes) * i / 16)) - 1)] for i in range(1, 16)}

    def rank(values, v):
        order = lambda x: (x is not None, x or "")
        return sum(order(x) < order(v) for x in values) * 16 // len(values)

    points = [(rank([r[2] for r in rows], lang), rank([r[3] for r in rows], source), sum(len(text) + 1 >= b for b in bounds))
              for _, text, lang, source in rows]
    want = sharding.hilbert_index(np.array(points), 4).tolist()
    assert [got[r[0]][0] for r in rows] == want


def test_edges(spark):
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, "é" * 40_000, "de", "s"), (4, "x", "en", ""), (4, "x", "en", ""),
            (None, "y", "fr", "t")] + [(10 + i, "same", "en", "hot") for i in range(40)]
    df = spark.createDataFrame([(*r, 0, 0, 7) for r in rows],
                               "doc_id long, text string, lang string, source string, place int, shard int, slot int")
    check(sharding.document_shards(df).collect(), [r[:2] for r in rows])
    few = sharding.document_shards(df.limit(0).unionByName(df.limit(3))).collect()
    assert len(few) == 3 and len({r.shard for r in few}) == 3
    assert sharding.document_shards(df.limit(0)).count() == 0


def test_files_prune(spark, sf_dir, tmp_path):
    sharding.write_shards(op4_sharding(spark, sf_dir), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    spans = back.groupBy("shard").agg({"size": "max"}).collect()
    assert back.count() == 200 and len(spans) == 16 and len({r["max(size)"] for r in spans}) > 4
