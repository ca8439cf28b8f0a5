import hashlib
import random

import pytest
from tokenizers import Tokenizer

from caretrail.llm import bpe
from caretrail.llm.queries import op7_bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def wanted(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_whole_table(spark, sf_dir, texts, library):
    rows = op7_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == wanted(library, texts[r.doc_id])


EDGE = [None, "", " ", "a" * 5000, "!" * 999, "<|endoftext|>x<|startoftext|>", "<|endof", "ΣΑΣ Σ", "é İ ﬁ Ⅷ ٣", "it's 'LL",
        "aaaa aaa aa a", "\x00\x1c\x85​­", "word " * 20_000, "same", "same"]


def test_edges(spark, library):
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(EDGE)] + [(None, "x", 0)], "doc_id long, text string, ids int")
    rows = {r.doc_id: r for r in bpe.digests(df).collect()}
    assert len(rows) == len(EDGE) + 1
    for i, t in [*enumerate(EDGE), (None, "x")]:
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == wanted(library, t), t
    assert bpe.digests(df.limit(0)).count() == 0


def test_random_texts(library):
    letters = [*"abAB'sSΣσ🙂éÉİı́\x1c\x85\xa0 \n\t09²Ⅷ٣ßẞǅ中", "<|endoftext|>", "'S", "don't", "aaaa"]
    rng = random.Random(5)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    work = bpe.encoder(bpe.default_vocabulary())
    got = work(texts[:1000])[0].to_pylist() + work(texts[1000:])[0].to_pylist()
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
