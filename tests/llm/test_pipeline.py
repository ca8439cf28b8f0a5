import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as p
from caretrail.llm import bpe, toxicity
from caretrail.llm.common import documents
from caretrail.llm.queries import ORACLE_SQL

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What each stage got and returned, as rows."""
    docs, out = documents(spark, sf_dir), []
    for name, stage in p.STAGES:
        given = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), stage(spark, docs, sf_dir).schema)
        out.append((name, given, docs.collect(), docs.columns))
    return out


def twin(name, rows, sf_dir):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", [tuple(r[c] for c in COLUMNS) for r in rows])
    con.execute(f"create view benchmark as select * from '{sf_dir}/benchmark.parquet'")
    return con.execute(ORACLE_SQL[name]).fetchdf().set_index("doc_id")


def test_each_stage_on_its_own_input(spark, sf_dir, stages):
    """Stages 2 to 4 against the operators' SQL, 5 against the library; 1 against the operator's scores."""
    assert [name for name, *_ in stages] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"]
    assert all(columns == COLUMNS for *_, columns in stages[:-1])
    by_id = [({r.doc_id: r for r in given}, {r.doc_id: r for r in got}) for _, given, got, _ in stages]
    given, got = by_id[0]
    scores = toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
    assert got.keys() == {r.doc_id for r in scores if not r.predicted} and 0 < len(got) <= len(given)
    given, got = by_id[1]
    want = twin("op1_line_dedup", given.values(), sf_dir)["kept_sha256"]
    assert {i: hashlib.sha256(r.text.encode()).hexdigest() for i, r in got.items()} == want.to_dict()
    given, got = by_id[2]
    want = twin("op2_minhash_near_dedup", given.values(), sf_dir)["kept"]
    assert got.keys() == {i for i, kept in want.items() if kept} and got.keys() < given.keys()
    given, got = by_id[3]
    want = twin("op9_benchmark_decontamination", given.values(), sf_dir)["contaminated"]
    assert got.keys() == {i for i, bad in want.items() if not bad} and got.keys() < given.keys()
    given, got = by_id[4]
    library = Tokenizer.from_file(bpe.default_vocabulary())
    for i, r in given.items():
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert (got[i].ids, got[i].n_tokens, got[i].decoded) == (
            ids, len(ids), library.decode(ids, skip_special_tokens=False))


def test_nulls_clashing_columns_and_empty_tables(spark, sf_dir):
    docs = documents(spark, sf_dir).limit(20).withColumn("_k", F.lit(1)).withColumn("row", F.lit("x")).withColumn(
        "ids", F.lit(2)).withColumn("score", F.lit(None).cast("double"))
    odd = docs.limit(1).withColumns({c: F.lit(None).cast(t) for c, t in docs.dtypes})
    mixed = spark.createDataFrame(
        docs.unionByName(odd).collect(), ", ".join(f"`{c}` {t}" for c, t in docs.dtypes))
    for name, stage in p.STAGES:
        out = stage(spark, mixed, sf_dir)
        if name != "bpe":
            assert out.columns == mixed.columns
        assert any(r.doc_id is None for r in out.collect()), name
        assert stage(spark, mixed.limit(0), sf_dir).count() == 0


def test_toxicity_sends_texts_alone_to_python(spark, sf_dir):
    """Not the rows too, whose batches took an executor's memory; and each text once, filter or not."""
    got = p.toxicity(spark, documents(spark, sf_dir), sf_dir)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("ArrowEvalPython") == 1, plan
    assert re.search(r"ArrowEvalPython \[run\(text#\d+\)", plan), plan
