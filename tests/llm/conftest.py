import glob
import os

import duckdb
import pytest

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "labels")


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def con():
    con = duckdb.connect()
    for t in TABLES:
        assert glob.glob(f"{SF_DIR}/{t}.parquet") and os.path.exists(SF_DIR)
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def texts(con):
    """doc_id -> text of the smallest table."""
    return dict(con.execute("select doc_id, text from documents").fetchall())
