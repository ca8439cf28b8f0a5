"""Every registered query against its DuckDB twin, over the whole tables of the smallest scale factor."""

import pytest

import __spark_entry__ as entry
from checks import CHECKS
from checks.run import compare, duck

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(CHECKS))
def test_query(spark, con, name):
    ok, text = compare(spark, con, SF_DIR, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, text


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "name", "type", "status", "createdAt", "referralSources"]
    assert df.count() == 5


def test_every_query_has_a_twin():
    assert set(CHECKS) <= set(entry.queries()) and set(CHECKS) <= set(entry.oracle_sql())


@pytest.mark.parametrize(
    "name", ["newest_sources", "latest_interactions", "clinics_by_name", "sources_by_address", "sources_by_providers",
             "limited_interactions", "recent_interactions", "recent_campaigns"])
def test_order(spark, con, name):
    ours = [r.id for r in entry.queries()[name](spark, SF_DIR).select("id").collect()]
    rel = con.execute(entry.oracle_sql()[name])
    at = [d[0] for d in rel.description].index("id")
    assert ours == [r[at] for r in rel.fetchall()]
