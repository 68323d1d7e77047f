"""Every registered query against its DuckDB oracle on the smallest scale (the driver uses sf0.01)."""

import pytest

import __spark_entry__ as entry
from tests.oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"
SKIP_SLOW = {"benchmark_run"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_oracle(spark, con, name):
    if name in SKIP_SLOW:
        pytest.skip("model fit; covered by test_sources_jobs")
    r = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert r["status"] in ("match", "rows-only"), r


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 1 and df.columns == ["label", "n", "mean_gc", "min_gc", "max_gc"]
