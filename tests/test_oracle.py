"""A representative subset of the correctness gate at sf0.001: the Spark query
and its DuckDB statement must give the same rows."""

import pytest

from conftest import SF
from oracle_harness import compare, duck

import __spark_entry__ as E

SUBSET = ("mt00_reconcile_tolerance", "mt10_majority", "mt14_match_details", "val_pipeline_outcome",
          "idm01_idempotency_labels", "sta01_two_pass_state", "rs07_manual_resolution", "rt03_run_retries",
          "mon05_payload_size_histogram", "src07_incremental_rows")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", SUBSET)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF)
    assert r["ok"], r


def test_every_query_has_a_schema(spark):
    qs = E.queries()
    assert len(qs) >= 60
    for name, fn in qs.items():
        assert fn(spark, SF).columns, name


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
