"""Every SQL-checked query equals its DuckDB oracle at sf0.001 (exact values)."""

import pytest

import __spark_entry__ as E
from tools.check_oracle import compare, duck

from .conftest import SF_SMALL

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(E.queries()[name](spark, SF_SMALL), con, SQL[name])
    assert ok, msg


def test_every_query_has_oracle_or_is_a_model():
    from media_analytics.plans.catalog import ROWS_ONLY, queries
    assert set(queries()) == {k for k in SQL if k in queries()} | ROWS_ONLY


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and df.columns == ["video_efficiency", "interaction_score", "consistency",
                                             "virality_index", "quality_score"]
