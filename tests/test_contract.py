"""Driver contract: every registered query runs at sf0.001 and keeps its schema."""

import pytest

import __spark_entry__ as E

from .conftest import SF_SMALL


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_runs_with_stable_schema(spark, name):
    fn = E.queries()[name]
    first = fn(spark, SF_SMALL)
    assert first.count() >= 0
    assert fn(spark, SF_SMALL).schema == first.schema
    assert len(set(first.columns)) == len(first.columns)  # no duplicate names
