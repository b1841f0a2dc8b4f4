"""The operators that SQL can express give what DuckDB gives."""

from __future__ import annotations

import pytest
from conftest import rows_of

from terrazzo.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(name, spark, data, duck):
    ours, theirs = queries.queries()[name](spark, data).toPandas(), duck.execute(queries.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and len(ours)
    assert rows_of(ours) == rows_of(theirs)
