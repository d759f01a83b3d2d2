"""Registered queries of the subpackage against their SQL."""

from __future__ import annotations

import pytest

from casework.llm.queries import QUERIES, SQL
from tests.conftest import SF_CHECK
from tests.oracle_check import compare, duck


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    spark_rows = QUERIES[name](spark, SF_CHECK).toPandas()
    assert compare(spark_rows, duck(SF_CHECK).execute(SQL[name]).df()) == "OK"
    assert len(spark_rows)
