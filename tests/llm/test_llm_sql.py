"""Registered queries of the training-data operators against their SQL."""

import oracle
import pytest

from duolith.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert oracle.differ(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir) == ""
