"""The training-data queries that SQL can express, and the shape of the others."""

import pytest
from same import assert_same

from quillgraph.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert_same(QUERIES[name](spark, sf_dir), duck, ORACLE_SQL[name])


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
