"""Every query of the reference operators against its SQL."""

import pytest
from same import assert_same

from quillgraph.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert_same(QUERIES[name](spark, sf_dir), duck, ORACLE_SQL[name])


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
