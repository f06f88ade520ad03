"""The operators' queries against their SQL."""

import pytest
from compare import connect, difference

from tessera.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), connect(SF), ORACLE_SQL[name]) is None
