from __future__ import annotations

import pytest

from quillstore.llm import queries
from tests.oracle import assert_same, database


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_against_its_sql(spark, base, name):
    df = queries.QUERIES[name](spark, base)
    if name in queries.SQL:
        assert_same(df, database(base), queries.SQL[name])
    else:
        assert df.count() > 0
