from __future__ import annotations

import pytest

from quillstore.plans import registry
from tests.oracle import assert_same, database


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_against_its_sql(spark, base, name):
    df = registry.queries()[name](spark, base)
    if name in registry.sql():
        assert_same(df, database(base), registry.sql()[name])
    else:
        assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(registry.sql()) <= set(registry.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
