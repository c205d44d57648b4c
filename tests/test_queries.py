"""Every registered query on the smallest tables: the oracle's rows where there is one, else rows at all."""

import pytest
from oracle import actual, expected

from melisma import registry

PATH = "/root/testdata/sf0.001"
ORACLE = registry.oracle_sql()


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, name):
    df = registry.queries()[name](spark, PATH)
    if name in ORACLE:
        assert actual(df) == expected(ORACLE[name], PATH)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
