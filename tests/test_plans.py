import pytest

from motionframe import plans
from tests.conftest import SF
from tests.oracle import by_sql, rows


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, name):
    found = plans.QUERIES[name](spark, SF).toPandas()
    if name in plans.ORACLE_SQL:
        expected = by_sql(plans.ORACLE_SQL[name], SF)
        assert sorted(found.columns) == sorted(expected.columns)
        assert rows(found) == rows(expected)
    else:
        assert len(found)


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
