import pytest

from talkgrid.plans import catalog
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_core_query_matches_sql(spark, data, name):
    df = catalog.queries()[name](spark, data)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        df.collect()
    else:
        compare(df, connect(data), sql)


def test_entry(spark, data):
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries())
    assert e.entry(spark).schema == e.entry(spark).schema
    assert set(e.oracle_sql()) <= set(e.queries())
