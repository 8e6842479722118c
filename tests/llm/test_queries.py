import pytest

from talkgrid.llm import queries as q
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, data, name):
    df = q.queries()[name](spark, data)
    if name in q.oracle_sql():
        compare(df, connect(data), q.oracle_sql()[name])
    else:
        rows = df.collect()
        assert df.columns and (rows or name in ("p1_found", "p1_report", "p3_neighbours", "p8_found"))
