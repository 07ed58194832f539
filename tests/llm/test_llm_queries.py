import pytest

import __spark_entry__ as entry
from terrane.llm import queries
from tests.oracle import connect, same

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, D)
    if name in queries.SQL:
        same(df, connect(D), queries.SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    q = entry.queries()
    assert set(queries.QUERIES) <= set(q) and set(entry.oracle_sql()) <= set(q)
    for n in range(1, 10):
        assert any(x.startswith(f"p{n}_") for x in q)
