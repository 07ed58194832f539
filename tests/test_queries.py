import pytest

from terrane.plans import registry
from tests.oracle import connect, same

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(D)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, D)
    if name in registry.SQL:
        same(df, con, registry.SQL[name])
    else:
        assert df.columns and df.count() >= 0


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_flagship_plan_prunes_columns(spark):
    plan = registry.QUERIES["way_geometry_stats"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "changeset" not in plan and "loaded_at" not in plan
