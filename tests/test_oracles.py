"""Every registered query with an SQL oracle agrees with DuckDB (sf0.001)."""
import pytest

import __spark_entry__ as E
from tests.compare import assert_same
from tests.conftest import SF_SMALL

ORACLES = E.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    want = duck.sql(ORACLES[name]).df()
    assert_same(got, want)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["total_customers", "orders", "revenue", "aov", "churn_rate_pct"]
    assert df.count() == 1
