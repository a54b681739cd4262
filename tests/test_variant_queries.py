"""Each registered variant query against its SQL: those over column values at the size of the correctness check, hand-written cases at a smaller one."""

import pytest
from conftest import SF, TABLES, same_rows

from lociform.plans import queries as variants

LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def larger():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{LARGER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(variants.CASES))
def test_case_query_equals_its_sql(spark, duck, name):
    same_rows(variants.queries()[name](spark, SF), duck.execute(variants.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(variants.queries()) - set(variants.CASES)))
def test_query_equals_its_sql(spark, larger, name):
    same_rows(variants.queries()[name](spark, LARGER), larger.execute(variants.oracle_sql()[name]).df())
