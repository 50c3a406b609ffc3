import pytest

from helpers import DATA, same_rows
from tidebar.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    same_rows(got, duck.execute(ORACLE_SQL[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
