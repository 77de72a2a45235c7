import pytest
from conftest import same_rows

from lumenquarry.plans import scene_queries
from lumenquarry.plans import table_queries as T


@pytest.mark.parametrize("name", sorted(T.ORACLE_SQL))
def test_same_as_sql(spark, duck, sf_dir, name):
    assert same_rows(T.QUERIES[name](spark, sf_dir), duck.sql(T.ORACLE_SQL[name])) > 0


@pytest.mark.parametrize("name", sorted(scene_queries.UNCHECKED))
def test_queries_without_sql_give_rows(spark, sf_dir, name):
    assert scene_queries.UNCHECKED[name](spark, sf_dir).count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
