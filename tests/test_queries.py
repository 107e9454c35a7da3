import pytest

from marlstone import queries
from oracle import SF, same


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_matches_its_sql(spark, name):
    same(spark, queries.Q[name], queries.SQL[name])


@pytest.mark.parametrize("name", [n for n in queries.Q if n not in queries.SQL and not n.startswith("bench_")])
def test_query_without_sql_has_rows(spark, name):
    assert queries.Q[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
