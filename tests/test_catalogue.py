import pytest

from compare import SMALL, assert_same
from keyfold.queries import CATALOGUE


@pytest.mark.parametrize("name", CATALOGUE)
def test_matches_sql(spark, name):
    query, sql = CATALOGUE[name]
    assert_same(query(spark, SMALL), sql)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
