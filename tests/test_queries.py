import pytest
from conftest import SF

import __spark_entry__
from loomtable import plans


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_its_sql(name, same):
    same(plans.QUERIES[name], plans.SQL[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_gives_rows(name, spark):
    df = plans.QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(__spark_entry__.queries())
