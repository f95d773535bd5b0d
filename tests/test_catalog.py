import pytest

from loomtext.plans import catalog

from .compare import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf, name):
    got, want = spark_rows(catalog.QUERIES[name](spark, sf)), duck_rows(catalog.ORACLES[name], sf)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
