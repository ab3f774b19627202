import pytest

from millrace.plans import registry

from .compare import assert_same


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    fn, sql = registry.QUERIES[name]
    df = fn(spark, sf_dir)
    if sql is None:
        assert df.count() >= 0
    else:
        assert_same(df, sf_dir, sql)


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries())
