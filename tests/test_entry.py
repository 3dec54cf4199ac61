import __spark_entry__ as E
from corpuskit.queries import all_queries, all_sql

SMOKE = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert set(df.columns) == {"bucket", "n_lines"} and len(rows) > 0


def test_registry_consistent():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 50


def test_every_query_runs_on_smoke_data(spark):
    for name, fn in all_queries().items():  # the training-data queries have tests of their own
        df = fn(spark, SMOKE)
        assert df.columns, name
        df.limit(5).collect()
