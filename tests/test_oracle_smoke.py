"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import duckdb
import pytest

from corpuskit.queries import all_queries, all_sql
from tools.check_oracle import TABLES, digest

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    return c


def test_queries_match_oracle(spark, con):
    qs, sql = all_queries(), all_sql()
    bad = []
    for name, text in sql.items():
        sdf = qs[name](spark, SMOKE)
        srows = [tuple(r) for r in sdf.collect()]
        rel = con.execute(text)
        dcols = [c[0] for c in rel.description]
        drows = rel.fetchall()
        if sorted(sdf.columns) != sorted(dcols) or digest(sdf.columns, srows)[0] != digest(dcols, drows)[0]:
            bad.append(name)
    assert bad == []
