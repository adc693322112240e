"""The training-data queries that SQL can express, against DuckDB over whole tables."""

import duckdb
import pytest

from foliospark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df, got = QUERIES[name](spark, sf_dir), c.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(map(str, got.fetchall()))
    assert sorted(str(tuple(r)) for r in df.select(*names).collect()) == want and want
