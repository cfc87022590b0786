"""The SQL of the training-data queries on DuckDB."""

import duckdb
import pytest

from tracemill.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, small, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        db.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    found = db.execute(registry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    got = registry.queries()[name](spark, small)
    order = sorted(names)
    assert sorted(got.columns) == order
    want = sorted((tuple(r[names.index(c)] for c in order) for r in found.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in order) for r in got.collect()), key=str) == want
