"""Operators with SQL against DuckDB, on the smallest tables."""

import duckdb
import pytest

from relspark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF), duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, got.select(*columns).toLocalIterator())) == sorted(f"Row({', '.join(f'{c}={v!r}' for c, v in zip(columns, x, strict=True))})" for x in want.fetchall())
