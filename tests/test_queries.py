"""Every query of the library with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pandas as pd
import pytest

from tidemill.plans import audit_queries, bar_queries, decision_queries, panel_queries, passage_queries, portfolio_queries, relational_queries, story_queries

GROUPS = (bar_queries, panel_queries, relational_queries, decision_queries, story_queries, portfolio_queries, passage_queries, audit_queries)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CASES = [(name, group) for group in GROUPS for name in group.SQL]


@pytest.fixture(scope="module")
def tables(small_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{small_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def canonical(df: pd.DataFrame) -> list:
    cells = df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None)
    text = lambda v: "NULL" if v is None else f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(text(v) for v in row) for row in cells.itertuples(index=False))


@pytest.mark.parametrize("name,group", CASES, ids=[n for n, _ in CASES])
def test_same_rows(spark, small_dir, tables, name, group):
    got, want = group.QUERIES[name](spark, small_dir).toPandas(), tables.execute(group.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    differing = [(a, b) for a, b in zip(canonical(got), canonical(want), strict=True) if a != b]
    # a value that lies just between two roundings may fall either way
    assert all(x == y or abs(float(x) - float(y)) <= 2e-5 for a, b in differing for x, y in zip(a, b, strict=True))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["symbol", "ts", "close", "fast", "slow"]
