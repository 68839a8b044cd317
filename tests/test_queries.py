"""Every query of the catalogue against its DuckDB SQL."""

import os

import duckdb
import pytest

from compare_oracle import TABLES, rows
from marlstone.queries import catalogue

QUERIES, ORACLE = catalogue()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE) and len(QUERIES) > 130


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(ORACLE[name])
    assert got == rows([d[0] for d in cur.description], cur.fetchall())
