"""Every query of the core library against its SQL on DuckDB."""

import os

import duckdb
import pytest

from runledger.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(values):
    tidy = lambda v: float(f"{v:.9g}") if isinstance(v, float) else bytes(v) if isinstance(v, (bytearray, memoryview)) else v
    return sorted((tuple(tidy(v) for v in r) for r in values), key=str)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = rows(tuple(r) for r in df.select(*columns).collect())
    found = duck.execute(ORACLE_SQL[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == columns
    assert got == rows(tuple(r[at.index(c)] for c in columns) for r in found.fetchall())
