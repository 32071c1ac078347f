"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry
from sealbook.plans.oracles import oracles
from sealbook.plans.registry import registered

FOLDER = Path("/root/testdata/sf0.001")
KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE"}

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        con.sql(f"create view {file.stem} as select * from '{file}'")
    return con


def plain(row):
    return repr(tuple(round(v, 6) if isinstance(v, float) else v for v in row))


@pytest.mark.parametrize("name", sorted(registered()))
def test_same_rows(spark, duck, name):
    df = registered()[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    found = sorted(plain(r) for r in df.select(*columns).collect())
    sql = duck.sql(oracles()[name])
    assert sorted(sql.columns) == columns
    assert {c: KINDS[t] for c, t in df.dtypes} == dict(zip(sql.columns, map(str, sql.types)))
    expected = sorted(plain(r) for r in sql.select(*columns).fetchall())
    assert found == expected


def test_entry(spark):
    assert entry(spark).count() > 0
