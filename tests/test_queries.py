"""Every query against its SQL in DuckDB, on the smallest tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from millrace import queries

#: Their results depend on the scale factor of the tables and have no SQL.
ROWS_ONLY = sorted(set(queries.QUERIES) - set(queries.SQL))


def value(v):
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, (float, Decimal)):
        return f"{float(v):.8g}"
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    return value(v.item()) if hasattr(v, "item") else str(v)


def rows(frame, columns):
    return sorted(tuple(map(value, r)) for r in frame[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, sf, duck, name):
    ours, theirs = queries.QUERIES[name](spark, sf).toPandas(), duck.execute(queries.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours, sorted(ours.columns)) == rows(theirs, sorted(ours.columns))


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_gives_rows(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0
