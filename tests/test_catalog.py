"""Every registered query against its DuckDB oracle on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from placetrail.plans import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def cell(value):
    if value is None or value is pd.NA or value != value:
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "__float__"):
        number = float(value)
        return number if math.isinf(number) else float(f"{number:.5g}") + 0.0
    return str(value)


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(cell(v) for v in row) for row in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, sf_dir, name):
    own = catalog.QUERIES[name](spark, sf_dir).toPandas()
    other = duck.execute(catalog.ORACLES[name]).fetchdf()
    assert sorted(own.columns) == sorted(other.columns)
    assert rows(own) == rows(other)
