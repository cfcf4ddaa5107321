"""Each registered query against its SQL on the small driver tables."""

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from kgtide import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, (list, tuple, np.ndarray)):
        return [plain(v) for v in value]
    if value is None or value is pd.NaT or value is pd.NA or value != value:
        return None
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    return round(float(value), 6) + 0.0 if isinstance(value, float) else value


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr([plain(v) for v in r]) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, sf_dir, duck, name):
    ours = catalog.queries()[name](spark, sf_dir).toPandas()
    theirs = duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0
