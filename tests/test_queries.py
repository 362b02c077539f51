"""Every query of the catalogue gives the rows of its SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(d: pd.DataFrame) -> pd.DataFrame:
    def text(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "-"
        return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    d = d[sorted(d.columns)].map(text)
    return d.sort_values(list(d.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = plain(catalogue.queries()[name](spark, DATA).toPandas())
    want = plain(duck.execute(catalogue.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
