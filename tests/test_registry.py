"""Every registered query of the core against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tideline.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    text = lambda v: None if v is None or v is pd.NA or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted((tuple(map(text, r)) for r in frame.astype(object).itertuples(index=False, name=None)), key=repr)


def exact(df):
    """df in pandas, with nullable integers kept whole instead of turned into floats."""
    frame = df.toArrow().to_pandas(integer_object_nulls=True)
    for c in frame:
        if isinstance(frame[c].dtype, pd.DatetimeTZDtype):
            frame[c] = frame[c].dt.tz_convert(None)
    return frame


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, duck, name):
    assert rows(exact(registry.QUERIES[name](spark, DATA))) == rows(duck.sql(registry.ORACLE_SQL[name]).df())
