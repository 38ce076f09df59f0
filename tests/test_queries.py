"""Every core query against its SQL on the smallest tables, as the driver compares them."""

import math
import os
from collections import Counter

import pandas as pd
import pytest

from quire.plans import catalog

duckdb = pytest.importorskip("duckdb")


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return float(f"{v:.6g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v.tz_localize(None) if v.tz else v) if isinstance(v, pd.Timestamp) else v


def rows_of(frame, columns):
    return Counter(tuple(plain(x) for x in r) for r in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(data):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{data}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, data, db, name):
    got, wanted = catalog.queries()[name](spark, data).toPandas(), db.execute(catalog.oracle_sql()[name]).df()
    columns = sorted(wanted.columns)
    assert sorted(got.columns) == columns
    kinds = {kind for _, kind, *_ in db.execute("DESCRIBE " + catalog.oracle_sql()[name]).fetchall()}
    assert "HUGEINT" not in kinds and not any(k.startswith("DECIMAL") for k in kinds)  # Spark has BIGINT and DOUBLE
    assert rows_of(got, columns) == rows_of(wanted, columns)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, data, name):
    assert catalog.queries()[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
