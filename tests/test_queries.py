"""Every query of the catalogue against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from lexloom import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def text(x):
    if isinstance(x, str):
        return x
    if hasattr(x, "__len__"):
        return "[" + ",".join(map(text, x)) + "]"
    if pd.isna(x):
        return ""
    return str(int(x)) if not hasattr(x, "isoformat") and float(x).is_integer() else str(x)


def rows(frame, columns):
    return sorted(tuple(text(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")
@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    if name in plans.ORACLES:
        want = con.sql(plans.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got, sorted(got.columns)) == rows(want, sorted(want.columns))
    else:
        assert len(got)
