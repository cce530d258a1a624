"""The queries agree with their SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from cantus.plans import file_queries, more_queries, run_queries  # noqa: F401 - register their queries
from cantus.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        if isinstance(v, list | np.ndarray):
            return tuple(map(plain, v))
        if hasattr(v, "item"):
            v = v.item()
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        return round(v, 6) if isinstance(v, float) else v

    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_matches_sql(spark, con, name):
    assert rows(Q.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(Q.ORACLES[name]).df())
