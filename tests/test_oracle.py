"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from treeledger.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list:
    def one(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        return v if isinstance(v, bool) else float(v) if isinstance(v, int | float) else str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(map(one, r)) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_duckdb(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
