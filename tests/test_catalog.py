"""Every registered query of the catalogue against its SQL on DuckDB."""

import duckdb
import pandas as pd
import pytest

from quarrykit import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(df):
    def plain(x):
        if x is None or x is pd.NA or x is pd.NaT or x != x:
            return "~"
        if isinstance(x, float):
            return f"{round(x, 6):g}" if abs(x) < 1e6 else f"{x:.2f}"
        text = str(x)
        return text.removesuffix(" 00:00:00")

    return sorted(tuple(plain(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


def test_every_query_has_sql():
    assert set(catalog.ORACLES) == set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_matches_sql(name, spark, sf, duck):
    ours, theirs = catalog.QUERIES[name](spark, sf).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
