"""Every named query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from gleanery.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame):
    def one(v):
        if v is None or v is pd.NaT or v != v:
            return None
        if isinstance(v, float):
            return round(v, 5) + 0.0
        return str(v) if not isinstance(v, (bool, int, str)) and not hasattr(v, "item") else getattr(v, "item", lambda: v)()

    cols = sorted(df.columns)
    return cols, sorted((tuple(one(v) for v in row) for row in df[cols].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, sf, duck, name):
    got = catalogue.QUERIES[name](spark, sf)
    if name in catalogue.ORACLES:
        assert plain(got.toPandas()) == plain(duck.sql(catalogue.ORACLES[name]).df())
    else:
        assert got.count() > 0
