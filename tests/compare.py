"""Rows of a Spark query against those of DuckDB."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def rows(df):
    df = df[sorted(df.columns)]

    def plain(v):
        if pd.isna(v):
            return None
        # A column of whole numbers with nulls may come as floats from either side.
        return str(int(v)) if isinstance(v, float) and v == int(v) else repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(([plain(v) for v in row] for row in df.itertuples(index=False)), key=str)


def assert_same(spark, sf_dir, query, sql):
    got, want = query(spark, sf_dir).toPandas(), duck(sf_dir).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
