"""Runs a query and its SQL on the same tables and compares the rows."""

import os

import duckdb
import pandas as pd

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows_of(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "null" if v is None or v is pd.NaT or isinstance(v, float) and v != v else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def same(spark, run, sql: str, sf: str = SF) -> None:
    con = duckdb.connect()
    for f in sorted(os.listdir(sf)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    got, want = rows_of(run(spark, sf).toPandas()), rows_of(con.execute(sql).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    assert got.equals(want), got[(got != want).any(axis=1)].head()
