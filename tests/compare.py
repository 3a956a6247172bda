"""Holds a query's rows against SQL that DuckDB runs over the same tables."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and pd.isna(v)):
            return ""
        return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


def oracle_rows(sql: str, sf: str) -> pd.DataFrame:
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return db.execute(sql).df()


def assert_same(frame: pd.DataFrame, sql: str, sf: str) -> None:
    want = oracle_rows(sql, sf)
    assert sorted(frame.columns) == sorted(want.columns)
    assert rows_of(frame) == rows_of(want)
