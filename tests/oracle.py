"""Comparing a query with its SQL, as the driver does."""

import datetime
import os
from pathlib import Path

import duckdb

DATA = Path(os.environ.get("SHELFMARK_TESTDATA", "/root/testdata/sf0.001"))


def connect(folder=DATA):
    con = duckdb.connect()
    con.execute("SET threads = 2")
    for path in Path(folder).glob("*.parquet"):
        where = path / "*.parquet" if path.is_dir() else path
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{where}')")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows_of_sql(con, sql, columns):
    answer = con.execute(sql)
    names = [c[0] for c in answer.description]
    assert sorted(names) == sorted(columns)
    at = [names.index(c) for c in sorted(columns)]
    return sorted(repr([plain(r[i]) for i in at]) for r in answer.fetchall())


def rows_of_spark(df):
    return sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
