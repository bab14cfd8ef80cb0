"""Run a query in Spark and its SQL in DuckDB and compare them value by value."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(v) for v in row) for row in df.select(*names).collect()), key=repr)


def duck_rows(con, sql: str):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = sorted((tuple(plain(row[i]) for i in order) for row in cursor.fetchall()), key=repr)
    return [names[i] for i in order], rows


def difference(spark_side, duck_side) -> str | None:
    """None when equal, else the first difference."""
    (s_names, s_rows), (d_names, d_rows) = spark_side, duck_side
    if s_names != d_names:
        return f"columns {s_names} / {d_names}"
    if len(s_rows) != len(d_rows):
        return f"rows {len(s_rows)} / {len(d_rows)}; first {s_rows[:2]} / {d_rows[:2]}"
    for s, d in zip(s_rows, d_rows):
        if s != d:
            return f"{s_names}: {s} / {d}"
        if [type(v) for v in s] != [type(v) for v in d]:
            return f"{s_names}: types {s} / {d}"
    return None
