"""Runs a query and its SQL on the same tables."""

import os

import duckdb


def views(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(frame):
    def cell(v):
        if v is None or v != v:
            return "NULL"
        return f"{v:.6f}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    return sorted(tuple(cell(r[c]) for c in sorted(frame.columns)) for r in frame.to_dict("records"))


def agrees(query, sql, spark, sf_dir):
    ours, theirs = query(spark, sf_dir).toPandas(), views(sf_dir).sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
