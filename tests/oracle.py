"""Comparing a query with its SQL in DuckDB over the same tables."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def _text(v):
    if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
        return "\\N"
    return f"{v:.9g}" if isinstance(v, float) else str(list(v)) if hasattr(v, "tolist") and hasattr(v, "__len__") else str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(_text, r)) for r in frame.itertuples(index=False))


def same(spark, query, sql, sf_dir):
    got, want = query(spark, sf_dir).toPandas(), connect(sf_dir).execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert rows(got) == rows(want)
