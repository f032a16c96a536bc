"""Runs a query beside its SQL and compares the rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) == "<NA>":
            return None
        return int(v) if isinstance(v, float) and v.is_integer() else v

    columns = sorted(frame.columns)
    return sorted(repr([plain(v) for v in row]) for row in frame[columns].astype(object).values.tolist())


def by_sql(sql, sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return db.execute(sql).df()
