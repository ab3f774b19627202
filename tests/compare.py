"""Compare a query with its SQL twin in DuckDB, order aside."""

import math
from datetime import datetime

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, list | tuple):
        return repr([plain(v) for v in value])
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def duck(sf_dir, sql):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(names)
    return order, sorted((tuple(plain(row[names.index(c)]) for c in order) for row in found.fetchall()), key=repr)


def spark_rows(df):
    order = sorted(df.columns)
    return order, sorted((tuple(plain(row[c]) for c in order) for row in df.collect()), key=repr)


def assert_same(df, sf_dir, sql):
    columns, rows = spark_rows(df)
    expected_columns, expected = duck(sf_dir, sql)
    assert columns == expected_columns
    assert len(rows) == len(expected)
    assert rows == expected
