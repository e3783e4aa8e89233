"""Side-by-side check of a registered query and its SQL."""

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duckdb_rows(sf_dir: str, sql: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    return names, cursor.fetchall()


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    return value


def normalized(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(spark, query, sql: str, sf_dir: str) -> str | None:
    """What differs, or None."""
    frame = query(spark, sf_dir)
    mine = [tuple(r) for r in frame.collect()]
    names, theirs = duckdb_rows(sf_dir, sql)
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(names)}"
    left, right = normalized(frame.columns, mine), normalized(names, theirs)
    if left != right:
        here, there = (left - right).most_common(2), (right - left).most_common(2)
        return f"{len(mine)} against {len(theirs)} rows; only here {here}; only there {there}"
    types = {n: type(v) for row in mine for n, v in zip(frame.columns, row) if v is not None}
    other = {n: type(v) for row in theirs for n, v in zip(names, row) if v is not None}
    if types != other:
        return f"types {types} against {other}"
    return None
