"""Compares a registered query with its SQL on the same parquet files."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def rows_of(table):
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return names, sorted((tuple(normal(v) for v in row) for row in zip(*columns)), key=repr)


def kinds(table):
    """Column types, with the ones that differ only in form taken as equal."""
    out = {}
    for field in table.schema:
        kind = str(field.type).replace("large_string", "string")
        out[field.name] = kind
    return out


def compare(con, frame, sql):
    """None when equal, else what differs."""
    got = frame.toArrow()
    want = con.sql(sql).to_arrow_table()
    if kinds(got) != kinds(want):
        return f"types {kinds(got)} != {kinds(want)}"
    names, a = rows_of(got)
    _, b = rows_of(want)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    if not a:
        return "no rows on either side"
    for x, y in zip(a, b):
        if x != y:
            return f"{names}: {x} != {y}"
    return None
