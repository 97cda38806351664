"""Batched writes to relational tables."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableflow.sinks.catalog import column_types
from tableflow.sources.changes import DELETE

# Rows per batch and tries of a JDBC target.
BATCH_ROWS = 100
RETRIES = 3


QUOTES = {"mysql": "``", "sqlserver": "[]"}


def quoted(dialect: str, name: str) -> str:
    """A column name as the database takes any name, reserved words included."""
    begin, end = QUOTES.get(dialect, '""')
    return begin + name.replace(end, end * 2) + end


def merge_statement(dialect: str, table: str, staging: str, columns: Sequence[str], keys: Sequence[str]) -> str:
    """Statement that merges a staging table into a keyed table."""
    columns, keys = ([quoted(dialect, c) for c in names] for names in (columns, keys))
    listed = ", ".join(columns)
    values = [c for c in columns if c not in keys]
    if dialect == "mysql":
        update = ", ".join(f"{c} = VALUES({c})" for c in values or keys)
        return f"INSERT INTO {table} ({listed}) SELECT {listed} FROM {staging} ON DUPLICATE KEY UPDATE {update}"
    if dialect == "postgresql":
        action = "DO UPDATE SET " + ", ".join(f"{c} = EXCLUDED.{c}" for c in values) if values else "DO NOTHING"
        return f"INSERT INTO {table} ({listed}) SELECT {listed} FROM {staging} ON CONFLICT ({', '.join(keys)}) {action}"
    on = " AND ".join(f"t.{k} = s.{k}" for k in keys)
    update = f" WHEN MATCHED THEN UPDATE SET {', '.join(f't.{c} = s.{c}' for c in values)}" if values else ""
    given = ", ".join(f"s.{c}" for c in columns)
    text = f"MERGE INTO {table} t USING {staging} s ON ({on}){update} WHEN NOT MATCHED THEN INSERT ({listed}) VALUES ({given})"
    return text + ";" if dialect == "sqlserver" else text


def delete_statement(dialect: str, table: str, staging: str, keys: Sequence[str]) -> str:
    """Statement that removes the rows of a keyed table that a staging table lists."""
    keys = [quoted(dialect, k) for k in keys]
    same = " AND ".join(f"{staging}.{k} = {table}.{k}" for k in keys)
    return f"DELETE FROM {table} WHERE EXISTS (SELECT 1 FROM {staging} WHERE {same})"


def retried(action: Callable[[], None], retries: int, pause: float = 1.0) -> None:
    for left in range(retries, -1, -1):
        try:
            return action()
        except Exception:
            if not left:
                raise
            time.sleep(pause)


def _execute(spark, url: str, statements: Sequence[str], options: dict[str, str]) -> None:
    """Run statements on the target in one transaction."""
    jvm = spark._jvm
    if "driver" in options:
        jvm.java.lang.Class.forName(options["driver"])
    properties = jvm.java.util.Properties()
    for name, value in options.items():
        properties.setProperty(name, value)
    connection = jvm.java.sql.DriverManager.getConnection(url, properties)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        for text in statements:
            statement.executeUpdate(text)
        connection.commit()
    finally:
        connection.close()


def sink_jdbc(
    batch: DataFrame,
    url: str,
    table: str,
    keys: Sequence[str] | None = None,
    op: str | None = None,
    fields: Sequence[Mapping[str, object]] | None = None,
    batch_rows: int = BATCH_ROWS,
    retries: int = RETRIES,
    connections: int = 16,
    **options: str,
) -> None:
    """Write a batch to a relational table; with ``keys`` it is merged by key.

    Without keys rows are appended and a failed write is not tried again as a whole,
    since part of it may be in the table. With keys the batch, one row per key
    (``load_unique``), replaces staging tables, which can be repeated; the target then
    takes over upserts and, where ``op`` says so, deletes in one transaction. ``fields``
    gives the text lengths and decimal digits of a table that is created; other types follow
    Spark's dialect for the database.
    """

    def writer(rows: DataFrame, name: str):
        # A partition per connection; without a shuffle all that made the rows would run in so few tasks.
        out = rows.repartition(connections).write.format("jdbc").options(**options).option("url", url).option("dbtable", name)
        if fields:
            # Text lengths and decimal digits only: names of other types differ between databases.
            sized = [f for f in fields if f["name"] in rows.columns and str(f["type"]).upper() in ("STRING", "DECIMAL")]
            out = out.option("createTableColumnTypes", column_types(sized))
        return out.option("batchsize", batch_rows).option("numPartitions", connections)

    if not keys:
        writer(batch, table).mode("append").save()
        return
    dialect = url.split(":")[1]
    upserts, gone = batch, None
    if op:
        upserts = batch.where(~F.col(op).eqNullSafe(DELETE)).drop(op)
        gone = batch.where(F.col(op).eqNullSafe(DELETE)).select(*keys)

    def write() -> None:
        staging, removed = f"{table}_staging", f"{table}_removed"
        writer(upserts, staging).option("truncate", True).mode("overwrite").save()
        statements = [merge_statement(dialect, table, staging, upserts.columns, keys)]
        if gone is not None:
            writer(gone, removed).option("truncate", True).mode("overwrite").save()
            statements.append(delete_statement(dialect, table, removed, keys))
        _execute(batch.sparkSession, url, statements, options)

    retried(write, retries)
