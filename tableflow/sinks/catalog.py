"""Target tables made from the source schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession

from tableflow.functions.types import target_length, target_type
from tableflow.sinks.models import FOLDS
from tableflow.sinks.writers import DEFAULT_BUCKETS

# Key models of a target table.
MODELS = ("UNIQUE", "AGGREGATE", "DUPLICATE")


def _column(field: Mapping[str, object]) -> str:
    length = target_length(field)
    kind = f"VARCHAR({length})" if length else target_type(field).simpleString()
    return f"`{field['name']}` {kind}"


def column_types(fields: Sequence[Mapping[str, object]]) -> str:
    """Column list of a form's fields with the types a target is created with."""
    return ", ".join(map(_column, fields))


def create_statement(
    name: str,
    fields: Sequence[Mapping[str, object]],
    model: str = "UNIQUE",
    buckets: int = DEFAULT_BUCKETS,
    location: str | None = None,
    folds: Mapping[str, str] | None = None,
) -> str:
    """CREATE TABLE for a form's field list; keys, model and folds are kept as properties."""
    if not fields:
        raise ValueError("a table needs fields")
    if model not in MODELS:
        raise ValueError(f"table model {model!r}, expected one of {MODELS}")
    keys = [str(f["name"]) for f in fields if f.get("primaryKey")]
    folds = dict(folds or {})
    if model == "AGGREGATE":
        open_columns = {str(f["name"]) for f in fields} - set(keys) - set(folds)
        if open_columns or set(folds.values()) - set(FOLDS):
            raise ValueError(f"an aggregate table needs one of {sorted(FOLDS)} per value column: {sorted(open_columns)}")
    cluster = ", ".join(f"`{k}`" for k in keys or [str(fields[0]["name"])])
    properties = {"tableflow.model": model, "tableflow.keys": ",".join(keys)}
    properties |= {f"tableflow.fold.{c}": f for c, f in folds.items()}
    listed = ", ".join(f"'{k}' = '{v}'" for k, v in properties.items())
    place = f" LOCATION '{location}'" if location else ""
    return (
        f"CREATE TABLE IF NOT EXISTS {name} ({column_types(fields)}) USING parquet"
        f" CLUSTERED BY ({cluster}) INTO {buckets} BUCKETS{place} TBLPROPERTIES ({listed})"
    )


def ensure_table(
    spark: SparkSession,
    name: str,
    fields: Sequence[Mapping[str, object]],
    model: str = "UNIQUE",
    buckets: int = DEFAULT_BUCKETS,
    location: str | None = None,
    folds: Mapping[str, str] | None = None,
) -> bool:
    """Create the target unless it exists; says whether it was created."""
    statement = create_statement(name, fields, model, buckets, location, folds)
    if spark.catalog.tableExists(name):
        return False
    spark.sql(statement)
    return True
