"""Type names of source databases and of job forms, as Spark types."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Type names of source columns and the engine type each maps to.
SOURCE_TYPES = {
    "tinyint": "INT",
    "smallint": "INT",
    "mediumint": "INT",
    "int": "INT",
    "integer": "INT",
    "bigint": "BIGINT",
    "float": "FLOAT",
    "double": "DOUBLE",
    "decimal": "DECIMAL",
    "bool": "BOOLEAN",
    "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
    "datetime": "TIMESTAMP",
    "date": "DATE",
    "time": "TIME",
}

# Engine type names and the Spark type of each.
SPARK_TYPES = {
    "STRING": T.StringType(),
    "INT": T.IntegerType(),
    "INTEGER": T.IntegerType(),
    "BIGINT": T.LongType(),
    "FLOAT": T.FloatType(),
    "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "TIMESTAMP": T.TimestampNTZType(),
    "TIMESTAMP_LTZ": T.TimestampType(),
    "DATE": T.DateType(),
    "TIME": T.TimeType(),
    "ARRAY": T.VariantType(),
    "MAP": T.VariantType(),
}

# What a target column gets when the form leaves these open.
DEFAULT_LENGTH = 255
DEFAULT_PRECISION = 10
DEFAULT_SCALE = 0

_NAME = re.compile(r"\s*([A-Za-z_]+)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?")


def _parts(name: str) -> tuple[str, int | None, int | None]:
    found = _NAME.match(name)
    if not found:
        return "", None, None
    word, precision, scale = found.groups()
    return word, int(precision) if precision else None, int(scale) if scale else None


def source_type(name: str) -> str:
    """Engine type of a source column: the exact name decides, anything unknown is STRING."""
    word, _, _ = _parts(name)
    return SOURCE_TYPES.get(word.lower(), "STRING")


def spark_type(name: str) -> T.DataType:
    """Spark type of an engine type name such as ``BIGINT``, ``TIMESTAMP(3)`` or ``DECIMAL(12, 2)``."""
    word, precision, scale = _parts(name)
    word = word.upper()
    if word == "DECIMAL":
        return T.DecimalType(precision or DEFAULT_PRECISION, scale if scale is not None else DEFAULT_SCALE)
    return SPARK_TYPES.get(word, T.StringType())


def source_spark_type(name: str) -> T.DataType:
    """Spark type of a source type name; a decimal keeps its precision and scale."""
    _, precision, scale = _parts(name)
    engine = source_type(name)
    if engine == "DECIMAL":
        return T.DecimalType(precision or DEFAULT_PRECISION, scale if scale is not None else DEFAULT_SCALE)
    return SPARK_TYPES[engine]


def form_schema(fields: Sequence[Mapping[str, object]]) -> T.StructType:
    """Schema of a form's field list ``[{"name": ..., "type": ...}, ...]``."""
    return T.StructType([T.StructField(str(f["name"]), spark_type(str(f["type"]))) for f in fields])


def target_type(field: Mapping[str, object]) -> T.DataType:
    """Type a target column is created with: every timestamp is stored without a zone."""
    word = _parts(str(field["type"]))[0].upper()
    if word == "DECIMAL":
        return T.DecimalType(
            int(field.get("precision") or DEFAULT_PRECISION), int(field.get("scale") or DEFAULT_SCALE)
        )
    if word in ("TIMESTAMP", "TIMESTAMP_LTZ"):
        return T.TimestampNTZType()
    return spark_type(str(field["type"]))


def target_length(field: Mapping[str, object]) -> int | None:
    """Longest text a target column takes, None for other types."""
    if _parts(str(field["type"]))[0].upper() != "STRING":
        return None
    return int(field.get("precision") or DEFAULT_LENGTH)


def fitted(field: Mapping[str, object]) -> tuple[Column, Column]:
    """The value as the target stores it, and a reason where it does not fit (else null)."""
    name = str(field["name"])
    raw = F.col(f"`{name}`")
    value = raw.try_cast(target_type(field))
    length = target_length(field)
    fits = value.isNotNull() if length is None else F.length(value) <= length
    reason = F.when(raw.isNotNull() & ~fits, F.lit(f"{name} does not fit {field['type']}"))
    if field.get("primaryKey"):
        reason = F.coalesce(reason, F.when(raw.isNull(), F.lit(f"{name} is a key and is null")))
    return value.alias(name), reason
