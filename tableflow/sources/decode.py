"""Message bodies to columns, and the columns of a JSON log by inspection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.functions.types import form_schema

RAW_COLUMN = "data"

# Inferred type names, from narrow to wide. Any two numbers meet at the
# wider one; every other mix is a STRING.
INFERRED = ("BOOLEAN", "INT", "BIGINT", "DOUBLE", "ARRAY", "MAP", "STRING")

Schema = str | T.StructType | Sequence[Mapping[str, object]]


def as_schema(schema: Schema) -> T.StructType:
    if isinstance(schema, T.StructType):
        return schema
    if isinstance(schema, str):
        return T.StructType.fromDDL(schema)
    return form_schema(schema)


def decode(
    df: DataFrame, schema: Schema | None, fmt: str = "json", value: str = "value", keep: Sequence[str] = ()
) -> DataFrame:
    """Typed columns of a message body; a field that does not fit its type is null.

    Without a schema the whole body becomes one ``data`` column. ``keep`` names columns
    of the message itself to carry along.
    """
    body = F.col(value).cast("string")
    if not schema:
        return df.select(*keep, body.alias(RAW_COLUMN))
    fields = as_schema(schema)
    if fmt == "json":
        parsed = F.from_json(body, fields)
    elif fmt == "csv":
        parsed = F.from_csv(body, fields.toDDL())
    else:
        raise ValueError(f"format {fmt!r}, expected json or csv")
    return df.select(*keep, parsed.alias("_body")).select(*keep, "_body.*")


def _kind(shape: Column, number: Column) -> Column:
    """Type name of a JSON value by its variant type and, for a number, its text; null has none."""
    whole = number.try_cast("bigint")
    return (
        F.when(shape == "VOID", F.lit(None))
        .when(shape == "BOOLEAN", "BOOLEAN")
        .when(shape == "BIGINT", F.when(whole.between(-2147483648, 2147483647), "INT").otherwise("BIGINT"))
        .when(shape.startswith("DECIMAL") & shape.endswith(",0)") & (F.length(number) > 18), "BIGINT")
        .when(shape.startswith("DECIMAL") | shape.isin("DOUBLE", "FLOAT"), "DOUBLE")
        .when(shape.startswith("ARRAY"), "ARRAY")
        .when(shape.startswith("OBJECT"), "MAP")
        .otherwise("STRING")
    )


def infer_schema(df: DataFrame, value: str = "value") -> DataFrame:
    """``name, type, primaryKey`` of the top-level keys of a JSON log.

    Looks at all messages: one pass that keeps a few flags per key, so the shuffle
    carries one row per key and task. Bodies that are no JSON object are skipped.
    """
    bodies = df.select(F.col(value).cast("string").alias("_body"))
    explode = bodies.sparkSession.tvf.variant_explode(F.try_parse_json(F.col("_body").outer()))
    # Elements of an array have no key. Generating the facts computes each once per value.
    fields = bodies.lateralJoin(explode).where(F.col("key").isNotNull())
    shape = F.schema_of_variant("value")
    number = F.when(shape.startswith("BIGINT") | shape.startswith("DECIMAL"), F.col("value").cast("string"))
    found = fields.select("key", F.inline(F.array(F.struct(shape.alias("shape"), number.alias("number")))))
    values = found.select(F.col("key").alias("name"), _kind(F.col("shape"), F.col("number")).alias("kind"))
    seen = values.groupBy("name").agg(*[F.bool_or(F.col("kind") == k).alias(k) for k in INFERRED])
    has = {k: F.coalesce(F.col(k), F.lit(False)) for k in INFERRED}
    number = has["INT"] | has["BIGINT"] | has["DOUBLE"]
    groups = [number, has["BOOLEAN"], has["ARRAY"], has["MAP"], has["STRING"]]
    several = sum((g.cast("int") for g in groups[1:]), groups[0].cast("int")) > 1
    picked = F.when(several, "STRING")
    for kind in ("DOUBLE", "BIGINT", "INT", "BOOLEAN", "ARRAY", "MAP"):
        picked = picked.when(has[kind], kind)
    return seen.select("name", picked.otherwise("STRING").alias("type"), F.lit(False).alias("primaryKey"))


def encode(df: DataFrame, topic: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows as JSON messages: ``key, value, topic``, the columns Spark's Kafka writer takes."""
    key = F.to_json(F.struct(*keys)) if keys else F.lit(None).cast("string")
    return df.select(key.alias("key"), F.to_json(F.struct(*df.columns)).alias("value"), F.lit(topic).alias("topic"))


def encode_csv(df: DataFrame, topic: str) -> DataFrame:
    """Rows as CSV messages."""
    return df.select(
        F.lit(None).cast("string").alias("key"), F.to_csv(F.struct(*df.columns)).alias("value"), F.lit(topic).alias("topic")
    )
