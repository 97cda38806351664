import pytest
from tests.conftest import rows
from pyspark.sql import types as T

from tableflow.functions.types import source_spark_type, source_type, spark_type, target_type
from tableflow.operators.project import cast_failures, cast_from_source, conform_to_sink, insert_columns, map_fields, text_preview
from tableflow.sources.decode import decode, encode, infer_schema


@pytest.mark.parametrize(
    "name, expected",
    [
        ("int(11)", "INT"),
        ("BIGINT(20) unsigned", "BIGINT"),
        ("bigint", "BIGINT"),
        ("tinyint(1)", "INT"),
        ("datetime(6)", "TIMESTAMP"),
        ("date", "DATE"),
        ("time", "TIME"),
        ("varchar(10)", "STRING"),
        ("point", "STRING"),
        ("decimal(12,4)", "DECIMAL"),
    ],
)
def test_source_types_by_exact_name(name, expected):
    assert source_type(name) == expected


def test_decimals_keep_their_digits():
    assert source_spark_type("decimal(12, 4)") == T.DecimalType(12, 4)
    assert spark_type("DECIMAL") == T.DecimalType(10, 0)
    assert target_type({"type": "decimal", "precision": 18, "scale": 2}) == T.DecimalType(18, 2)
    assert spark_type("TIMESTAMP(3)") == T.TimestampNTZType()
    assert spark_type("TIMESTAMP_LTZ(3)") == T.TimestampType()


def test_cast_from_source_counts_what_it_cannot_hold(spark):
    raw = spark.createDataFrame([("1", "3000000000"), ("x", "2"), (None, "y")], "a string, b string")
    types = {"a": "int", "b": "bigint"}
    assert rows(cast_from_source(raw, types)) == [(1, 3000000000), (None, 2), (None, None)]
    assert rows(cast_failures(raw, types)) == [(1, 1)]


def test_conform_splits_by_length_digits_and_key(spark):
    df = spark.createDataFrame(
        [(1, "ok", 1.25), (2, "too long", 1.0), (3, "ok", 1e9), (None, "ok", 1.0)], "id int, s string, d double"
    )
    fields = [
        {"name": "id", "type": "INT", "primaryKey": True},
        {"name": "s", "type": "STRING", "precision": 4},
        {"name": "d", "type": "DECIMAL", "precision": 6, "scale": 1},
    ]
    good, bad = conform_to_sink(df, fields)
    assert [(r["id"], str(r["d"])) for r in good.collect()] == [(1, "1.3")]
    assert sorted(r["_reason"] for r in bad.collect()) == [
        "d does not fit DECIMAL",
        "id is a key and is null",
        "s does not fit STRING",
    ]


def test_insert_columns_match_by_position(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    target = T.StructType.fromDDL("note string, id bigint, name string")
    assert rows(insert_columns(df, target, ["id", "name"])) == [(None, 1, "x")]
    with pytest.raises(ValueError):
        insert_columns(df, target, ["id"])
    with pytest.raises(ValueError):
        insert_columns(df, target, ["id", "nothing"])


def test_mapping_without_list_keeps_all(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert map_fields(df, []).columns == ["a", "b"]
    assert map_fields(df, [{"source": "b", "target": "order"}]).columns == ["order"]


def test_preview_marks_only_cut_texts(spark):
    df = spark.createDataFrame([("x" * 500,), ("é" * 501,)], "t string")
    assert rows(text_preview(df, "t")) == [("x" * 500, 500), ("é" * 500 + "...", 1002)]


JSON = [
    '{"i": 1, "b": 1, "f": 1, "s": "x", "t": true, "n": null, "l": [1], "m": {"a": 1}, "mix": 1, "big": 100000000000000000000}',
    '{"i": -5, "b": 3000000000, "f": 1.5, "s": null, "t": false, "l": [], "mix": "x", "w": 2.0}',
    "[1, 2]",
    "not json",
    "7",
    None,
]


def test_inference_widens_over_all_messages(spark):
    log = spark.createDataFrame([(v,) for v in JSON], "value string")
    found = {r["name"]: r["type"] for r in infer_schema(log).collect()}
    assert found == {
        "i": "INT",
        "b": "BIGINT",
        "f": "DOUBLE",
        "s": "STRING",
        "t": "BOOLEAN",
        "n": "STRING",
        "l": "ARRAY",
        "m": "MAP",
        "mix": "STRING",
        "big": "BIGINT",
        "w": "DOUBLE",
    }


def test_inference_from_one_message(spark):
    log = spark.createDataFrame([(JSON[0],)], "value string")
    found = {r["name"]: r["type"] for r in infer_schema(log).collect()}
    assert found["b"] == "INT" and found["mix"] == "INT" and not [r for r in infer_schema(log).collect() if r["primaryKey"]]


def test_decoding_gives_null_for_what_does_not_fit(spark):
    log = spark.createDataFrame([('{"id": 1, "n": 3000000000}',), ('{"id": "x"}',), ("broken",)], "value string")
    fields = [{"name": "id", "type": "INT"}, {"name": "n", "type": "INT"}]
    assert rows(decode(log, fields)) == [(1, None), (None, None), (None, None)]
    assert decode(log, None).columns == ["data"]
    with pytest.raises(ValueError):
        decode(log, fields, "avro")


def test_encode_then_decode(spark):
    df = spark.createDataFrame([(1, "a,b"), (2, 'q"q')], "id int, s string")
    messages = encode(df, "t", ["id"])
    assert rows(messages.select("key", "topic")) == [('{"id":1}', "t"), ('{"id":2}', "t")]
    assert rows(decode(messages, df.schema)) == rows(df)
