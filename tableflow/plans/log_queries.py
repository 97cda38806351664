"""Message logs and their decoding, generated rows, key ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tableflow.plans.inputs import LOG_SCHEMA, log, table
from tableflow.plans.registry import query
from tableflow.session import work_dir
from tableflow.sources.changes import key_splits
from tableflow.sources.decode import decode, encode_csv, infer_schema
from tableflow.sources.group_offsets import GroupOffsets
from tableflow.sources.logs import end_positions, scan_log, topic_list
from tableflow.sources.tables import key_ranges, stream_slices
from tableflow.streaming.runner import batch_folders

LOG = (
    "log as (select event_type topic, cast(user_id % 3 as int) part, event_id off, ts, event_id, user_id, event_type,"
    " value, props from events)"
)


def _log(spark, sf):
    return log(table(spark, sf, "events"))


def _positions(df):
    return df.select("topic", F.col("partition").alias("part"), F.col("offset").alias("off"))


@query("log_earliest", f"with {LOG} select topic, part, off from log")
def earliest(spark, sf):
    return _positions(scan_log(_log(spark, sf), "earliest-offset"))


@query(
    "log_latest",
    f"with {LOG}, e as (select topic, part, max(off) + 1 n from log where ts < timestamp '2024-01-15' group by 1, 2)"
    " select topic, part, off from log left join e using (topic, part) where off >= coalesce(n, 0)",
)
def latest(spark, sf):
    messages = _log(spark, sf)
    at_start = end_positions(messages.where("timestamp < timestamp_ntz'2024-01-15'"))
    return _positions(scan_log(messages, None, at=at_start))


@query(
    "log_group",
    f"with {LOG}, c as (select topic, part, max(off) + 1 n from log where ts < timestamp '2024-01-10' and topic <> 'view'"
    " group by 1, 2) select topic, part, off from log left join c using (topic, part) where off >= coalesce(n, 0)",
)
def group(spark, sf):
    """A job of the group reads and commits; another one goes on where it ended."""
    messages = _log(spark, sf)
    base = work_dir(spark, "log-group")
    ledger = GroupOffsets(spark, f"{base}/offsets", "readers")
    stream = stream_slices(spark, f"{base}/in", messages.schema)
    early = messages.where("timestamp < timestamp_ntz'2024-01-10' and topic <> 'view'")
    early.write.parquet(f"{base}/in/part=0")
    ledger.run(stream, "first", f"{base}/checkpoint-first", batch_folders(f"{base}/first"))
    second = stream_slices(spark, f"{base}/all", messages.schema)
    messages.write.parquet(f"{base}/all/part=0")
    rest = scan_log(second, "group-offsets", committed=ledger.committed())
    ledger.run(rest, "second", f"{base}/checkpoint-second", batch_folders(f"{base}/second"))
    return _positions(spark.read.schema(messages.schema).parquet(f"{base}/second"))


@query(
    "log_timestamp",
    f"with {LOG}, s as (select topic, part, min(off) n from log where ts >= timestamp '2024-01-15' group by 1, 2)"
    " select topic, part, off from log join s using (topic, part) where off >= n",
)
def since(spark, sf):
    return _positions(scan_log(_log(spark, sf), "timestamp", at="2024-01-15 00:00:00"))


@query(
    "log_specific",
    f"with {LOG} select topic, part, off from log where off >= case part when 0 then 5 when 1 then 10 else 0 end",
)
def specific(spark, sf):
    return _positions(scan_log(_log(spark, sf), "specific-offsets", offsets={0: 5, 1: 10}))


@query("log_multi_topic", f"with {LOG} select topic, part, off from log where topic in ('click', 'view')")
def several_topics(spark, sf):
    return _positions(scan_log(_log(spark, sf), "earliest", topics="click, view"))


@query("topic_list", f"with {LOG} select distinct topic from log")
def topics(spark, sf):
    messages = _log(spark, sf)
    internal = messages.withColumn("topic", F.concat(F.lit("__"), "topic"))
    return topic_list(messages.unionByName(internal))


@query("decode_json", f"with {LOG} select off, event_id, user_id, event_type, value, props from log")
def decode_json(spark, sf):
    return decode(_log(spark, sf), LOG_SCHEMA, keep=["offset"]).withColumnRenamed("offset", "off")


@query("decode_csv", "select event_id, user_id, event_type, value from events")
def decode_csv(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    fields = [
        {"name": "event_id", "type": "BIGINT"},
        {"name": "user_id", "type": "BIGINT"},
        {"name": "event_type", "type": "STRING"},
        {"name": "value", "type": "DOUBLE"},
    ]
    return decode(encode_csv(rows, "events"), fields, "csv")


@query("decode_raw", 'select props as "data" from events')
def decode_raw(spark, sf):
    return decode(table(spark, sf, "events").select(F.col("props").alias("value")), None)


@query(
    "infer_json_schema",
    "select 'event_id' as name, case when max(event_id) < 2147483648 then 'INT' else 'BIGINT' end as type,"
    ' false as "primaryKey" from events'
    " union all select 'user_id', case when max(user_id) < 2147483648 then 'INT' else 'BIGINT' end, false from events"
    " union all select 'event_type', 'STRING', false union all select 'value', 'DOUBLE', false"
    " union all select 'props', 'STRING', false",
)
def infer_json_schema(spark, sf):
    return infer_schema(_log(spark, sf))


@query("jdbc_key_ranges", "select o_orderkey, o_custkey from orders")
def ranges(spark, sf):
    """The ranges a partitioned table read is cut into, put together again."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    parts = [orders.where(clause) for clause in key_ranges("o_custkey", key_splits(orders, "o_custkey", 4))]
    return reduce(lambda a, b: a.unionAll(b), parts)
