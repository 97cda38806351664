"""Targets: what is written is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tableflow.plans.feed_queries import FEED, LIVE
from tableflow.plans.inputs import LOG_SCHEMA, change_feed, halves, log, table
from tableflow.plans.jobs import aggregate_to_sink, job_groups, run_job, run_statement_set, sync_tables
from tableflow.plans.registry import query
from tableflow.session import work_dir
from tableflow.sinks.bulk import bulk_load, read_loaded
from tableflow.sinks.catalog import ensure_table
from tableflow.sinks.keyed_table import KeyedTable, buckets_for
from tableflow.sinks.models import load_aggregate, load_duplicate, load_unique
from tableflow.sinks.upsert import read_upserted, sink_upsert
from tableflow.sinks.writers import BUCKET, sink_append, sink_files, sink_hash_buckets, sink_print
from tableflow.sources.changes import cdc_encode
from tableflow.sources.decode import decode, encode
from tableflow.sources.tables import stream_table
from tableflow.streaming.changelog import ChangelogJoin

UPSERTED = f"with {FEED}, {LIVE} select user_id, event_type, value from live where op <> 'd'"


@query("sink_append", "select * from supplier union all select * from supplier")
def append(spark, sf):
    path = work_dir(spark, "append")
    supplier = table(spark, sf, "supplier")
    for _ in range(2):
        sink_append(supplier, path)
    return spark.read.schema(supplier.schema).parquet(path)


@query("sink_upsert", UPSERTED)
def upsert(spark, sf):
    """The later half first: writes that come out of order do not undo newer ones."""
    path = work_dir(spark, "upsert")
    changes = change_feed(table(spark, sf, "events"))
    for part in reversed(halves(changes, "ts")):
        sink_upsert(part.drop("ts"), path, ["user_id"], ["event_id"], "op", buckets=buckets_for(changes))
    return read_upserted(spark, path).drop("event_id")


@query("sink_bulk_load", "select event_id, value from events where event_type <> 'error'")
def bulk(spark, sf):
    """Errors carry a value that is no number; the second try of the batch loads nothing."""
    path = work_dir(spark, "bulk")
    written = F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string"))
    batch = table(spark, sf, "events").select("event_id", written.alias("value"))
    fields = [{"name": "event_id", "type": "BIGINT", "primaryKey": True}, {"name": "value", "type": "DOUBLE"}]
    for _ in range(2):
        bulk_load(batch, 0, path, fields, "label", max_reject=0.5)
    return read_loaded(spark, path, fields)


@query(
    "load_unique",
    "select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
)
def unique(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", "ts")
    return load_unique(rows, ["user_id"], ["ts", "event_id"]).drop("ts")


@query(
    "load_aggregate",
    "select user_id, count(*) n, round(sum(value), 2) total, max(value) top from events group by 1",
)
def aggregate_model(spark, sf):
    path = work_dir(spark, "aggregate")
    rows = table(spark, sf, "events").select(
        "user_id", "ts", F.lit(1).cast("long").alias("n"), F.col("value").alias("total"), F.col("value").alias("top")
    )
    for i, part in enumerate(halves(rows, "ts")):
        folds = {"n": "sum", "total": "sum", "top": "max"}
        loaded = load_aggregate(part.drop("ts"), path, ["user_id"], folds, i, buckets_for(rows))
    return loaded.read().withColumn("total", F.round("total", 2))


@query("load_duplicate", "select user_id, event_id, value from events")
def duplicate(spark, sf):
    path = work_dir(spark, "duplicate")
    rows = table(spark, sf, "events").select("user_id", "event_id", "value")
    load_duplicate(rows, path, ["user_id"])
    return spark.read.schema(rows.schema).parquet(path)


@query(
    "sink_hash_buckets",
    "select o_orderkey, o_custkey, o_totalprice, 1::bigint places from orders",
)
def hash_buckets(spark, sf):
    """Every row, and in how many buckets its key is."""
    path = work_dir(spark, "buckets")
    sink_hash_buckets(table(spark, sf, "orders"), path, ["o_custkey"], n=10)
    written = spark.read.parquet(path)
    places = written.groupBy("o_custkey").agg(F.count_distinct(BUCKET).alias("places"))
    return written.join(places, "o_custkey").select("o_orderkey", "o_custkey", "o_totalprice", "places")


@query(
    "sink_files",
    "select f.fmt, supplier.* from supplier, (select unnest(['csv', 'json', 'parquet']) fmt) f",
)
def files(spark, sf):
    supplier = table(spark, sf, "supplier")
    out = None
    for fmt in ("csv", "json", "parquet"):
        path = work_dir(spark, f"files-{fmt}")
        sink_files(supplier, path, fmt)
        back = spark.read.schema(supplier.schema).option("header", True).format(fmt).load(path)
        back = back.select(F.lit(fmt).alias("fmt"), "*")
        out = back if out is None else out.unionAll(back)
    return out


@query("sink_log", "select event_id, user_id, value from events")
def to_log(spark, sf):
    path = work_dir(spark, "log")
    rows = table(spark, sf, "events").select("event_id", "user_id", "value")
    messages = encode(rows, "events", ["user_id"])
    sink_append(messages, path)
    return decode(spark.read.schema(messages.schema).parquet(path), rows.schema)


@query("sink_print", "select s_suppkey, s_name from supplier")
def printed(spark, sf):
    return sink_print(table(spark, sf, "supplier").select("s_suppkey", "s_name"))


@query("auto_create_table", "select s_suppkey, s_name, s_nationkey, cast(s_acctbal as decimal(12, 2)) s_acctbal from supplier")
def auto_create(spark, sf):
    fields = [
        {"name": "s_suppkey", "type": "BIGINT", "primaryKey": True},
        {"name": "s_name", "type": "STRING"},
        {"name": "s_nationkey", "type": "INT"},
        {"name": "s_acctbal", "type": "DECIMAL", "precision": 12, "scale": 2},
    ]
    name = f"supplier_{uuid.uuid4().hex}"
    path = work_dir(spark, "auto-create")
    made = [ensure_table(spark, name, fields, "UNIQUE", 10, path) for _ in range(2)]
    assert made == [True, False]
    rows = table(spark, sf, "supplier")
    rows.repartition(10, "s_suppkey").write.insertInto(name)
    return spark.table(name)


@query(
    "multi_sink",
    "select 'seg' sink, null::bigint id, null::bigint other, c_mktsegment name, count(*) n from customer group by 4 union all"
    " select 'copy', c_custkey, null, c_name, 1 from customer union all"
    " select 'join', o_orderkey, c_custkey, c_name, 1 from orders join customer on o_custkey = c_custkey",
)
def multi_sink(spark, sf):
    """Counts, a copy and a join as one job over two streams: all rows of the three targets."""
    base = work_dir(spark, "multi-sink")
    buckets = buckets_for(table(spark, sf, "orders"))
    join = ChangelogJoin(
        f"{base}/join",
        [("o_custkey", "c_custkey")],
        "inner",
        ["o_orderkey"],
        ["c_custkey"],
        ["o_orderkey"],
        ["c_custkey"],
        buckets=buckets,
    )

    def upserts(df):
        return df.withColumn("op", F.lit("u"))

    sources = {
        "orders": stream_table(spark, f"{sf}/orders.parquet"),
        "customer": stream_table(spark, f"{sf}/customer.parquet"),
    }
    sinks = {
        "seg": lambda parts, i: load_aggregate(
            parts["customer"].select("c_mktsegment", F.lit(1).cast("long").alias("n")),
            f"{base}/seg",
            ["c_mktsegment"],
            {"n": "sum"},
            i,
            buckets,
        ),
        "copy": lambda parts, i: sink_upsert(
            parts["customer"], f"{base}/copy", ["c_custkey"], ["c_custkey"], batch_id=i, buckets=buckets
        ),
        "join": lambda parts, i: join.apply({"l": upserts(parts["orders"]), "r": upserts(parts["customer"])}, i),
    }
    run_statement_set(sources, sinks, f"{base}/checkpoint")
    none, one = F.lit(None).cast("long"), F.lit(1).cast("long")
    frames = {
        "seg": KeyedTable(spark, f"{base}/seg").read().select(none, none, "c_mktsegment", "n"),
        "copy": read_upserted(spark, f"{base}/copy").select("c_custkey", none, "c_name", one),
        "join": join.result(spark).select("l_o_orderkey", "r_c_custkey", "r_c_name", one),
    }
    rows = [
        df.toDF("id", "other", "name", "n").select(F.lit(sink).alias("sink"), "*") for sink, df in frames.items()
    ]
    return rows[0].unionAll(rows[1]).unionAll(rows[2])


@query(
    "sync_tables",
    "select 'customer' t, c_custkey id, c_name name, c_acctbal amount from customer union all"
    " select 'supplier', s_suppkey, s_name, s_acctbal from supplier union all"
    " select 'orders', o_orderkey, o_orderstatus, o_totalprice from orders",
)
def sync(spark, sf):
    base = work_dir(spark, "sync")
    buckets = buckets_for(table(spark, sf, "orders"))
    keyed = {"name": "orders", "keys": ["o_orderkey"], "seq": ["o_orderdate"], "buckets": buckets}
    sync_tables(
        spark,
        ["customer", "supplier", keyed],
        {"path": sf, "suffix": ".parquet"},
        {"path": f"{base}/out", "checkpoint": f"{base}/checkpoint"},
    )
    frames = {
        "customer": spark.read.parquet(f"{base}/out/customer"),
        "supplier": spark.read.parquet(f"{base}/out/supplier"),
        "orders": read_upserted(spark, f"{base}/out/orders"),
    }
    picked = {
        "customer": ("c_custkey", "c_name", "c_acctbal"),
        "supplier": ("s_suppkey", "s_name", "s_acctbal"),
        "orders": ("o_orderkey", "o_orderstatus", "o_totalprice"),
    }
    rows = [
        frames[t].select(F.lit(t).alias("t"), F.col(a).alias("id"), F.col(b).alias("name"), F.col(c).alias("amount"))
        for t, (a, b, c) in picked.items()
    ]
    return rows[0].unionAll(rows[1]).unionAll(rows[2])


@query("agg_to_keyed_sink", "select o_custkey, count(*) n, round(sum(o_totalprice), 2) total from orders group by 1")
def keyed_sink(spark, sf):
    path = work_dir(spark, "agg-sink")
    aggs = {"n": ("count", "*"), "total": ("sum", "o_totalprice")}
    orders = table(spark, sf, "orders")
    aggregate_to_sink(orders, path, ["o_custkey"], aggs, buckets=buckets_for(orders))
    return read_upserted(spark, path).select("o_custkey", "n", F.round("total", 2).alias("total"))


@query("job_spec", "select event_id as id, value as amount from events")
def job(spark, sf):
    base = work_dir(spark, "job")
    events = table(spark, sf, "events")
    messages = log(stream_table(spark, f"{sf}/events.parquet", events.schema))
    spec = {
        "topics": "click,view,signup,purchase,error",
        "start_mode": "earliest-offset",
        "format": "json",
        "schema": LOG_SCHEMA,
        "mappings": [{"source": "event_id", "target": "id"}, {"source": "value", "target": "amount"}],
        "target": {"type": "files", "path": f"{base}/out"},
        "checkpoint": f"{base}/checkpoint",
    }
    run_job(spark, spec, messages)
    return spark.read.schema("id bigint, amount double").parquet(f"{base}/out")


def _change_form(spark, sf, base):
    """A form over envelopes of the user feed, and the envelopes as a stream."""
    events = table(spark, sf, "events")
    changes = change_feed(stream_table(spark, f"{sf}/events.parquet", events.schema))
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    messages = cdc_encode(changes, "op", ["user_id", "event_type", "value", "event_id"], millis)
    spec = {
        "source": "changes",
        "start_mode": "earliest-offset",
        "schema": "user_id bigint, event_type string, value double, event_id bigint",
        "mappings": [
            {"source": "user_id", "target": "id"},
            {"source": "event_type", "target": "kind"},
            {"source": "value", "target": "amount"},
            {"source": "event_id", "target": "change_no"},
        ],
        "target": {"type": "upsert", "path": f"{base}/out", "keys": ["id"], "seq": ["change_no"]},
        "checkpoint": f"{base}/checkpoint",
    }
    return spec, messages


@query("job_changes", f"with {FEED}, {LIVE} select user_id id, event_type kind, value amount from live where op <> 'd'")
def job_changes(spark, sf):
    """Change envelopes into a keyed target."""
    base = work_dir(spark, "job-changes")
    spec, messages = _change_form(spark, sf, base)
    run_job(spark, spec, messages)
    return read_upserted(spark, f"{base}/out").select("id", "kind", "amount")


@query(
    "job_changes_agg",
    f"with {FEED}, {LIVE} select event_type kind, count(*) n, max(value) top from live where op <> 'd' group by 1",
)
def job_changes_agg(spark, sf):
    """Change envelopes into groups that follow the changes."""
    spec, messages = _change_form(spark, sf, work_dir(spark, "job-changes-agg"))
    spec["aggregate"] = {"by": ["kind"], "aggs": {"n": ("count", "*"), "top": ("max", "amount")}}
    run_job(spark, spec, messages)
    return job_groups(spark, spec)
