"""Newest per key, retention, status, lineage and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableflow.operators.keyed import (
    first_filled,
    latest_completed,
    latest_per,
    lineage,
    live_rows,
    merge_nonnull,
    newest_entry,
    page,
    prune_by_name,
    prune_to_latest,
    read_operations,
    reconcile,
    sort_time,
    status_counts,
    with_elapsed,
    with_latest_child,
)
from tableflow.plans.inputs import runs, table
from tableflow.plans.registry import query

# A moment after all test data, in milliseconds: 2025-01-01.
NOW = 1735689600000

RUNS = (
    "runs as (select o_orderkey, o_custkey, case o_orderstatus when 'F' then 'FINISHED' when 'O' then 'RUNNING'"
    " else 'CREATED' end state, epoch_ms(o_orderdate) as start, o_orderdate from orders)"
)
LINES = ["l_linenumber", "l_shipdate", "l_partkey"]


@query(
    "latest_per_name",
    f"with {RUNS}, named as (select coalesce(nullif(c_name, ''), nullif(cast(o_custkey as varchar), ''),"
    " cast(o_orderkey as varchar)) as name, o_orderkey, state, start, case when state = 'FINISHED' then start + 1000 end as \"end\""
    " from runs join customer on o_custkey = c_custkey) select name, o_orderkey, state, start, \"end\" from named"
    " qualify row_number() over (partition by name order by coalesce(\"end\", start, 0) desc, o_orderkey desc) = 1",
)
def latest_per_name(spark, sf):
    orders = runs(table(spark, sf, "orders"))
    customer = table(spark, sf, "customer").select("c_custkey", "c_name")
    named = orders.join(customer, orders.o_custkey == customer.c_custkey).withColumn(
        "name", first_filled("c_name", "o_custkey", "o_orderkey")
    )
    ended = F.when(F.col("state") == "FINISHED", F.col("start") + 1000)
    rows = named.select("name", "o_orderkey", "state", "start", ended.alias("end"))
    return latest_per(rows, ["name"], [sort_time("end", "start"), "o_orderkey"])


@query(
    "latest_child_and_count",
    "with c as (select l_orderkey, count(*) n, arg_max(l_partkey, (l_shipdate, l_linenumber, l_partkey)) latest"
    " from lineitem group by 1) select o_orderkey, latest, coalesce(n, 0) n from orders left join c on l_orderkey = o_orderkey",
)
def latest_child_and_count(spark, sf):
    parent = table(spark, sf, "orders").select("o_orderkey")
    order = ["l_shipdate", "l_linenumber", "l_partkey"]
    return with_latest_child(parent, table(spark, sf, "lineitem"), ("o_orderkey", "l_orderkey"), order, "l_partkey")


@query(
    "latest_completed",
    "select l_orderkey, l_partkey from lineitem where l_linestatus = 'F' qualify row_number()"
    " over (partition by l_orderkey order by l_linenumber desc, l_shipdate desc, l_partkey desc) = 1",
)
def completed(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linestatus", *LINES)
    return latest_completed(lines, "l_orderkey", LINES, F.col("l_linestatus") == "F").select("l_orderkey", "l_partkey")


PRUNED = (
    "select l_orderkey, l_linenumber, l_partkey from lineitem qualify row_number()"
    " over (partition by l_orderkey order by l_linenumber desc, l_shipdate desc, l_partkey desc) = 1"
)


@query("prune_to_latest", PRUNED)
def pruned(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", *LINES)
    return prune_to_latest(lines, "l_orderkey", LINES).select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "prune_by_name",
    "select coalesce(cast(o_custkey as varchar), 'unknown') as name, l_orderkey, l_partkey from lineitem"
    " left join (select * from orders where o_orderstatus <> 'P') on l_orderkey = o_orderkey"
    " qualify row_number() over (partition by coalesce(cast(o_custkey as varchar), 'unknown')"
    " order by l_shipdate desc, l_orderkey desc, l_partkey desc, l_linenumber desc) = 1",
)
def pruned_by_name(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", *LINES)
    known = table(spark, sf, "orders").where("o_orderstatus <> 'P'")
    order = ["l_shipdate", "l_orderkey", "l_partkey", "l_linenumber"]
    out = prune_by_name(lines, known, ("l_orderkey", "o_orderkey"), "o_custkey", order)
    return out.select("name", "l_orderkey", "l_partkey")


@query(
    "newest_of_history",
    "select * from (select l_orderkey, l_linenumber, l_shipdate, greatest(l_partkey, l_suppkey) as id,"
    " case when l_partkey >= l_suppkey then coalesce(nullif(l_returnflag, 'N'), l_linestatus)"
    " else nullif(l_linestatus, 'O') end as path from lineitem) where path is not null",
)
def newest_of_history(spark, sf):
    lines = table(spark, sf, "lineitem")
    nothing = F.lit(None).cast("string")
    history = F.array(
        F.struct(
            F.col("l_partkey").alias("id"),
            F.nullif("l_returnflag", F.lit("N")).alias("path"),
            F.col("l_linestatus").alias("external_path"),
        ),
        F.struct(
            F.col("l_suppkey").alias("id"),
            nothing.alias("path"),
            F.nullif("l_linestatus", F.lit("O")).alias("external_path"),
        ),
    )
    keys = ["l_orderkey", "l_linenumber", "l_shipdate"]
    runs_with_history = lines.select(*keys, history.alias("history"))
    return newest_entry(runs_with_history, "history", keys, ["path", "external_path"]).select(*keys, "id", "path")


@query(
    "reconcile_status",
    f"with {RUNS}, seen as (select l_orderkey, case when bool_or(l_linestatus = 'O') then 'RUNNING' else 'CLOSING' end status,"
    " min(epoch_ms(l_shipdate)) first_start from lineitem group by 1)"
    " select o_orderkey, case when status = 'RUNNING' then status when l_orderkey is null and state = 'RUNNING'"
    " then 'FAILED' else state end state,"
    " coalesce(case when state <> 'CREATED' then start end, first_start) as start from runs left join seen on o_orderkey = l_orderkey",
)
def reconciled(spark, sf):
    recorded = runs(table(spark, sf, "orders")).select(
        "o_orderkey", "state", F.when(F.col("state") != "CREATED", F.col("start")).alias("start")
    )
    running = F.bool_or(F.col("l_linestatus") == "O")
    observed = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.when(running, "RUNNING").otherwise("CLOSING").alias("status"),
        F.unix_millis(F.min("l_shipdate").cast("timestamp")).alias("start"),
    )
    return reconcile(recorded, observed, "o_orderkey")


@query(
    "status_counts",
    "select count(*) filter (o_orderstatus = 'F') finished, count(*) filter (o_orderstatus = 'O') running,"
    " count(*) filter (o_orderstatus = 'P') created from orders",
)
def counted(spark, sf):
    statuses = {"finished": "FINISHED", "running": "RUNNING", "created": "CREATED"}
    return status_counts(runs(table(spark, sf, "orders")), "state", statuses)


@query(
    "elapsed",
    f"with {RUNS} select o_orderkey, case when state = 'RUNNING' and start > 0 then {NOW} - start"
    " when state = 'FINISHED' then start // 1000 end duration from runs",
)
def elapsed(spark, sf):
    recorded = F.when(F.col("state") == "FINISHED", F.expr("start div 1000"))
    rows = runs(table(spark, sf, "orders")).withColumn("duration", recorded)
    return with_elapsed(rows, NOW).select("o_orderkey", "duration")


@query(
    "live_rows",
    f"with {RUNS} select o_orderkey, c_name, start from runs left join customer on o_custkey = c_custkey where state = 'RUNNING'",
)
def live(spark, sf):
    observed = runs(table(spark, sf, "orders"))
    recorded = table(spark, sf, "customer").select("c_custkey", "c_name")
    return live_rows(observed, recorded, ("o_custkey", "c_custkey"), "state", "start").select("o_orderkey", "c_name", "start")


@query(
    "page",
    "select o_orderkey, (select count(*) from orders) total from orders order by o_orderdate desc, o_orderkey desc"
    " limit 20 offset 40",
)
def paged(spark, sf):
    orders = table(spark, sf, "orders")
    order = [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]
    return page(orders, order, 40, 20).select("o_orderkey", "total")


@query(
    "resume_chain",
    "select conv_id || ':' || turn as id, conv_id || ':0' as root, cast(turn as int) depth from conversations",
)
def resume_chain(spark, sf):
    # Every turn of a conversation goes on from the one before it.
    turns = table(spark, sf, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("id"), F.concat_ws(":", "conv_id", F.col("turn") - 1).alias("parent")
    )
    return lineage(turns, "id", "parent")


@query(
    "operation_log",
    "select event_id, user_id, cast(json_extract(props, '$.k') as int) k from events where event_type = 'error'",
)
def operations(spark, sf):
    rows = table(spark, sf, "events").where("event_type = 'error'").select("event_id", "user_id", "props")
    return read_operations(rows, "props", {"k": "int"}).drop("props")


@query(
    "merge_nonnull",
    "select coalesce(c_custkey, user_id) c_custkey, coalesce(nullif(v, 'signup'), c_mktsegment) v"
    " from customer full join (select user_id, arg_max(event_type, event_id) v from events group by 1) on user_id = c_custkey",
)
def merged(spark, sf):
    old = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("v"))
    events = table(spark, sf, "events").groupBy(F.col("user_id").alias("c_custkey"))
    new = events.agg(F.max_by("event_type", "event_id").alias("v"))
    new = new.withColumn("v", F.when(F.col("v") != "signup", F.col("v")).otherwise(""))
    return merge_nonnull(old, new, ["c_custkey"])
