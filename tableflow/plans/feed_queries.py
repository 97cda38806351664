"""Change feeds: snapshot and changes, envelopes, joins and aggregates that follow changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableflow.operators.changelog import changelog_join
from tableflow.plans.inputs import change_feed, halves, naive, order_feed, table, zoned
from tableflow.plans.registry import query
from tableflow.session import work_dir
from tableflow.sinks.keyed_table import buckets_for
from tableflow.sources.changes import (
    by_chunk,
    cdc_decode,
    cdc_encode,
    cdc_incremental_snapshot,
    cdc_initial,
    key_splits,
    with_server_zone,
)
from tableflow.sources.tables import stream_slices
from tableflow.streaming.changelog import ChangelogJoin, tagged, untagged
from tableflow.streaming.runner import drain, read_output
from tableflow.streaming.signed import grouped, joined, plain, settled, signed

FEED = (
    "feed as (select user_id, event_type, value, case when event_type = 'error' then 'd' else 'u' end op, ts, event_id"
    " from events)"
)
LIVE = "live as (select * from feed qualify row_number() over (partition by user_id order by event_id desc) = 1)"
ORDER_LIVE = (
    "placed as (select o_custkey, o_orderpriority, o_totalprice, o_orderstatus from orders"
    " qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1)"
)

INITIAL = (
    f"with {FEED}, {LIVE}, snap as (select c_custkey user_id, c_mktsegment event_type, c_acctbal value from customer)"
    " select coalesce(l.user_id, s.user_id) user_id,"
    " case when l.user_id is null then s.event_type else l.event_type end event_type,"
    ' case when l.user_id is null then s.value else l.value end "value"'
    " from snap s full join live l on s.user_id = l.user_id where l.op is distinct from 'd'"
)


def _snapshot(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("event_type"), F.col("c_acctbal").alias("value")
    )


def _feed(spark, sf):
    return change_feed(table(spark, sf, "events"))


@query("cdc_initial", INITIAL)
def initial(spark, sf):
    changes = _feed(spark, sf).drop("ts")
    return cdc_initial(_snapshot(spark, sf), changes, ["user_id"], ["event_id"])


@query("cdc_incremental_snapshot", INITIAL)
def incremental(spark, sf):
    """Each chunk is read at its own moment and then holds the changes up to there."""
    changes = _feed(spark, sf).drop("ts")
    snapshot = _snapshot(spark, sf)
    chunks = 4
    splits = key_splits(snapshot, "user_id", chunks)
    last = changes.agg(F.max("event_id").alias("last")).first()["last"]
    marks = {i: (last * (i + 1) // (chunks + 1),) for i in range(chunks)}
    mark = by_chunk(F.col("user_id"), splits, [F.lit(marks[i][0]) for i in range(len(splits) + 1)])
    as_read = cdc_initial(snapshot, changes.where(F.col("event_id") <= mark), ["user_id"], ["event_id"])
    return cdc_incremental_snapshot(as_read, changes, ["user_id"], ["event_id"], splits, marks)


@query("cdc_decode", f"with {FEED} select user_id, op, event_type, event_id, epoch_us(ts) // 1000 ts_ms from feed")
def decoded(spark, sf):
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    messages = cdc_encode(_feed(spark, sf), "op", ["user_id", "event_type", "event_id"], millis)
    return cdc_decode(messages, "user_id bigint, event_type string, event_id bigint")


@query("cdc_time_zone", "select o_orderkey, o_orderdate - interval 8 hour utc from orders")
def zone(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("utc"))
    return with_server_zone(orders, ["utc"], "Asia/Shanghai")


def _in_batches(spark, parts, name, schema, target):
    """Feed the parts to a ``foreachBatch`` target as one batch each, over restarts of one query."""
    base = work_dir(spark, name)
    stream = stream_slices(spark, f"{base}/in", schema)
    for i, part in enumerate(parts):
        part.write.parquet(f"{base}/in/part={i}")
        drain(stream, f"{base}/checkpoint", each_batch=target)


AGGS = {
    "n": ("count", "*"),
    "s": ("sum", "value"),
    "mean": ("avg", "value"),
    "lo": ("min", "value"),
    "hi": ("max", "value"),
}
AGGS_SQL = "count(*) n, round(sum(value), 2) s, round(avg(value), {digits}) mean, min(value) lo, max(value) hi"


def _stand(spark, parts, name, build):
    """The rows that stand when a feed has run over a stream that gets the parts one batch after another, over restarts.

    ``build`` makes the feed from the stream of the parts' rows.
    """
    base = work_dir(spark, name)
    feed = build(stream_slices(spark, f"{base}/in", parts[0].schema))
    for i, part in enumerate(parts):
        part.write.parquet(f"{base}/in/part={i}")
        drain(feed, f"{base}/checkpoint", path=f"{base}/out")
    return settled(read_output(spark, f"{base}/out", feed))


def _rounded(df, digits=8):
    return df.withColumns({"s": F.round("s", 2), "mean": F.round("mean", digits)})


@query("changelog_agg", f"with {FEED}, {LIVE} select event_type, {AGGS_SQL.format(digits=4)} from live where op <> 'd' group by 1")
def aggregated(spark, sf):
    """Users move between groups and leave them from one batch to the next."""

    def build(stream):
        return grouped(signed(stream, ["user_id"], ["event_id"]), ["event_type"], AGGS)

    return _rounded(_stand(spark, halves(_feed(spark, sf), "ts"), "changelog-agg", build), 4)


@query(
    "feed_join_agg",
    f"with {FEED}, {LIVE} select n_name, {AGGS_SQL.format(digits=8)} from (select * from live where op <> 'd')"
    " join (select * from supplier where s_acctbal >= 0) on user_id = s_suppkey join nation on s_nationkey = n_nationkey"
    " group by 1",
)
def join_then_aggregate(spark, sf):
    """An aggregate over a join of three feeds: users change, suppliers go, nations come in the second batch."""
    users = halves(_feed(spark, sf), "ts")
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    there = supplier.withColumns({"op": F.lit("u"), "at": F.lit(1)})
    gone = supplier.where("s_acctbal < 0").withColumns({"op": F.lit("d"), "at": F.lit(2)})
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    late = F.col("n_nationkey") % 2 == 0
    parts = [
        tagged({"u": users[0], "s": there, "n": nation.where(~late)}),
        tagged({"u": users[1], "s": gone, "n": nation.where(late)}),
    ]

    def build(stream):
        user = signed(untagged(stream, "u"), ["user_id"], ["event_id"])
        from_where = signed(untagged(stream, "s"), ["s_suppkey"], ["at"])
        both = joined(user, from_where, [("user_id", "s_suppkey")], prefixes=("", ""))
        three = joined(both, plain(untagged(stream, "n")), [("s_nationkey", "n_nationkey")], prefixes=("", ""))
        return grouped(three, ["n_name"], AGGS)

    return _rounded(_stand(spark, parts, "feed-join-agg", build))


def _windows_query(name, size, slide):
    hours = range(0, size, slide)
    starts = " union all ".join(
        f"select time_bucket(interval {slide} hour, ts) - interval {h} hour w, value from live where op <> 'd'" for h in hours
    )

    @query(name, f"with {FEED}, {LIVE} select w window_start, w + interval {size} hour window_end, {AGGS_SQL.format(digits=8)} from ({starts}) group by 1")
    def run(spark, sf):
        """Users leave a window when a later event moves them to another."""

        def build(stream):
            at = F.window("ts", f"{size} hours", f"{slide} hours")
            rows = signed(zoned(stream, "ts"), ["user_id"], ["event_id"]).withColumn("w", at)
            rows = rows.withColumns({"window_start": F.col("w.start"), "window_end": F.col("w.end")}).drop("w")
            return grouped(rows, ["window_start", "window_end"], AGGS, until="window_end", delay="60 days")

        found = _stand(spark, halves(_feed(spark, sf), "ts"), name, build)
        return _rounded(naive(found, "window_start", "window_end"))


_windows_query("feed_tumble", 6, 6)
_windows_query("feed_hop", 6, 2)

LIFETIME = 12
# What a feed still knows at the watermark, which is the newest time of the side that is behind.
TOUCHED = (
    f"{FEED}, buyers as (select * from feed where event_type = 'purchase'), others as (select * from feed where event_type <> 'purchase'),"
    " mark as (select least((select max(ts) from buyers), (select max(ts) from others)) - interval {hours} hour since),"
    " l as (select * from others qualify row_number() over (partition by user_id order by event_id desc) = 1),"
    " r as (select * from buyers qualify row_number() over (partition by user_id order by event_id desc) = 1)"
)


@query(
    "changelog_join_ttl",
    f"with {TOUCHED.format(hours=LIFETIME)} select l.user_id id, l.event_type, l.value, r.value paid from l join r using (user_id), mark"
    " where l.op <> 'd' and l.ts > since and r.ts > since",
)
def join_with_lifetime(spark, sf):
    """Both sides forget users that had no event of theirs for twelve hours."""

    def build(stream):
        rows = zoned(stream, "ts")
        bought = F.col("event_type") == "purchase"
        sides = [
            signed(rows.where(side), ["user_id"], ["event_id"], time="ts", lifetime=LIFETIME) for side in (~bought, bought)
        ]
        return joined(*sides, [("user_id", "user_id")])

    found = _stand(spark, halves(_feed(spark, sf), "ts"), "join-ttl", build)
    return found.select(
        F.col("l_user_id").alias("id"),
        F.col("l_event_type").alias("event_type"),
        F.col("l_value").alias("value"),
        F.col("r_value").alias("paid"),
    )


CHANGELOG_JOIN = (
    f"with {FEED}, {LIVE}, {ORDER_LIVE} select coalesce(user_id, o_custkey) id, event_type lt, o_orderpriority rt"
    " from (select * from live where op <> 'd') {how} join (select * from placed where o_orderstatus <> 'P')"
    " on user_id = o_custkey"
)


def _named(df, left, right):
    return df.select(
        F.coalesce(F.col(left[0]), F.col(right[0])).alias("id"), F.col(left[1]).alias("lt"), F.col(right[1]).alias("rt")
    )


@query("changelog_join", CHANGELOG_JOIN.replace("{how}", "full"))
def kept_join(spark, sf):
    """Both feeds in two batches: rows find, change and lose their partners."""
    left = _feed(spark, sf)
    right = order_feed(table(spark, sf, "orders"))
    target = ChangelogJoin(
        work_dir(spark, "changelog-join"),
        [("user_id", "o_custkey")],
        "full",
        ["user_id"],
        ["o_custkey"],
        ["event_id"],
        ["o_orderdate", "o_orderkey"],
        buckets=max(buckets_for(left), buckets_for(right)),
    )
    cut = F.col("o_orderdate") < F.to_timestamp_ntz(F.lit("1998-01-01"))
    first, second = halves(left, "ts")
    parts = [tagged({"l": first, "r": right.where(cut)}), tagged({"l": second, "r": right.where(~cut)})]
    _in_batches(spark, parts, "changelog-join-feed", parts[0].schema, target)
    return _named(target.result(spark), ("l_user_id", "l_event_type"), ("r_o_custkey", "r_o_orderpriority"))


def _table_form(how):
    @query(f"changelog_join_{how}", CHANGELOG_JOIN.replace("{how}", how))
    def run(spark, sf):
        out = changelog_join(
            _feed(spark, sf).drop("ts"),
            order_feed(table(spark, sf, "orders")),
            [("user_id", "o_custkey")],
            how,
            ["user_id"],
            ["o_custkey"],
            ["event_id"],
            ["o_orderdate", "o_orderkey"],
        )
        return _named(out, ("user_id", "event_type"), ("o_custkey", "o_orderpriority"))


for _how in ("inner", "left", "right"):
    _table_form(_how)
