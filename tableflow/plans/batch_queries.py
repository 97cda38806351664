"""Projections, joins, aggregates, windows and custom SQL over tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.operators.aggregates import aggregate
from tableflow.operators.joins import join, join_all
from tableflow.operators.project import cast_from_source, cast_to, conform_to_sink, insert_columns, map_fields, text_preview
from tableflow.operators.windows import hop, session, tumble, window_agg
from tableflow.plans.inputs import table
from tableflow.plans.jobs import run_sql
from tableflow.plans.registry import query
from tableflow.session import work_dir
from tableflow.sinks.writers import sink_append

# Projections


@query("project", 'select o_orderkey, o_orderstatus as "order" from orders')
def project(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("order"))


@query("map_fields", "select o_orderkey id, o_orderpriority product from orders")
def mapped(spark, sf):
    fields = [{"source": "o_orderkey", "target": "id"}, {"source": "o_orderpriority", "target": "product"}]
    return map_fields(table(spark, sf, "orders"), fields)


@query("insert_columns", "select cast(null as varchar) note, o_orderkey id, o_custkey cust from orders")
def listed(spark, sf):
    target = T.StructType.fromDDL("note string, id bigint, cust bigint")
    return insert_columns(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), target, ["id", "cust"])


@query("insert_cast", "select cast(o_orderkey as varchar) version_num from orders")
def cast(spark, sf):
    return cast_to(table(spark, sf, "orders").select("o_orderkey"), T.StructType.fromDDL("version_num string"))


@query("filter_where", "select o_orderkey from orders where o_totalprice > 1000 and o_orderstatus = 'F'")
def filtered(spark, sf):
    return table(spark, sf, "orders").where("o_totalprice > 1000 and o_orderstatus = 'F'").select("o_orderkey")


@query(
    "text_preview",
    "select doc_id, case when length(text) > 500 then substring(text, 1, 500) || '...' else text end preview,"
    " cast(strlen(text) as int) size from documents",
)
def preview(spark, sf):
    return text_preview(table(spark, sf, "documents").select("doc_id", "text"), "text")


@query("cast_from_source", "select event_id, ts, user_id, event_type, value from events")
def raw_cast(spark, sf):
    events = table(spark, sf, "events")
    text = events.select(*[F.col(c).cast("string").alias(c) for c in events.columns])
    types = {
        "event_id": "BIGINT",
        "ts": "datetime(6)",
        "user_id": "bigint(20)",
        "event_type": "varchar(32)",
        "value": "double",
    }
    return cast_from_source(text, types)


ORDER_FIELDS = [
    {"name": "o_orderkey", "type": "BIGINT", "primaryKey": True},
    {"name": "amount", "type": "DECIMAL", "precision": 18, "scale": 2},
    {"name": "o_orderpriority", "type": "STRING", "precision": 8},
]


@query(
    "conform_to_sink",
    "select o_orderkey, cast(o_totalprice as decimal(18,2)) amount, o_orderpriority from orders"
    " where length(o_orderpriority) <= 8",
)
def conformed(spark, sf):
    good, _ = conform_to_sink(table(spark, sf, "orders").withColumnRenamed("o_totalprice", "amount"), ORDER_FIELDS)
    return good


@query(
    "conform_to_sink_rejected",
    "select o_orderkey, 'o_orderpriority does not fit STRING' reason from orders where length(o_orderpriority) > 8",
)
def rejected(spark, sf):
    _, bad = conform_to_sink(table(spark, sf, "orders").withColumnRenamed("o_totalprice", "amount"), ORDER_FIELDS)
    return bad.select("o_orderkey", F.col("_reason").alias("reason"))


# Joins


@query(
    "join_inner",
    "select o_orderkey, o_orderpriority, c_name, c_mktsegment from orders join customer on o_custkey = c_custkey",
)
def inner(spark, sf):
    return join(
        table(spark, sf, "orders"),
        table(spark, sf, "customer"),
        [("o_custkey", "c_custkey")],
        "inner",
        ["o_orderkey", "o_orderpriority"],
        ["c_name", "c_mktsegment"],
    )


def _outer(spark, sf, how, salt=1):
    """Both sides filtered, so that each has rows without partner."""
    orders = table(spark, sf, "orders").where("o_orderstatus = 'F'")
    customer = table(spark, sf, "customer").where("c_acctbal > 0")
    return join(orders, customer, [("o_custkey", "c_custkey")], how, ["o_orderkey"], ["c_custkey", "c_name"], salt)


OUTER = (
    "select o_orderkey, c_custkey, c_name from (select * from orders where o_orderstatus = 'F') o"
    " {} join (select * from customer where c_acctbal > 0) c on o_custkey = c_custkey"
)


@query("join_left", OUTER.format("left"))
def left(spark, sf):
    return _outer(spark, sf, "left")


@query("join_right", OUTER.format("right"))
def right(spark, sf):
    return _outer(spark, sf, "right")


@query("join_full", OUTER.format("full"))
def full(spark, sf):
    return _outer(spark, sf, "full")


@query("join_full_salted", OUTER.format("full"))
def full_salted(spark, sf):
    return _outer(spark, sf, "full", salt=8)


@query(
    "join_multi",
    "select o_orderkey, n_name, r_name from orders join customer on o_custkey = c_custkey"
    " join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey",
)
def multi(spark, sf):
    return join_all(
        table(spark, sf, "orders").select("o_orderkey", "o_custkey"),
        [
            (table(spark, sf, "customer").select("c_custkey", "c_nationkey"), [("o_custkey", "c_custkey")], "inner"),
            (table(spark, sf, "nation"), [("c_nationkey", "n_nationkey")], "inner"),
            (table(spark, sf, "region"), [("n_regionkey", "r_regionkey")], "inner"),
        ],
    ).select("o_orderkey", "n_name", "r_name")


@query(
    "join_where",
    "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey"
    " where c_mktsegment = 'BUILDING' and o_totalprice > 1000",
)
def join_where(spark, sf):
    joined = join(table(spark, sf, "orders"), table(spark, sf, "customer"), [("o_custkey", "c_custkey")])
    return joined.where("c_mktsegment = 'BUILDING' and o_totalprice > 1000").select("o_orderkey", "c_name")


# Aggregates


@query("agg_count", "select c_mktsegment, count(nullif(c_mktsegment, 'BUILDING')) ph from customer group by 1")
def agg_count(spark, sf):
    rows = table(spark, sf, "customer").withColumn("phone", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return aggregate(rows, ["c_mktsegment"], {"ph": ("count", "phone")})


@query("agg_count_star", "select c_mktsegment, count(*) n from customer group by 1")
def agg_count_star(spark, sf):
    return aggregate(table(spark, sf, "customer"), ["c_mktsegment"], {"n": ("count", "*")})


def _basic(name):
    @query(f"agg_{name}", f"select o_orderstatus, round({name}(o_totalprice), 2) v from orders group by 1")
    def run(spark, sf):
        out = aggregate(table(spark, sf, "orders"), ["o_orderstatus"], {"v": (name, "o_totalprice")})
        return out.withColumn("v", F.round("v", 2))


for _name in ("sum", "avg", "min", "max"):
    _basic(_name)


@query("agg_multi_key", "select l_returnflag, l_linestatus, count(*) n from lineitem group by 1, 2")
def agg_multi_key(spark, sf):
    return aggregate(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], {"n": ("count", "*")})


@query(
    "agg_where_having",
    "select o_custkey, count(*) n from orders where o_totalprice > 1000 group by 1 having count(*) > 5",
)
def agg_where_having(spark, sf):
    orders = table(spark, sf, "orders")
    return aggregate(orders, ["o_custkey"], {"n": ("count", "*")}, where="o_totalprice > 1000", having="n > 5")


# Windows

WINDOW_AGGS = {"n": ("count", "*"), "mean": ("avg", "value"), "top": ("max", "value")}


def _rounded(df):
    return df.withColumn("mean", F.round("mean", 8))


@query(
    "window_tumble",
    "select time_bucket(interval 1 hour, ts) window_start, time_bucket(interval 1 hour, ts) + interval 1 hour window_end,"
    " event_type, count(*) n, round(avg(value), 8) mean, max(value) top from events group by 1, 2, 3",
)
def window_tumble(spark, sf):
    return _rounded(window_agg(table(spark, sf, "events"), "ts", tumble("1 hour"), ["event_type"], WINDOW_AGGS))


@query(
    "window_hop",
    "select ws window_start, ws + interval 2 hour window_end, event_type, count(*) n, round(avg(value), 8) mean,"
    " max(value) top from (select time_bucket(interval 1 hour, ts) - to_hours(k) ws, event_type, value"
    " from events, (select unnest([0, 1]) k)) group by 1, 2, 3",
)
def window_hop(spark, sf):
    return _rounded(window_agg(table(spark, sf, "events"), "ts", hop("2 hours", "1 hour"), ["event_type"], WINDOW_AGGS))


SESSIONS = (
    "with a as (select *, case when ts > lag(ts) over w + interval {gap} or lag(ts) over w is null then 1 else 0 end f"
    " from events window w as (partition by user_id order by ts)),"
    " b as (select *, sum(f) over (partition by user_id order by ts rows unbounded preceding) s from a)"
    " select min(ts) window_start, max(ts) + interval {gap} window_end, user_id, count(*) n,"
    " round(avg(value), 8) mean, max(value) top from b group by user_id, s"
)


@query("window_session", SESSIONS.format(gap="30 minute"))
def window_session(spark, sf):
    return _rounded(window_agg(table(spark, sf, "events"), "ts", session("30 minutes"), ["user_id"], WINDOW_AGGS))


# Custom SQL


@query(
    "custom_sql",
    "select user_id from events where event_type = 'click' union select o_custkey from orders"
    " except select user_id from events where event_type = 'view'",
)
def custom_sql(spark, sf):
    sources = {name: table(spark, sf, name) for name in ("events", "orders")}
    path = work_dir(spark, "custom-sql")
    results = run_sql(
        spark,
        [
            "SELECT 1",
            ("target", "select user_id from events where event_type = 'click' union select o_custkey from orders"),
        ],
        {f"source_{name}": frame for name, frame in sources.items()} | sources,
        {"target": lambda rows, batch_id: sink_append(rows, path)},
    )
    assert len(results) == 1
    loaded = {"loaded": spark.read.schema("user_id bigint").parquet(path)}
    return run_sql(spark, ["select * from loaded except select user_id from events where event_type = 'view'"], loaded)[0]
