"""Queries over keyed tables and run logs: newest per key, retention, status, lineage, paging."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.session import cut_lineage, work_dir

# Job states a run list takes over from the observed side.
OBSERVED_STATES = ("RUNNING", "FINISHED", "FAILED", "CANCELED", "RESTARTING")
UNKNOWN_NAME = "unknown"


def _column(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def first_filled(*columns: str | Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(_column(c).cast("string"), F.lit("")) for c in columns])


def sort_time(*columns: str) -> Column:
    """The first time that is there, neither null nor 0, as a number; else 0."""
    return F.coalesce(*[F.nullif(F.col(c).cast("long"), F.lit(0)) for c in columns], F.lit(0))


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The row with the greatest ``order`` of every key; nulls order lowest.

    Rows of a key that tie are told apart by their other columns, so the result is
    repeatable. One row per key leaves every map task, so a key that holds a third of
    the table still sends one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    by = [F.col(f"`{c}`") if isinstance(c, str) else c for c in order]
    if all(_orderable(df.schema[c].dataType) for c in rest):
        # Order first, then what is not in it yet: the row is held once.
        named = {c: f"_order{i}" for i, c in enumerate(order) if isinstance(c, str) and c in rest}
        ranked = [c.alias(f"_order{i}") for i, c in enumerate(by)]
        row = F.max(F.struct(*ranked, *[F.col(f"`{c}`") for c in rest if c not in named]))
        back = [F.col(f"_row.`{named.get(c, c)}`").alias(c) for c in rest]
    else:
        row = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*by))
        back = [F.col(f"_row.`{c}`") for c in rest]
    return df.groupBy(*keys).agg(row.alias("_row")).select(*keys, *back)


def prune_to_latest(df: DataFrame, key: str | Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Retention: what is left when only the newest record of every key is kept."""
    keys = [key] if isinstance(key, str) else list(key)
    return latest_per(df, keys, order).select(*df.columns)


def prune_by_name(
    children: DataFrame, parents: DataFrame, on: tuple[str, str], name: str, order: Sequence[str]
) -> DataFrame:
    """Retention over a join: per parent *name* the newest child of all ids that carry it.

    Children without a parent share one bucket. Each parent id is reduced to its newest
    child before the join, so the join moves one row per id and the shared bucket never
    meets the raw rows.
    """
    child_id, parent_id = on
    newest = latest_per(children, [child_id], [c for c in order if c != child_id])
    names = parents.select(F.col(parent_id).alias("_id"), F.col(name).cast("string").alias("_name"))
    joined = newest.join(names, newest[child_id] == names["_id"], "left")
    named = joined.select(F.coalesce("_name", F.lit(UNKNOWN_NAME)).alias("name"), *children.columns)
    return latest_per(named, ["name"], order)


def with_latest_child(
    parent: DataFrame, child: DataFrame, on: tuple[str, str], order: Sequence[str | Column], value: str
) -> DataFrame:
    """Every parent with ``latest``, the value of its newest child, and ``n``, its number of children."""
    parent_id, child_id = on
    per_parent = child.groupBy(F.col(child_id).alias("_id")).agg(
        F.max_by(_column(value), F.struct(*[_column(c) for c in order])).alias("latest"), F.count(F.lit(1)).alias("n")
    )
    joined = parent.join(per_parent, parent[parent_id] == per_parent["_id"], "left")
    return joined.select(*parent.columns, "latest", F.coalesce("n", F.lit(0)).alias("n"))


def latest_completed(df: DataFrame, key: str, order: Sequence[str | Column], done: Column) -> DataFrame:
    """The newest record of every id among those that completed."""
    return latest_per(df.where(done), [key], order)


def newest_entry(df: DataFrame, history: str, keys: Sequence[str], paths: Sequence[str], entry_id: str = "id") -> DataFrame:
    """The entry with the greatest id of a nested history list; ``path`` is the first filled of its path fields.

    Rows whose newest entry has no path, or that have no entry, are left out.
    """
    newest = F.reduce(
        _column(history),
        F.get(_column(history), F.lit(0)),
        lambda best, e: F.when(F.coalesce(e[entry_id], F.lit(0)) > F.coalesce(best[entry_id], F.lit(0)), e).otherwise(
            best
        ),
    )
    # Generating the fields as columns computes the entry once, not once per use.
    entry = df.select(*keys, F.inline(F.array(newest)))
    path = F.coalesce(*[F.nullif(F.col(f"`{p}`"), F.lit("")) for p in paths])
    others = [c for c in entry.columns if c not in keys and c not in paths]
    return entry.select(*keys, *others, path.alias("path")).where(F.col("path").isNotNull())


def reconcile(recorded: DataFrame, observed: DataFrame, key: str, status: str = "status", start: str = "start") -> DataFrame:
    """Recorded rows (``state``, ``start``) brought in line with what is observed.

    An observed known status wins; a recorded RUNNING that nobody observes has FAILED;
    a missing (null or 0) start time is taken from the observed side.
    """
    seen = observed.select(
        F.col(key).alias("_key"), F.col(status).alias("_status"), F.col(start).alias("_start"), F.lit(True).alias("_seen")
    )
    joined = recorded.join(seen, recorded[key] == seen["_key"], "left")
    began = F.when(
        F.col("start").isNull() | (F.col("start") == 0), F.coalesce(F.nullif("_start", F.lit(0)), "start")
    ).otherwise(F.col("start"))
    state = (
        F.when(F.col("_status").isin(*OBSERVED_STATES), F.col("_status"))
        .when(F.col("_seen").isNull() & (F.col("state") == "RUNNING"), F.lit("FAILED"))
        .otherwise(F.col("state"))
    )
    changed = {"state": state, "start": began}
    return joined.select(*[changed.get(c, recorded[c]).alias(c) for c in recorded.columns])


def status_counts(df: DataFrame, state: str, statuses: Mapping[str, str]) -> DataFrame:
    """One row with a count per status, ``{column name: status}``."""
    return df.agg(*[F.count_if(F.col(state) == s).alias(alias) for alias, s in statuses.items()])


def with_elapsed(df: DataFrame, now: int, state: str = "state", start: str = "start", recorded: str = "duration") -> DataFrame:
    """``duration`` in milliseconds: up to ``now`` for running rows that started, else as recorded."""
    running = (F.col(state) == "RUNNING") & (F.col(start) > 0)
    elapsed = F.when(running, F.lit(now) - F.col(start)).otherwise(F.col(recorded))
    return df.withColumn("duration", elapsed)


def live_rows(observed: DataFrame, recorded: DataFrame, on: tuple[str, str], state: str, start: str) -> DataFrame:
    """RUNNING rows with what is recorded for them, newest first, rows without a start last, by id where starts are equal."""
    running = observed.where(F.col(state) == "RUNNING")
    joined = running.join(recorded, running[on[0]] == recorded[on[1]], "left")
    return joined.orderBy(F.col(start).desc_nulls_last(), running[on[0]])


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """One page in the given order, with ``total`` counted over all rows.

    The rows are sorted over all tasks and written once, a folder per part; the row counts of
    the parts tell which of them hold the page, and only these folders are read.
    """
    path = work_dir(df.sparkSession, "page")
    sorted_rows = df.orderBy(*order).withColumn("_part", F.spark_partition_id())
    sorted_rows.write.partitionBy("_part").parquet(path)
    parts = df.sparkSession.read.schema(sorted_rows.schema).parquet(path)
    counts = sorted((row["_part"], row["count"]) for row in parts.groupBy("_part").count().collect())
    picked, before, skip = [], 0, 0
    for part, n in counts:
        if before < offset + limit and before + n > offset:
            skip = skip if picked else offset - before
            picked.append(part)
        before += n
    rows = parts.where(F.col("_part").isin(picked)).orderBy(*order).offset(skip).limit(limit)
    return rows.drop("_part").withColumn("total", F.lit(before).cast("long"))


def lineage(df: DataFrame, id: str, parent: str) -> DataFrame:
    """``id, root, depth``: the first ancestor of every row over ``parent`` links.

    Each round replaces a link by the link of its target, so a chain of n rows takes
    log2(n) joins. Rows that reached their root leave the open set; every round is
    written to the shared folder. A link to an id that is not there ends at the row
    itself. A cycle is an error: no chain takes more rounds than log2 of the number of rows.
    """
    nodes = df.select(F.col(id).alias("id"), F.col(parent).alias("_up"))
    known = nodes.select(F.col("id").alias("_known"))
    joined = nodes.join(known, nodes["_up"] == known["_known"], "left")
    start = cut_lineage(
        joined.select(
            "id",
            F.coalesce("_known", "id").alias("root"),
            F.when(F.col("_known").isNull(), 0).otherwise(1).alias("depth"),
        )
    )
    done = start.where("depth = 0")
    waiting = start.where("depth > 0")
    for _ in range(start.count().bit_length() + 1):
        if waiting.isEmpty():
            return done
        target = done.union(waiting).select(
            F.col("id").alias("_id"), F.col("root").alias("_root"), F.col("depth").alias("_depth")
        )
        stepped = cut_lineage(
            waiting.join(target, waiting["root"] == target["_id"]).select(
                "id", F.col("_root").alias("root"), (F.col("depth") + F.col("_depth")).alias("depth"), "_depth"
            )
        )
        # A target at depth 0 is a root: the rows that pointed to it are done.
        done = done.union(stepped.where("_depth = 0").drop("_depth"))
        waiting = stepped.where("_depth > 0").drop("_depth")
    raise ValueError("the parent links form a cycle")


def read_operations(df: DataFrame, details: str, fields: Mapping[str, str]) -> DataFrame:
    """An operation log with fields of its JSON detail as typed columns, ``{name: type}``."""
    schema = ", ".join(f"`{name}` {kind}" for name, kind in fields.items())
    parsed = df.withColumn("_details", F.from_json(F.col(details), schema))
    return parsed.select(*df.columns, *[F.col(f"_details.`{name}`").alias(name) for name in fields])


def merge_nonnull(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert in which a null or empty new value keeps the old one."""
    values = [c for c in old.columns if c not in keys]
    incoming = new.select(*[F.col(k).alias(f"_new_{k}") for k in keys], *[F.col(c).alias(f"_new_{c}") for c in values])
    same = [old[k].eqNullSafe(incoming[f"_new_{k}"]) for k in keys]
    joined = old.join(incoming, same, "full")
    out = [F.coalesce(old[k], F.col(f"_new_{k}")).alias(k) for k in keys]
    for c in values:
        given = F.col(f"_new_{c}")
        if old.schema[c].dataType.typeName() == "string":
            given = F.nullif(given, F.lit(""))
        out.append(F.coalesce(given, old[c]).alias(c))
    return joined.select(*out)
