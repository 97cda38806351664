"""Change feeds: envelopes, snapshot plus changes, and server time zones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableflow.operators.keyed import latest_per
from tableflow.sources.decode import Schema, as_schema

# Operation codes of a change envelope.
SNAPSHOT, CREATE, UPDATE, DELETE = "r", "c", "u", "d"
TRUNCATE, MESSAGE = "t", "m"

_SEQ = "_seq"
_OP = "op"


def cdc_encode(df: DataFrame, op: str, images: Sequence[str], ts_millis: Column) -> DataFrame:
    """Changes as envelopes ``{"op", "before", "after", "ts_ms"}`` in a ``value`` column."""
    image = F.struct(*images)
    gone = F.col(op) == DELETE
    envelope = F.struct(
        F.col(op).alias("op"),
        F.when(gone, image).alias("before"),
        F.when(~gone, image).alias("after"),
        ts_millis.alias("ts_ms"),
    )
    return df.select(F.to_json(envelope).alias("value"))


def cdc_decode(df: DataFrame, schema: Schema, value: str = "value", keep: Sequence[str] = (), position: Sequence[str] = ()) -> DataFrame:
    """Changes from envelopes: the row image, ``op`` and the source time ``ts_ms``.

    The source time is that of the change in the source; where an envelope has none, the
    connector's. ``position`` names numeric fields of the source block (``pos``, ``lsn``) that order
    changes of one millisecond; they come out as columns of these names.

    A delete carries its last image in ``before``; bodies wrapped in a ``payload``
    field, as connectors with embedded schemas send them, are read the same way.
    Messages without an operation (tombstones, heartbeats) and logical messages are dropped.
    A truncate names no row: it fails the job, since the keyed targets cannot follow it.
    """
    image = as_schema(schema).simpleString()
    block = "struct<" + ",".join(f"{c}:bigint" for c in ("ts_ms", *position)) + ">"
    shape = f"struct<op:string,before:{image},after:{image},ts_ms:bigint,source:{block}>"
    body = F.from_json(F.col(value).cast("string"), f"struct<{shape[len('struct<'):-1]},payload:{shape}>")
    # Generating the fields as columns parses a message once, not once per use.
    parsed = df.select(*keep, F.inline(F.array(body)))
    op = F.coalesce("op", "payload.op")
    cleared = F.raise_error(F.lit("the feed truncates its table: load a new snapshot")).cast("string")
    time = F.coalesce("source.ts_ms", "payload.source.ts_ms", "ts_ms", "payload.ts_ms")
    places = [F.coalesce(f"source.{c}", f"payload.source.{c}").alias(c) for c in position]
    row = F.coalesce("after", "before", "payload.after", "payload.before")
    change = parsed.select(
        *keep, F.when(op == TRUNCATE, cleared).otherwise(op).alias(_OP), time.alias("ts_ms"), *places, row.alias("_row")
    )
    known = F.col(_OP).isNotNull() & (F.col(_OP) != MESSAGE)
    return change.where(known).select(*keep, _OP, "ts_ms", *position, "_row.*")


def live(changes: DataFrame, keys: Sequence[str], seq: Sequence[str], op: str = _OP) -> DataFrame:
    """Rows that exist after all changes: the newest of every key, unless it is a delete. A null operation writes."""
    return latest_per(changes, keys, seq).where(~F.col(op).eqNullSafe(F.lit(DELETE))).drop(op)


def cdc_initial(
    snapshot: DataFrame, changes: DataFrame, keys: Sequence[str], seq: Sequence[str], op: str = _OP
) -> DataFrame:
    """Snapshot first, then changes, as one keyed table.

    Snapshot rows order before every change. One aggregation by key over both, which
    combines before the shuffle; the two sides are never joined.
    """
    values = [c for c in changes.columns if c not in (op, *seq)]
    position = F.struct(*[F.col(s) for s in seq])
    first = F.lit(None).cast(changes.select(position.alias("p")).schema["p"].dataType)
    read = snapshot.select(*values, F.lit(SNAPSHOT).alias(_OP), first.alias(_SEQ))
    fed = changes.select(*values, F.col(op).alias(_OP), position.alias(_SEQ))
    return live(read.unionByName(fed), keys, [_SEQ], _OP).select(*values)


def key_splits(df: DataFrame, key: str, chunks: int) -> list[object]:
    """Upper key bounds of all chunks but the last, about equal in rows; ``chunks - 1`` values at most."""
    if chunks < 2:
        return []
    shares = [i / chunks for i in range(1, chunks)]
    found = df.agg(F.percentile_approx(key, F.array(*map(F.lit, shares)), chunks * 100).alias("s")).first()["s"]
    return sorted(set(found or []))


def by_chunk(key: Column, splits: Sequence[object], values: Sequence[Column]) -> Column:
    """The value of the chunk a key falls into, one value more than splits; found by halving."""
    if not splits:
        return values[0]
    middle = len(splits) // 2
    low = by_chunk(key, splits[:middle], values[: middle + 1])
    high = by_chunk(key, splits[middle + 1 :], values[middle + 1 :])
    return F.when(key <= F.lit(splits[middle]), low).otherwise(high)


def chunk_of(key: Column, splits: Sequence[object]) -> Column:
    """Number of the chunk a key falls into."""
    return by_chunk(key, splits, [F.lit(i) for i in range(len(splits) + 1)])


def cdc_incremental_snapshot(
    snapshot: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    seq: Sequence[str],
    splits: Sequence[object],
    marks: Mapping[int, Sequence[object]] | None = None,
    op: str = _OP,
) -> DataFrame:
    """Snapshot taken chunk by chunk while changes go on, as one keyed table.

    ``splits`` cuts the first key into chunks (``key_splits``); ``marks`` gives for a
    chunk the feed position up to which its snapshot rows already hold the changes.
    A change at or below the mark of its chunk is in the snapshot and is skipped, also
    when its row was deleted before the chunk was read; a later one wins.
    """
    marks = marks or {}
    position = F.struct(*[F.col(s) for s in seq])
    kind = changes.select(position.alias("p")).schema["p"].dataType

    def mark(number: int) -> Column:
        if number not in marks:
            return F.lit(None).cast(kind)
        given = zip(marks[number], kind.fields, strict=True)
        return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in given])

    read_to = by_chunk(F.col(keys[0]), splits, [mark(i) for i in range(len(splits) + 1)])
    later = changes.where(read_to.isNull() | (position > read_to))
    return cdc_initial(snapshot, later, keys, seq, op)


def with_server_zone(df: DataFrame, columns: Sequence[str], zone: str) -> DataFrame:
    """Naive times written in the server's zone, as naive UTC times."""
    return df.withColumns(
        {c: F.convert_timezone(F.lit(zone), F.lit("UTC"), F.col(c).cast("timestamp_ntz")) for c in columns}
    )
