"""Joins over change feeds in ``foreachBatch``, kept up to date batch by batch.

An update moves a row from its old group or partner to the new one and a delete takes
it away. Every micro-batch reads and writes only the buckets its keys fall into, and
every state is committed under the batch id, so a replayed batch gives the same state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.operators.joins import Pairs, check_kind, condition, salted
from tableflow.sinks.keyed_table import KeyedTable, no_rows
from tableflow.sinks.upsert import GONE, SEQ, newest, read_upserted, sink_upsert
from tableflow.sources.changes import DELETE

SOURCE = "_source"
BATCH = "_batch"
OP = "_op"
SIGN = "_sign"
STEP = "_step"
STAYS = "_stays"
WAS = "_was"
IS = "_is"

# Buckets that the rows of one value (a group, a join value) are spread over.
SPREAD = 64

# Whether adaptive execution merges small shuffle partitions of frames that are kept, too.
MERGED = "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"


def tagged(sources: dict[str, DataFrame]) -> DataFrame:
    """Several sources as one frame: a source name and one struct column per source."""
    kinds = {
        name: T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields]) for name, df in sources.items()
    }
    out = None
    for name, df in sources.items():
        columns = [
            F.struct(*df.columns).cast(kind).alias(other) if other == name else F.lit(None).cast(kind).alias(other)
            for other, kind in kinds.items()
        ]
        part = df.select(F.lit(name).alias(SOURCE), *columns)
        out = part if out is None else out.unionByName(part)
    return out


def untagged(batch: DataFrame, name: str) -> DataFrame:
    """The rows one source brought."""
    return batch.where(F.col(SOURCE) == name).select(f"{name}.*")


def _same(a: DataFrame, b: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Null-safe equality, the one GROUP BY uses."""
    out = F.lit(True)
    for left, right in pairs:
        out = out & a[left].eqNullSafe(b[right])
    return out


class _Snapshot:
    """The keyed rows of a change feed, before and after a batch.

    ``by`` names columns whose values rows are looked up by. Where they are not the key, the live rows
    are also kept in buckets of these values, each value spread over ``spread`` buckets.
    """

    def __init__(
        self,
        path: str,
        keys: Sequence[str],
        seq: Sequence[str],
        op: str,
        buckets: int | None,
        by: Sequence[str] = (),
        spread: int = SPREAD,
    ):
        self.path, self.keys, self.seq, self.op, self.buckets = path, list(keys), list(seq), op, buckets
        self.by, self.spread = list(by), spread
        self.apart = bool(self.by) and self.by != self.keys

    def fold(self, changes: DataFrame) -> DataFrame:
        """The newest change per key, in the snapshot's columns."""
        values = [c for c in changes.columns if c != self.op]
        gone = F.col(self.op).eqNullSafe(DELETE)
        return newest(changes.select(*values, F.struct(*self.seq).alias(SEQ), gone.alias(GONE)), self.keys)

    def take(self, folded: DataFrame, batch_id: int) -> DataFrame | None:
        """Commit the folded changes; their signed images, to be unpersisted, or None if no key came.

        The old row of a key goes (-1) and the new one comes (+1); outdated changes have no image.
        """
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in folded.schema.fields])
        spark = folded.sparkSession
        table = KeyedTable.create(spark, self.path, schema, self.keys, self.buckets)
        touched = table.merge(folded, newest, batch_id, folded=True)
        if self.apart:
            keys = list(dict.fromkeys([*self.by, *self.keys]))
            place = KeyedTable.create(spark, f"{self.path}-by", schema, keys, self.buckets, self.by, self.spread)
        if not touched:
            return None
        images = self._images(table.read(before=batch_id, buckets=touched), folded).persist(StorageLevel.MEMORY_AND_DISK)
        if self.apart:
            # A row that stays with its value is replaced by the new one; markers of moved rows
            # are not kept, since outdated changes never get here.
            moves = images.where((F.col(SIGN) > 0) | ~F.col(STAYS)).withColumn(GONE, F.col(SIGN) < 0)
            place.merge(moves, newest, batch_id, folded=True, kept=~F.col(GONE))
        return images

    def _images(self, held: DataFrame, folded: DataFrame) -> DataFrame:
        values = [c for c in folded.columns if c not in (SEQ, GONE)]
        old = held.select(
            *[F.col(c).alias(f"_old_{c}") for c in self.keys],
            F.struct(*values).alias("_old"),
            F.col(SEQ).alias("_old_seq"),
            F.col(GONE).alias("_old_gone"),
        )
        pairs = folded.join(old, _same(folded, old, [(k, f"_old_{k}") for k in self.keys]), "left")
        counted = pairs.where(F.col("_old_seq").isNull() | (F.col(SEQ) > F.col("_old_seq")))
        stays = ~F.col(GONE)
        for c in self.by:
            stays = stays & folded[c].eqNullSafe(F.col(f"_old.`{c}`"))
        new = F.struct(*[folded[c] for c in values])
        images = F.array(
            F.when(~F.col("_old_gone"), F.struct(F.lit(-1).alias(SIGN), stays.alias(STAYS), F.col("_old").alias("_image"))),
            F.when(~F.col(GONE), F.struct(F.lit(1).alias(SIGN), F.lit(True).alias(STAYS), new.alias("_image"))),
        )
        signed = counted.select(SEQ, F.explode(F.array_compact(images)).alias("_s"))
        return signed.select(F.col(f"_s.{SIGN}").alias(SIGN), F.col(f"_s.{STAYS}").alias(STAYS), SEQ, F.col("_s._image.*"))

    def around(self, values: DataFrame, before: int | None = None) -> DataFrame | None:
        """Live rows whose ``by`` is among ``values`` (same column names), from their buckets alone."""
        table = KeyedTable(values.sparkSession, f"{self.path}-by" if self.apart else self.path)
        places = table.buckets_of(values, self.by)
        if not places:
            return None
        rows = _live(table.read(before=before, buckets=places))
        return rows.join(values, _same(rows, values, [(c, c) for c in self.by]), "left_semi")


def _live(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col(GONE)).drop(SEQ, GONE)


OTHER = {"l": "r", "r": "l"}


@contextmanager
def _merged(spark: SparkSession) -> Iterator[None]:
    """Frames persisted meanwhile have as many partitions as their bytes ask for: each is read again and again."""
    before = spark.conf.get(MERGED)
    spark.conf.set(MERGED, "true")
    try:
        yield
    finally:
        spark.conf.set(MERGED, before)


class ChangelogJoin:
    """``foreachBatch`` target over ``tagged({"l": ..., "r": ...})`` that keeps a join of two feeds.

    Changed rows of one side meet the rows of the other side that have their join values, read from the
    buckets of these values; only result rows that came, changed or went are written. Result
    rows are keyed by the keys of both sides. ``salt`` as in ``join``, for many rows of a side per join
    value; ``spread`` is the number of buckets that the rows of one value are spread over, where a side is
    not joined by its key.
    """

    def __init__(
        self,
        path: str,
        on: Pairs,
        how: str,
        left_keys: Sequence[str],
        right_keys: Sequence[str],
        left_seq: Sequence[str],
        right_seq: Sequence[str],
        op: str = "op",
        buckets: int | None = None,
        salt: int = 1,
        spread: int = SPREAD,
    ):
        check_kind(how)
        self.on, self.how, self.buckets, self.salt = list(on), how, buckets, salt
        by = {"l": [a for a, _ in on], "r": [b for _, b in on]}
        self.sides = {
            "l": _Snapshot(f"{path}/left", left_keys, left_seq, op, buckets, by["l"], spread),
            "r": _Snapshot(f"{path}/right", right_keys, right_seq, op, buckets, by["r"], spread),
        }
        self.out = f"{path}/out"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self.apply({name: untagged(batch, name) for name in self.sides}, batch_id)
        finally:
            batch.unpersist()

    def apply(self, changes: dict[str, DataFrame], batch_id: int) -> None:
        """Take in the changes of both sides, ``{"l": ..., "r": ...}``."""
        with _merged(changes["l"].sparkSession):
            self._take_in(changes, batch_id)

    def _take_in(self, changes: dict[str, DataFrame], batch_id: int) -> None:
        folded = {n: side.fold(changes[n]).persist(StorageLevel.MEMORY_AND_DISK) for n, side in self.sides.items()}
        images: dict[str, DataFrame | None] = {}
        rows: dict[str, DataFrame] = {}
        try:
            images = self._both(folded["l"].sparkSession, lambda n: self.sides[n].take(folded[n], batch_id))
            given = {n: self._none(folded[n]) if frame is None else frame for n, frame in images.items()}
            rows = self._both(folded["l"].sparkSession, lambda n: self._all(n, given, batch_id))
            self._apply(given, rows, batch_id)
        finally:
            for frame in (*folded.values(), *images.values(), *rows.values()):
                if frame is not None:
                    frame.unpersist()

    def _both(self, spark: SparkSession, work: Callable[[str], DataFrame | None]) -> dict[str, DataFrame | None]:
        """The same work for both sides, side by side."""
        with ThreadPoolExecutor(len(self.sides)) as pool:
            running = {name: pool.submit(inheritable_thread_target(spark)(work), name) for name in self.sides}
        return {name: task.result() for name, task in running.items()}

    def _outer(self, name: str) -> bool:
        """Whether rows of a side come out without a partner."""
        return self.how == "full" or self.how == {"l": "left", "r": "right"}[name]

    def _none(self, folded: DataFrame) -> DataFrame:
        """The images of a side that nothing changed on."""
        values = [f for f in folded.schema.fields if f.name not in (SEQ, GONE)]
        beside = [T.StructField(SIGN, T.IntegerType()), T.StructField(STAYS, T.BooleanType()), folded.schema[SEQ]]
        return no_rows(folded.sparkSession, T.StructType([*beside, *values]))

    def _values(self, images: dict[str, DataFrame], names: Sequence[str], side: str) -> DataFrame:
        """Join values of changed rows of the named sides, under the column names of ``side``."""
        by = self.sides[side].by
        out = None
        for name in names:
            picked = images[name].select(*[F.col(a).alias(b) for a, b in zip(self.sides[name].by, by, strict=True)])
            out = picked if out is None else out.union(picked)
        return out.distinct()

    def _all(self, name: str, images: dict[str, DataFrame], batch_id: int) -> DataFrame:
        """Changed rows of a side, and its unchanged ones with join values of changed rows.

        Columns carry the prefix of the side; two flags say whether a row was there before and is after the batch.
        """
        side, changed, other = self.sides[name], images[name], OTHER[name]
        # Whether a row of an outer side has a partner depends on the changes of both sides.
        others = ["l", "r"] if self._outer(other) else [other]
        columns = [c for c in changed.columns if c not in (SIGN, STAYS, SEQ)]
        picked = [F.col(f"`{c}`").alias(f"{name}_{c}") for c in columns]
        out = changed.select(*picked, (F.col(SIGN) < 0).alias(WAS), (F.col(SIGN) > 0).alias(IS))
        near = side.around(self._values(images, others, name), batch_id)
        if near is not None:
            gone = changed.where(F.col(SIGN) < 0).select(*[F.col(k).alias(f"_gone_{k}") for k in side.keys])
            same = near.join(gone, _same(near, gone, [(k, f"_gone_{k}") for k in side.keys]), "left_anti")
            out = out.unionByName(same.select(*picked, F.lit(True).alias(WAS), F.lit(True).alias(IS)))
        return out.persist(StorageLevel.MEMORY_AND_DISK)

    def _meet(self, rows: DataFrame, few: DataFrame, pairs: Pairs, kind: str) -> DataFrame:
        """``rows``, of which many may have one join value, joined with ``few`` per value."""
        on = list(pairs)
        if self.salt > 1:
            rows, few, on = salted(rows, few, on, self.salt)
        return rows.alias("l").join(few.alias("r"), condition(on), kind)

    def _apply(self, images: dict[str, DataFrame], rows: dict[str, DataFrame], batch_id: int) -> None:
        """Take back result rows that are no more and write those that came: of a key that has both, the new one stays."""
        columns = {n: [f"{n}_{c}" for c in images[n].columns if c not in (SIGN, STAYS, SEQ)] for n in images}
        by = {n: [f"{n}_{c}" for c in side.by] for n, side in self.sides.items()}
        picked = [*columns["l"], *columns["r"], SIGN]
        parts = []
        for name, few in OTHER.items():
            pairs = list(zip(by[name], by[few], strict=True))
            changed = images[few].select(*[F.col(c[2:]).alias(c) for c in columns[few]], SIGN)
            met = self._meet(rows[name], changed, pairs, "inner")
            parts.append(met.where(F.when(F.col(SIGN) < 0, F.col(WAS)).otherwise(F.col(IS))).select(*picked))
            if self._outer(name):
                some = rows[few].groupBy(*by[few]).agg(F.max(WAS).alias("_had"), F.max(IS).alias("_has"))
                met = self._meet(rows[name], some, pairs, "left")
                before = F.col(WAS) & ~F.coalesce("_had", F.lit(False))
                after = F.col(IS) & ~F.coalesce("_has", F.lit(False))
                kinds = {c: images[few].schema[c[2:]].dataType for c in columns[few]}
                alone = met.where(before != after).withColumn(SIGN, F.when(after, 1).otherwise(-1))
                none = [F.lit(None).cast(kinds[c]).alias(c) for c in columns[few]]
                parts.append(alone.select(*[F.col(f"l.{c}") for c in columns[name]], *none, SIGN).select(*picked))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        out = out.withColumns(
            {
                BATCH: F.lit(batch_id).cast("long"),
                STEP: F.greatest(SIGN, F.lit(0)),
                OP: F.when(F.col(SIGN) < 0, DELETE).otherwise("u"),
            }
        ).drop(SIGN)
        keys = [f"{name}_{k}" for name, side in self.sides.items() for k in side.keys]
        # Writes come in the order of batches, so markers of deletes are of no use after theirs.
        sink_upsert(out, self.out, keys, [BATCH, STEP], OP, batch_id, self.buckets, horizon=[batch_id + 1, 0])

    def result(self, spark: SparkSession) -> DataFrame:
        """The join as it stands; columns carry ``l_`` or ``r_``."""
        return read_upserted(spark, self.out).drop(BATCH, STEP)
