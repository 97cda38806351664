"""A keyed table on plain parquet: hash buckets of the key, one commit file per write.

Parquet has no ``MERGE``. A write reads the buckets its keys fall into, folds the
incoming rows in, writes these buckets again under a new directory and publishes
a commit file that maps every bucket to its directory. Buckets that the batch does
not touch are neither read nor written. Commits are named after the batch id, so
a replayed batch starts from the state before it and lands on the same result.

Where the target is a format with its own ``MERGE``, use that.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.sinks.files import Files

BUCKET = "_bucket"

# Buckets a table has at least, rows per bucket of a new one, and the mean bytes of a bucket
# above which all buckets are split.
FEWEST = 8
BUCKET_ROWS = 2_000_000
BUCKET_BYTES = 256 * 1024 * 1024


def buckets_for(df: DataFrame) -> int:
    """Number of buckets for a keyed copy of a table, by its rows; there is no upper limit."""
    return max(FEWEST, -(-df.count() // BUCKET_ROWS))


def no_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A frame that the optimizer knows to be empty: joins with it fall away."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]).where(F.lit(False))


@dataclass(frozen=True)
class Places:
    """Some buckets of a table that has ``of`` in all.

    A table only grows by doubling: bucket b of n becomes b and b + n of 2n, so places found under one
    number of buckets can be read under another.
    """

    of: int
    numbers: list[int]

    def __bool__(self) -> bool:
        return bool(self.numbers)

    def among(self, n: int) -> set[int]:
        if n <= self.of:
            return {b % n for b in self.numbers}
        return {b + k for b in self.numbers for k in range(0, n, self.of)}


# Commits that stay readable; older ones are removed once there are twice as many.
KEPT_COMMITS = 10

Fold = Callable[[DataFrame, list[str]], DataFrame]


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self.files = Files(spark)
        spec = json.loads(self.files.read(f"{self.path}/_table.json"))
        self.schema = T.StructType.fromJson(spec["schema"])
        self.keys: list[str] = spec["keys"]
        self.first_buckets: int | None = spec["buckets"]
        self.place: list[str] = spec.get("place") or self.keys
        self.spread: int = spec.get("spread", 1)

    @classmethod
    def create(
        cls,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        keys: Sequence[str],
        buckets: int | None = None,
        place: Sequence[str] | None = None,
        spread: int = 1,
    ) -> KeyedTable:
        """Open the table at ``path``, making it first if there is none.

        ``buckets`` says how many it begins with; without it, the rows of the first write do.
        Once the buckets are too large on average, the next write doubles their number.
        ``place`` names the columns, of the key, whose values rows are looked up by: the rows of a value are
        in ``spread`` buckets, so that a value with many rows makes no large one. Both stay as the table was made.
        """
        files = Files(spark)
        described = f"{path.rstrip('/')}/_table.json"
        if not files.exists(described):
            missing = set(keys) - set(schema.names)
            if missing:
                raise ValueError(f"key columns not in the schema: {sorted(missing)}")
            if not set(place or ()) <= set(keys):
                raise ValueError(f"rows are placed by columns of the key, not by {list(place)}")
            spec = {"schema": schema.jsonValue(), "keys": list(keys), "buckets": buckets}
            spec |= {"place": list(place), "spread": spread} if place else {}
            if not files.publish(described, json.dumps(spec)) and not files.exists(described):
                raise RuntimeError(f"{described} could not be written")
        table = cls(spark, path)
        if table.keys != list(keys):
            raise ValueError(f"{path} is keyed by {table.keys}, not by {list(keys)}")
        return table

    def bucket_of(self, n: int) -> Column:
        """Bucket, of ``n``, of a row that has the table's columns."""
        part = F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(self.spread))
        return self._bucket([F.col(c) for c in self.place], part, n)

    def _bucket(self, place: Sequence[Column], part: Column, n: int) -> Column:
        spread = [part.cast("int")] if self.spread > 1 else []
        return F.pmod(F.xxhash64(*place, *spread), F.lit(n)).cast("int")

    def last_batch(self) -> int:
        commits = self.files.names(f"{self.path}/_commits")
        return int(commits[-1].split(".")[0]) if commits else -1

    def _commit(self, before: int | None) -> dict[str, dict]:
        """The newest commit, of a batch below ``before``: the folder of every bucket, how many buckets
        and bytes each folder was written with, and the number of buckets."""
        for name in reversed(self.files.names(f"{self.path}/_commits")):
            if before is None or int(name.split(".")[0]) < before:
                return json.loads(self.files.read(f"{self.path}/_commits/{name}"))
        return {"held": {}, "written": {}, "bytes": {}, "buckets": self.first_buckets or FEWEST}

    def read(self, before: int | None = None, buckets: Places | None = None) -> DataFrame:
        """The rows as committed, optionally as of before a batch and for some buckets only."""
        commit = self._commit(before)
        wanted = set(commit["held"])
        if buckets is not None:
            wanted &= {str(b) for b in buckets.among(commit["buckets"])}
        folders: dict[str, list[str]] = {}
        for bucket in wanted:
            folders.setdefault(commit["held"][bucket], []).append(bucket)
        paths = []
        for folder, members in folders.items():
            whole = len(members) == commit["written"][folder]
            paths += [f"{self.path}/{folder}"] if whole else [f"{self.path}/{folder}/{BUCKET}={b}" for b in members]
        if not paths:
            return no_rows(self.spark, self.schema)
        reader = self.spark.read.schema(self.schema).option("basePath", f"{self.path}/data")
        return reader.parquet(*paths).select(*self.schema.names)

    def buckets_of(self, rows: DataFrame, keys: Sequence[str] | None = None, before: int | None = None) -> Places:
        """Buckets that rows with these values of ``place`` fall into: at most as many as the table has.

        ``keys`` names the columns of ``rows`` that hold the values, in the order of ``place``.
        """
        n = self._commit(before)["buckets"]
        names = keys or self.place
        # A value beyond the type of the table's column is in none of its rows.
        typed = [F.col(c).try_cast(self.schema[k].dataType).alias(k) for c, k in zip(names, self.place, strict=True)]
        values = rows.select(*typed)
        if self.spread > 1:
            values = values.distinct().withColumn(BUCKET, F.explode(F.sequence(F.lit(0), F.lit(self.spread - 1))))
        bucket = self._bucket([F.col(k) for k in self.place], F.col(BUCKET), n)
        found = values.select(bucket.alias(BUCKET)).distinct().collect()
        return Places(n, sorted(row[BUCKET] for row in found))

    def merge(
        self,
        rows: DataFrame,
        fold: Fold,
        batch_id: int | None = None,
        folded: bool = False,
        touched: Places | None = None,
        kept: Column | None = None,
    ) -> Places:
        """Fold ``rows`` into the table and commit; returns the buckets it touched.

        ``fold(frame, keys)`` leaves one row per key. It first runs on the batch
        alone, where Spark combines before the shuffle, so a hot key costs one row
        per task from there on. ``folded`` says the batch has one row per key already
        and is cheap to read twice; ``touched`` names its buckets where they are known.
        Rows that ``kept`` is not true for leave the buckets that are written.
        """
        last = self.last_batch()
        if batch_id is None:
            batch_id = last + 1
        if batch_id < last:
            raise ValueError(f"batch {batch_id} comes after batch {last} of {self.path}")
        # Equal keys of another integer width would hash to another bucket: take the table's types.
        typed = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        fresh = typed if folded else fold(typed, self.keys).select(*self.schema.names)
        commit = self._commit(before=batch_id)
        first = not commit["held"]
        count = first and self.first_buckets is None
        keep = not folded and (count or (not first and touched is None))
        if keep:
            fresh = fresh.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if first:
                # Nothing to fold in yet: the folders the write makes tell the buckets.
                n = buckets_for(fresh) if count else commit["buckets"]
                placed = fresh.withColumn(BUCKET, self.bucket_of(n)).repartitionById(n, F.col(BUCKET))
                return self._publish(placed, commit, batch_id, Places(n, []), kept)
            n = self._grown(commit)
            if n > commit["buckets"]:
                touched = Places(n, list(range(n)))
            elif touched is None:
                found = fresh.select(self.bucket_of(n).alias(BUCKET)).distinct().collect()
                touched = Places(n, sorted(row[BUCKET] for row in found))
            if not touched:
                return touched
            held = self.read(before=batch_id, buckets=touched)
            both = held.unionByName(fresh).withColumn(BUCKET, self.bucket_of(n))
            # Hash partitioning by bucket also clusters (bucket, key): the fold adds no
            # shuffle, and each task writes whole buckets.
            placed = both.repartition(len(touched.numbers), BUCKET)
            return self._publish(fold(placed, [BUCKET, *self.keys]), commit, batch_id, touched, kept)
        finally:
            if keep:
                fresh.unpersist()

    def _grown(self, commit: dict[str, dict]) -> int:
        """Number of buckets the next write has: doubled until the mean size of one is small enough."""
        n = commit["buckets"]
        held = Counter(commit["held"].values())
        size = sum(commit["bytes"][f] * count / commit["written"][f] for f, count in held.items())
        while size / n > BUCKET_BYTES:
            n *= 2
        return n

    def _publish(
        self, rows: DataFrame, commit: dict[str, dict], batch_id: int, touched: Places, kept: Column | None
    ) -> Places:
        """Write whole buckets, then the commit that points to them."""
        folder = f"data/commit={batch_id:020d}-{uuid.uuid4().hex}"
        rows = rows if kept is None else rows.where(kept)
        rows.write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        marks = [n for n in self.files.names(f"{self.path}/{folder}") if n.startswith(f"{BUCKET}=")]
        written = sorted(int(name.split("=")[1]) for name in marks)
        tries = [n for n in self.files.names(f"{self.path}/_commits") if n.startswith(f"{batch_id:020d}.")]
        if touched or written or tries:
            rest = set() if touched.of > commit["buckets"] else set(commit["held"]) - {str(b) for b in touched.numbers}
            held = {b: commit["held"][b] for b in rest} | {str(b): folder for b in written}
            used = set(held.values())
            counts = commit["written"] | {folder: len(written)}
            sizes = commit["bytes"] | {folder: self.files.size(f"{self.path}/{folder}")}
            new = {
                "held": held,
                "written": {f: counts[f] for f in used},
                "bytes": {f: sizes[f] for f in used},
                "buckets": touched.of,
            }
            name = f"{batch_id:020d}.{len(tries):04d}.json"
            if not self.files.publish(f"{self.path}/_commits/{name}", json.dumps(new)):
                raise RuntimeError(f"another writer published {name} of {self.path}")
            if len(self.files.names(f"{self.path}/_commits")) > 2 * KEPT_COMMITS:
                self.vacuum(KEPT_COMMITS)
        return touched if touched else Places(touched.of, written)

    def vacuum(self, keep: int = 2) -> int:
        """Remove folders that the newest ``keep`` commits do not use; returns how many.

        Folders of the newest batch or a later one stay: a writer may be filling them.
        """
        commits = self.files.names(f"{self.path}/_commits")
        used = set()
        for name in commits[-keep:]:
            used |= set(json.loads(self.files.read(f"{self.path}/_commits/{name}"))["written"])
        for name in commits[:-keep]:
            self.files.delete(f"{self.path}/_commits/{name}")
        newest = f"commit={self.last_batch():020d}"
        old = [name for name in self.files.names(f"{self.path}/data") if name.split("-")[0] < newest]
        stale = [f"data/{name}" for name in old if f"data/{name}" not in used]
        for folder in stale:
            self.files.delete(f"{self.path}/{folder}")
        return len(stale)
