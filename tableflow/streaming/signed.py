"""Feeds of signed rows: operators over change feeds whose results are feeds again.

A signed row is a row with a weight: +1 when it comes, -1 when it goes. ``signed`` turns changes by key into signed
rows; ``joined`` and ``grouped`` take signed rows and give signed rows, so that they chain in one query, in any
order; ``settled`` adds up what a query has written. State lies in Spark's state store, per key, join value or group, and is
checkpointed, replayed and restored with the query; types are those of the columns. Queries run in append mode.

A row may carry any weight, and rows equal in all columns are one row with their weights added. Null group values
are a group of their own; null join values meet nothing. Batches may be cut anywhere.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterable, Iterator, Mapping, Sequence
from decimal import ROUND_HALF_UP, Decimal, localcontext
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tableflow.operators.aggregates import Aggs, check
from tableflow.operators.joins import Pairs, check_kind
from tableflow.sources.changes import DELETE

WEIGHT = "_weight"
SIDE = "_side"
TOUCHED = "_touched"
FIRST = "_first"

# Hours that a row or group is kept without being touched.
LIFETIME = (1, 168)
# Rows with one join value that are kept in one piece.
FEW = 64
# Groups that rows without a join value are spread over.
ALONE = 1024
# Different values of a group that are kept in one piece with it.
FEW_VALUES = 64
# Best values of a group that are kept at hand for each minimum and maximum.
BEST = 16
# Doubles are summed as whole numbers of 2 ** -POINT, the smallest double.
POINT = 1074


def _same(row: Sequence) -> str:
    """Equal for rows equal in every value and type, for any type (NaN equals itself)."""
    return repr(tuple(row))


def _rank(value) -> tuple:
    """In Spark's order: null first, NaN last."""
    return (0,) if value is None else (2,) if value != value else (1, value)


def _struct(fields: Iterable[T.StructField]) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])


def _weighted(fields: Iterable[T.StructField]) -> T.StructType:
    return T.StructType([*_struct(fields).fields, T.StructField(WEIGHT, T.LongType())])


def _millis(hours: float) -> int:
    if not LIFETIME[0] <= hours <= LIFETIME[1]:
        raise ValueError(f"lifetime of {hours} hours, expected {LIFETIME[0]} to {LIFETIME[1]}")
    return int(hours * 3_600_000)


def _at(time) -> int:
    """Milliseconds of a time, up."""
    return -(-int(time.timestamp() * 1_000_000) // 1000)


class _Timed:
    """One event-time timer per key, whose time follows from the state."""

    def _move(self, old: int | None, new: int | None) -> None:
        if old == new:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        if new is not None:
            self.handle.registerTimer(new)


class _Versions(_Timed, StatefulProcessor):
    """Holds the newest change of a key; gives the old row with -1 and the new one with +1."""

    def __init__(self, schema: T.StructType, seq: Sequence[str], op: str, time: str | None, millis: int | None):
        names = schema.names
        self.schema, self.op, self.millis = schema, names.index(op), millis
        self.seq = [names.index(s) for s in seq]
        self.time = names.index(time) if time else None
        self.shown = [i for i, n in enumerate(names) if n != op]

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("row", self.schema)
        self.made = Row(*[self.schema.names[i] for i in self.shown], WEIGHT)

    def _order(self, row: Sequence) -> tuple:
        return tuple(_rank(row[i]) for i in self.seq), _same(row)

    def _image(self, row: Sequence | None, weight: int) -> Iterator[Row]:
        if row is not None and row[self.op] != DELETE:
            yield self.made(*[row[i] for i in self.shown], weight)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held, newest = self.held.get(), None
        for row in rows:
            if newest is None or self._order(row) > self._order(newest):
                newest = tuple(row)
        # A change as old as the held one is the same change again.
        if held is not None and self._order(newest)[0] <= self._order(held)[0]:
            return
        self.held.update(newest)
        if self.millis:
            self._move(_at(held[self.time]) + self.millis if held else None, _at(newest[self.time]) + self.millis)
        old, new = list(self._image(held, -1)), list(self._image(newest, 1))
        if not (old and new and _same(old[0][:-1]) == _same(new[0][:-1])):
            yield from old
            yield from new

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.held.get()
        self.held.clear()
        yield from self._image(held, -1)

    def close(self) -> None:
        pass


def signed(
    changes: DataFrame,
    keys: Sequence[str],
    seq: Sequence[str],
    op: str = "op",
    time: str | None = None,
    lifetime: float | None = None,
    delay: str = "0 seconds",
) -> DataFrame:
    """Changes by key as signed rows. ``keys`` name a row, ``seq`` orders its changes, ``op = 'd'`` is a delete.

    Of the changes of a key in one batch the newest counts; one that is not newer than the key's last is
    outdated. A delete leaves a marker, so that older changes stay outdated.

    With ``lifetime`` (hours) a row that no change has touched for so long, by ``time`` against the watermark
    (``delay`` behind the newest time), goes as if it were deleted, and everything made from it with it: joins and
    aggregates further on forget it too. Markers go in the same way. ``time`` must not be null then. In a query over
    several feeds the slowest one's watermark counts, unless ``spark.sql.streaming.multipleWatermarkPolicy`` is ``max``.
    """
    timed = lifetime is not None
    if timed and not time:
        raise ValueError("a lifetime needs a time")
    schema = _struct(changes.schema.fields)
    processor = _Versions(schema, seq, op, time, _millis(lifetime) if timed else None)
    rows = changes.withWatermark(time, delay) if timed else changes
    out = _weighted(f for f in schema.fields if f.name != op)
    return rows.groupBy(*keys).transformWithState(processor, out, "Append", "EventTime" if timed else "None")


def images(changes: DataFrame, before: str, after: str) -> DataFrame:
    """Changes that carry the row before and after (structs, null where there is none) as signed rows; no state."""
    def image(c: str, weight: int) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("row"), F.lit(weight).cast("long").alias(WEIGHT)))

    rows = changes.select(F.explode(F.array_compact(F.array(image(before, -1), image(after, 1)))).alias("_image"))
    return rows.select("_image.row.*", f"_image.{WEIGHT}")


class _Few:
    """Rows of one side with their weights, read with the group's state."""

    def __init__(self, rows: Iterable[tuple[Sequence, int]]):
        self.held = {_same(row): [row, n] for row, n in rows}

    def rows(self) -> Iterator[tuple[Sequence, int]]:
        return iter(list(self.held.values()))

    def add(self, row: Sequence, weight: int) -> None:
        entry = self.held.setdefault(_same(row), [row, 0])
        entry[1] += weight
        if not entry[1]:
            del self.held[_same(row)]


class _Many:
    """Rows of one side with their weights, in a state of their own that is read row by row."""

    def __init__(self, state):
        self.state = state

    def rows(self) -> Iterator[tuple[Sequence, int]]:
        return ((row, n) for row, (n,) in self.state.iterator())

    def add(self, row: Sequence, weight: int) -> None:
        n = weight + (self.state.getValue(row) or (0,))[0]
        if n:
            self.state.updateValue(row, (n,))
        else:
            self.state.removeKey(row)


class _Partners(StatefulProcessor):
    """Rows of both sides with one join value, as weights per row; gives what a batch changes in their join.

    Up to ``FEW`` rows lie in one value, read and written at once; a group that has had more keeps them row by row.
    """

    def __init__(self, schemas: Sequence[T.StructType], outer: Sequence[bool], at: int, names: Sequence[str], few: int):
        self.schemas, self.outer, self.at, self.names, self.limit = list(schemas), list(outer), at, list(names), few

    def init(self, handle) -> None:
        self.many = [_Many(handle.getMapState(n, s, "n long")) for n, s in zip(("left", "right"), self.schemas, strict=True)]
        self.group = handle.getValueState("group", "left long, right long, rows binary")
        self.made = Row(*self.names)

    def _row(self, side: int, own: Sequence, other: Sequence | None, weight: int) -> Row:
        other = (None,) * len(self.schemas[1 - side]) if other is None else other
        return self.made(*(own, other)[side], *(other, own)[side], weight)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if None in key:
            for row in rows:
                begin = self.at + 2 + row[self.at] * len(self.schemas[0])
                yield self._row(row[self.at], row[begin : begin + len(self.schemas[row[self.at]])], None, row[self.at + 1])
            return
        net = (_Few(()), _Few(()))
        for row in rows:
            side, weight = row[self.at], row[self.at + 1]
            begin = self.at + 2 + side * len(self.schemas[0])
            net[side].add(tuple(row[begin : begin + len(self.schemas[side])]), weight)
        delta = [list(d.rows()) for d in net]
        held = self.group.get()
        before = list(held[:2]) if held else [0, 0]
        after = [n + sum(w for _, w in d) for n, d in zip(before, delta)]
        few = held is None or held[2] is not None
        sides = [_Few(x) for x in (pickle.loads(held[2]) if held else ((), ()))] if few else self.many
        # Changed left rows meet the right rows as they were; changed right rows the left ones as they are now.
        for side, met in ((0, before[1]), (1, after[0])):
            if delta[side] and met:
                for row, n in sides[1 - side].rows():
                    for own, weight in delta[side]:
                        yield self._row(side, own, row, n * weight)
            yield from self._alone(side, sides[side], delta[side], before[1 - side], after[1 - side])
            for own, weight in delta[side]:
                sides[side].add(own, weight)
        if few and sum(len(s.held) for s in sides) > self.limit:
            for many, side in zip(self.many, sides):
                for row, n in side.rows():
                    many.add(row, n)
            few = False
        if any(after) or few and any(s.held for s in sides):
            self.group.update((*after, pickle.dumps([list(s.rows()) for s in sides]) if few else None))
        elif few:
            self.group.clear()
        else:
            self.group.update((0, 0, None))

    def _alone(self, side: int, held: _Few | _Many, delta: list, before: int, after: int) -> Iterator[Row]:
        """Rows of an outer side that lose or find their partners; ``delta`` is not taken in yet."""
        if not self.outer[side] or before and after:
            return
        if before or after:
            for row, n in held.rows():
                yield self._row(side, row, None, -n if after else n)
        if not after:
            for own, weight in delta:
                yield self._row(side, own, None, weight)

    def close(self) -> None:
        pass


def _salts(how: str, salt: int) -> int | None:
    """The side whose rows are dealt over the salts; the other is copied to each."""
    if salt < 2:
        return None
    if how == "full":
        raise ValueError("a full join of feeds takes no salt: copies of a side cannot tell whether one of them met a partner")
    return 1 if how == "right" else 0


def joined(
    left: DataFrame, right: DataFrame, on: Pairs, how: str = "inner", prefixes: tuple[str, str] = ("l_", "r_"), salt: int = 1
) -> DataFrame:
    """The join of two feeds of signed rows, as a feed; columns carry the prefixes.

    State holds the rows of both sides per join value, as in the tables they stand for. ``salt`` cuts the
    rows of a join value: those of one side (the left; in a right join the right) are dealt out by their hash,
    the others copied ``salt`` times, in state too.
    """
    check_kind(how)
    frames, pairs = (left, right), list(on)
    outer = (how in ("left", "full"), how in ("right", "full"))
    columns = [[c for c in f.columns if c != WEIGHT] for f in frames]
    schemas = [_struct(f.schema[c] for c in cs) for f, cs in zip(frames, columns)]
    dealt = _salts(how, salt)
    out = T.StructType(
        [T.StructField(p + f.name, f.dataType) for p, s in zip(prefixes, schemas) for f in s.fields]
        + [T.StructField(WEIGHT, T.LongType())]
    )
    parts = []
    for side, frame in enumerate(frames):
        values = [F.col(f"`{pair[side]}`") for pair in pairs]
        known = reduce(lambda a, b: a & b, [v.isNotNull() for v in values])
        given = [
            (F.col(f"`{f.name}`") if s == side else F.lit(None).cast(f.dataType)).alias(f"_row{s}_{i}")
            for s in (0, 1)
            for i, f in enumerate(schemas[s].fields)
        ]
        spread = F.xxhash64(*[F.col(f"`{c}`") for c in columns[side]])
        if dealt is None:
            salts = F.array(F.lit(0))
        elif dealt == side:
            salts = F.array(F.pmod(spread, F.lit(salt)).cast("int"))
        else:
            salts = F.array(*[F.lit(i) for i in range(salt)])
        # Rows without a join value stay alone, wherever they go; they leave no state.
        salts = F.when(known, salts).otherwise(F.array(F.pmod(spread, F.lit(ALONE)).cast("int")))
        picked = [*[v.alias(f"_on{i}") for i, v in enumerate(values)], F.explode(salts).alias("_salt"), F.lit(side).alias(SIDE), WEIGHT, *given]
        parts.append((frame if outer[side] else frame.where(known)).select(*picked))
    keys = [*[f"_on{i}" for i in range(len(pairs))], "_salt"]
    processor = _Partners(schemas, outer, len(keys), out.names, FEW)
    return parts[0].union(parts[1]).groupBy(*keys).transformWithState(processor, out, "Append", "None")


def _text(units: int) -> str:
    """A whole number as text, without the zeros at its end: a sum of doubles has hundreds."""
    digits = f"{units:x}"
    short = digits.rstrip("0")
    return f"{short}.{len(digits) - len(short)}"


def _units(text: str) -> int:
    digits, zeros = text.split(".")
    return int(digits or "0", 16) << 4 * int(zeros)


class _Summing:
    """Exact sums of a column: whole numbers of its smallest unit, in text, with NaN and infinities counted apart."""

    def __init__(self, kind: T.DataType):
        self.kind = kind
        self.floating = isinstance(kind, (T.FloatType, T.DoubleType))
        self.scale = kind.scale if isinstance(kind, T.DecimalType) else 0

    def units(self, value) -> int:
        if self.floating:
            n, d = value.as_integer_ratio()
            return n << (POINT + 1 - d.bit_length())
        if isinstance(value, Decimal):
            negative, digits, exponent = value.as_tuple()
            n = int("".join(map(str, digits))) * 10 ** (exponent + self.scale)
            return -n if negative else n
        return int(value)

    def odd(self, value) -> int | None:
        """0, 1 or 2 for NaN and the infinities, which have no units."""
        if not self.floating or value - value == 0:
            return None
        return 0 if value != value else 1 if value > 0 else 2

    def total(self, units: int, odd: Sequence[int]):
        """The sum, rounded once."""
        if self.floating:
            if odd[0] or odd[1] and odd[2]:
                return float("nan")
            if odd[1] or odd[2]:
                return float("inf") if odd[1] else float("-inf")
            try:
                return units / (1 << POINT)
            except OverflowError:
                return float("inf") if units > 0 else float("-inf")
        if isinstance(self.kind, T.DecimalType):
            return Decimal((units < 0, tuple(map(int, str(abs(units)))), -self.scale))
        return units

    def result(self) -> T.DataType:
        if self.floating:
            return T.DoubleType()
        if isinstance(self.kind, T.DecimalType):
            return T.DecimalType(min(38, self.kind.precision + 10), self.scale)
        return T.LongType()

    def mean_type(self) -> T.DataType:
        if isinstance(self.kind, T.DecimalType):
            return T.DecimalType(min(38, self.kind.precision + 4), min(38, self.kind.scale + 4))
        return T.DoubleType()

    def mean(self, total, n: int):
        if not isinstance(total, Decimal):
            return total / n
        with localcontext(prec=100):
            return (total / n).quantize(Decimal((0, (1,), -self.mean_type().scale)), ROUND_HALF_UP)


class _Plan:
    """Aggregates by what they need: a count, exact sums, or the values themselves."""

    def __init__(self, schema: T.StructType, by: Sequence[str], aggs: Aggs):
        check(aggs)
        self.by, self.aggs = list(by), dict(aggs)
        self.kinds = {f.name: f.dataType for f in schema.fields}
        columns = {kind: sorted({c for n, c in self.aggs.values() if n in kind}) for kind in (("sum", "avg"), ("min", "max"))}
        self.sums = {c: _Summing(self.kinds[c]) for c in columns["sum", "avg"]}
        self.values = columns["min", "max"]
        self.counts = sorted({c for _, c in self.aggs.values() if c != "*"})
        # A piece and the state of a group hold no structs: Spark hands these over in another form than rows.
        longs = T.ArrayType(T.LongType())
        self.core = [T.StructField("rows", T.LongType()), T.StructField("counts", longs)]
        for i, _ in enumerate(self.sums):
            self.core += [T.StructField(f"units{i}", T.StringType()), T.StructField(f"odd{i}", longs)]
        self.by_fields = list(_struct(schema[c] for c in self.by).fields)

    def piece(self) -> T.StructType:
        lists = []
        for i, c in enumerate(self.values):
            lists += [T.StructField(f"values{i}", T.ArrayType(self.kinds[c])), T.StructField(f"times{i}", T.ArrayType(T.LongType()))]
        return T.StructType([*self.by_fields, *self.core, *lists])

    def out(self) -> T.StructType:
        fields = []
        for alias, (name, column) in self.aggs.items():
            if name == "count":
                kind = T.LongType()
            elif name in ("min", "max"):
                kind = self.kinds[column]
            else:
                kind = self.sums[column].result() if name == "sum" else self.sums[column].mean_type()
            fields.append(T.StructField(alias, kind))
        return _weighted([*self.by_fields, *fields])

    def result(self, core: Sequence, extremes: Mapping) -> list:
        """Aggregates from the state of a group."""
        counts, out = dict(zip(self.counts, core[1])), []
        for alias, (name, column) in self.aggs.items():
            n = core[0] if column == "*" else counts[column]
            if name == "count":
                out.append(n)
            elif name in ("min", "max"):
                out.append(extremes[alias])
            elif not n:
                out.append(None)
            else:
                at = 2 + 2 * list(self.sums).index(column)
                units, odd = core[at : at + 2]
                total = self.sums[column].total(units, odd)
                out.append(total if name == "sum" else self.sums[column].mean(total, n))
        return out


def _pieces(plan: _Plan, first: str | None, last: str | None, millis: int | None):
    """Adds the signed rows of an Arrow batch up to a row per group, for ``mapInArrow``.

    With a lifetime there is a row per group and cell of that width, in which no gap is wide enough to end a lifetime.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict = {}
            for row in batch.to_pylist():
                time = row.get(first) if first else None
                cell = _at(time) // millis if millis else None
                key = _same([row[c] for c in plan.by]) + f"/{cell}"
                g = groups.get(key)
                if g is None:
                    g = groups[key] = {c: row[c] for c in plan.by} | {
                        "rows": 0, "counts": [0] * len(plan.counts), "sums": {c: [0, [0, 0, 0]] for c in plan.sums}, "values": {c: {} for c in plan.values}, FIRST: time, TOUCHED: time,
                    }
                weight = row[WEIGHT]
                g["rows"] += weight
                if first:
                    g[FIRST], g[TOUCHED] = min(g[FIRST], time), max(g[TOUCHED], time)
                for i, c in enumerate(plan.counts):
                    g["counts"][i] += weight * (row[c] is not None)
                for c, summing in plan.sums.items():
                    if (value := row[c]) is not None:
                        odd, sums = summing.odd(value), g["sums"][c]
                        if odd is None:
                            sums[0] += weight * summing.units(value)
                        else:
                            sums[1][odd] += weight
                for c in plan.values:
                    if (value := row[c]) is not None:
                        entry = g["values"][c].setdefault(_same((value,)), [value, 0])
                        entry[1] += weight
            out = []
            for g in groups.values():
                sums, values = g.pop("sums"), g.pop("values")
                for i, (units, odd) in enumerate(sums.values()):
                    g |= {f"units{i}": _text(units), f"odd{i}": odd}
                for i, of in enumerate(values.values()):
                    left = [(v, n) for v, n in of.values() if n]
                    g |= {f"values{i}": [v for v, _ in left], f"times{i}": [n for _, n in left]}
                out.append(g)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema(batch.schema))

    def schema(given: pa.Schema) -> pa.Schema:
        longs = pa.list_(pa.int64())
        fields = [*[(c, given.field(c).type) for c in plan.by], ("rows", pa.int64()), ("counts", longs)]
        for i, _ in enumerate(plan.sums):
            fields += [(f"units{i}", pa.string()), (f"odd{i}", longs)]
        for i, c in enumerate(plan.values):
            fields += [(f"values{i}", pa.list_(given.field(c).type)), (f"times{i}", longs)]
        if first:
            fields += [(FIRST, given.field(first).type), (TOUCHED, given.field(last).type)]
        return pa.schema(fields)

    return run


class _Group(_Timed, StatefulProcessor):
    """State of one group: counts, exact sums, and the values under a minimum or maximum with the best ones at hand.

    Up to ``FEW_VALUES`` different values of a column lie with the group, read and written at once; a group that has had
    more keeps them one by one.
    """

    def __init__(self, plan: _Plan, millis: int | None, until: str | None, few: int):
        self.plan, self.millis, self.few = plan, millis, few
        names = plan.piece().names
        self.n_by = len(plan.by)
        self.lists = len(names) - 2 * len(plan.values)
        self.until = plan.by.index(until) if until else None
        self.extremes = {a: (n == "max", c) for a, (n, c) in plan.aggs.items() if n in ("min", "max")}

    def init(self, handle) -> None:
        self.handle = handle
        core = [*self.plan.core, T.StructField(TOUCHED, T.LongType()), T.StructField("refills", T.LongType())]
        for i, (_, column) in enumerate(self.extremes.values()):
            core.append(T.StructField(f"best{i}", T.ArrayType(self.plan.kinds[column])))
        self.made = Row(*self.plan.out().names)
        longs = T.ArrayType(T.LongType())
        for i, c in enumerate(self.plan.values):
            core += [T.StructField(f"few{i}", T.ArrayType(self.plan.kinds[c])), T.StructField(f"times{i}", longs)]
        self.state = handle.getValueState("group", T.StructType([*core, T.StructField("distinct", longs)]))
        self.values = [
            handle.getMapState(f"values{i}", T.StructType([T.StructField("v", self.plan.kinds[c])]), "n long")
            for i, c in enumerate(self.plan.values)
        ]

    def _empty(self) -> dict:
        plan = self.plan
        return {
            "rows": 0, "counts": [0] * len(plan.counts), "sums": [[0, [0, 0, 0]] for _ in plan.sums], "touched": None,
            "refills": 0, "best": [[] for _ in self.extremes], "distinct": [0] * len(plan.values), "few": [{} for _ in plan.values],
        }

    def _load(self) -> dict | None:
        held = self.state.get()
        if held is None:
            return None
        n = len(self.plan.core)
        sums = [[_units(units), list(odd)] for units, odd in zip(held[2:n:2], held[3:n:2])]
        lists = n + 2 + len(self.extremes)
        best = [list(x) for x in held[n + 2 : lists]]
        few = [
            None if values is None else {_same((v,)): [v, times] for v, times in zip(values, counts)}
            for values, counts in zip(held[lists:-1:2], held[lists + 1 : -1 : 2])
        ]
        return {
            "rows": held[0], "counts": list(held[1]), "sums": sums, "touched": held[n], "refills": held[n + 1], "best": best,
            "distinct": list(held[-1]), "few": few,
        }

    def _save(self, g: dict) -> None:
        sums = [x for units, odd in g["sums"] for x in (_text(units), odd)]
        lists = []
        for values, few in zip(self.values, g["few"]):
            if few is not None and len(few) > self.few:
                for value, n in few.values():
                    values.updateValue((value,), (n,))
                few = None
            lists += [None, None] if few is None else [[v for v, _ in few.values()], [n for _, n in few.values()]]
        self.state.update((g["rows"], g["counts"], *sums, g["touched"], g["refills"], *g["best"], *lists, g["distinct"]))

    def _forget(self, g: dict) -> None:
        """Values that are kept one by one."""
        for values, few in zip(self.values, g["few"]):
            if few is None:
                values.clear()

    def _timer(self, key: Sequence, g: dict | None) -> int | None:
        """When the timer of a group with this state is due."""
        if g is None or not (self.millis or self.until is not None):
            return None
        return g["touched"] + self.millis if self.millis else _at(key[self.until])

    def _result(self, key: Sequence, g: dict | None, weight: int) -> list[Row]:
        if g is None or g["rows"] <= 0:
            return []
        best = {a: b[0] if b else None for a, b in zip(self.extremes, g["best"])}
        core = (g["rows"], g["counts"], *[x for sums in g["sums"] for x in sums])
        return [self.made(*key, *self.plan.result(core, best), weight)]

    def _change(self, key: Sequence, old: list[Row], new: list[Row]) -> Iterator[Row]:
        if not (old and new and _same(old[0][:-1]) == _same(new[0][:-1])):
            yield from old
            yield from new

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        g = self._load()
        known, due = g is not None, self._timer(key, g)
        old = self._result(key, g, -1)
        pieces = sorted(rows, key=lambda r: r[FIRST]) if self.millis else rows
        for piece in pieces:
            if self.millis and g is not None and _at(piece[FIRST]) > g["touched"] + self.millis:
                self._forget(g)
                g = None
            if g is None:
                g = self._empty()
            self._add(g, piece)
        self._settle(g)
        yield from self._change(key, old, self._result(key, g, 1))
        if not g["rows"] and not any(g["counts"]) and not any(g["distinct"]):
            self._forget(g)
            if known:
                self.state.clear()
                self._move(due, None)
            return
        self._save(g)
        self._move(due, self._timer(key, g))

    def _add(self, g: dict, piece: Row) -> None:
        at = self.n_by
        g["rows"] += piece[at]
        g["counts"] = [a + b for a, b in zip(g["counts"], piece[at + 1])]
        for held, units, odd in zip(g["sums"], piece[at + 2 : self.lists : 2], piece[at + 3 : self.lists : 2]):
            held[0] += _units(units)
            held[1] = [a + b for a, b in zip(held[1], odd)]
        for i, column in enumerate(self.plan.values):
            for value, n in zip(piece[self.lists + 2 * i], piece[self.lists + 2 * i + 1]):
                self._count(g, i, column, value, n)
        if self.millis:
            g["touched"] = max(g["touched"] or 0, _at(piece[TOUCHED]))

    def _count(self, g: dict, i: int, column: str, value, n: int) -> None:
        """Add to the count of a value; keep the lists of best values right."""
        values, key, few = self.values[i], (value,), g["few"][i]
        before = ((values.getValue(key) or (0,))[0]) if few is None else few.get(_same(key), (value, 0))[1]
        if few is not None:
            few[_same(key)] = [value, before + n]
            if not before + n:
                del few[_same(key)]
        elif before + n:
            values.updateValue(key, (before + n,))
        else:
            values.removeKey(key)
        came, went = before <= 0 < before + n, before + n <= 0 < before
        if not (came or went):
            return
        known = g["distinct"][i]
        g["distinct"][i] += 1 if came else -1
        for best, (largest, of) in zip(g["best"], self.extremes.values()):
            if of != column:
                continue
            place = next((k for k, v in enumerate(best) if _same((v,)) == _same(key)), None)
            if went and place is not None:
                del best[place]
            elif came and (len(best) == known or best and (_rank(value) > _rank(best[-1])) == largest):
                best.append(value)
                best.sort(key=_rank, reverse=largest)
                del best[BEST:]

    def _settle(self, g: dict) -> None:
        """Read the values again for the lists that ran dry."""
        for best, (largest, column) in zip(g["best"], self.extremes.values()):
            i = self.plan.values.index(column)
            if not best and g["distinct"][i]:
                few = g["few"][i]
                every = few.values() if few is not None else ((key[0], n) for key, (n,) in self.values[i].iterator())
                held = (value for value, n in every if n > 0)
                best[:] = (heapq.nlargest if largest else heapq.nsmallest)(BEST, held, key=_rank)
                g["refills"] += 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """A lifetime that ends takes the group back; a window that ends leaves its result as it is."""
        g = self._load()
        if g is not None:
            self._forget(g)
            self.state.clear()
        if self.millis:
            yield from self._result(key, g, -1)

    def close(self) -> None:
        pass


def grouped(
    rows: DataFrame,
    by: Sequence[str],
    aggs: Aggs,
    time: str | None = None,
    lifetime: float | None = None,
    until: str | None = None,
    delay: str = "0 seconds",
) -> DataFrame:
    """``GROUP BY by`` over signed rows, as a feed; a group without rows goes.

    Each task adds up its rows before the shuffle, so a hot group costs a piece per Arrow batch. Counts and sums are exact:
    doubles are summed without rounding and rounded once, for any order of rows coming and going. For a
    minimum or maximum the different values are counted in the state and the best ``BEST`` are at hand; the others are read
    only when those have all gone.

    ``lifetime`` (hours): a group without a row for so long, by ``time``, is forgotten and starts again; each row
    renews it. ``until`` names the column of ``by`` that holds the end of a window: behind the
    watermark (``delay`` behind the latest end) a window's state goes, its result stays, and rows for it are late.
    """
    if lifetime is not None and until is not None:
        raise ValueError("either a lifetime or windows that end")
    plan = _Plan(rows.schema, by, aggs)
    millis = _millis(lifetime) if lifetime is not None else None
    timed = time if millis else until
    fields = plan.piece().fields
    if timed:
        fields = [*fields, T.StructField(FIRST, rows.schema[timed].dataType), T.StructField(TOUCHED, rows.schema[timed].dataType)]
    used = list(dict.fromkeys([*plan.by, *plan.counts, *([timed] if timed else []), WEIGHT]))
    pieces = rows.select(*used).mapInArrow(_pieces(plan, timed, timed, millis), T.StructType(fields))
    if timed:
        pieces = pieces.withWatermark(TOUCHED, delay)
    mode = "EventTime" if timed else "None"
    return pieces.groupBy(*by).transformWithState(_Group(plan, millis, until, FEW_VALUES), plan.out(), "Append", mode)


def plain(rows: DataFrame) -> DataFrame:
    """Rows that only ever come, as signed rows."""
    return rows.withColumn(WEIGHT, F.lit(1).cast("long"))


def as_changes(rows: DataFrame, keys: Sequence[str], batch_id: int) -> DataFrame:
    """One batch of a feed as changes by key for a keyed target: ``op``, ordered by ``_batch`` and ``_step``.

    ``keys`` must name a row of the feed. A row that goes and comes again with other values is written once.
    """
    columns = [c for c in rows.columns if c != WEIGHT]
    net = rows.groupBy(*columns).agg(F.sum(WEIGHT).alias(WEIGHT)).where(F.col(WEIGHT) != 0)
    comes = F.col(WEIGHT) > 0
    changes = net.select(
        *columns,
        F.when(comes, "u").otherwise(DELETE).alias("op"),
        F.lit(batch_id).cast("long").alias("_batch"),
        comes.cast("int").alias("_step"),
    )
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*changes.columns), "_step").alias("_row")).select("_row.*")


def settled(rows: DataFrame) -> DataFrame:
    """The rows that stand after all signed rows of a table, each as often as its weights say."""
    columns = [c for c in rows.columns if c != WEIGHT]
    left = rows.groupBy(*columns).agg(F.sum(WEIGHT).alias(WEIGHT)).where(F.col(WEIGHT) > 0)
    return left.select(*columns, F.explode(F.sequence(F.lit(1), F.col(WEIGHT))).alias(WEIGHT)).drop(WEIGHT)
