"""Feeds of signed rows against plain Python, for any cut into batches."""

import datetime as dt
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tableflow.session import work_dir
from tableflow.sources.tables import stream_slices
from tableflow.streaming import signed as feeds
from tableflow.streaming.runner import drain, read_output
from tests.conftest import rows

HOUR = dt.timedelta(hours=1)
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


class Fed:
    """A stream that is given its batches one by one, and the query over it."""

    def __init__(self, spark, schema):
        self.spark, self.schema, self.base = spark, schema, work_dir(spark, "fed")
        self.stream = stream_slices(spark, f"{self.base}/in", spark.createDataFrame([], schema).schema)
        self.n = 0

    def into(self, query):
        self.query = query
        return self

    def give(self, batch):
        frame = self.spark.createDataFrame(batch, self.schema) if isinstance(batch, list) else batch
        frame.coalesce(1).write.parquet(f"{self.base}/in/part={self.n}")
        self.n += 1
        drain(self.query, f"{self.base}/checkpoint", path=f"{self.base}/out")
        return self.written()

    def written(self):
        return read_output(self.spark, f"{self.base}/out", self.query)


@pytest.fixture(autouse=True)
def few_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture
def newest_watermark(spark):
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "max")
    yield
    spark.conf.unset("spark.sql.streaming.multipleWatermarkPolicy")


FEED = "side string, k int, op string, g string, v int, d double, seq int"


def changes(pick, n, seq, keys=12):
    """Changes of three tables, some older than others and some given twice."""
    out = []
    for _ in range(n):
        seq += 1
        value = pick.choice([None, 0.1, -0.1, 1e300, -1e300, 1e-300, 3.3])
        out.append((pick.choice("abc"), pick.randrange(keys), pick.choice(["u", "u", "u", "d", None]), pick.choice([None, "x", "y"]), pick.choice([None, 1, 2, 7]), value, seq))
    out += [pick.choice(out) for _ in range(3)]
    pick.shuffle(out)
    return out, seq


def live(seen, side):
    held = {}
    for row in seen:
        if row[0] == side and (row[1] not in held or row[-1] > held[row[1]][-1]):
            held[row[1]] = row
    return [r for r in held.values() if r[2] != "d"]


def side(stream, name):
    return feeds.signed(stream.where(F.col("side") == name).drop("side"), ["k"], ["seq"])


def pairs(left, right, how):
    """Left rows point to the keys of right ones."""
    out = [(a, b) for a in left for b in right if a[4] is not None and a[4] == b[1]]
    if how in ("left", "full"):
        out += [(a, None) for a in left if not any(a[4] == b[1] for b in right)]
    if how in ("right", "full"):
        out += [(None, b) for b in right if not any(a[4] == b[1] for a in left)]
    return out


@pytest.mark.parametrize("how,salt", [("inner", 3), ("left", 2), ("right", 1), ("full", 1)])
def test_join_follows_every_batch(spark, monkeypatch, how, salt):
    # Groups grow out of one piece on their way.
    monkeypatch.setattr(feeds, "FEW", 3)
    pick, seen, seq = random.Random(how), [], 0
    fed = Fed(spark, FEED)
    fed.into(feeds.joined(side(fed.stream, "a"), side(fed.stream, "b"), [("v", "k")], how, salt=salt))
    for _ in range(3):
        batch, seq = changes(pick, 60, seq, keys=8)
        seen += batch
        got = feeds.settled(fed.give(batch)).select("l_k", "l_seq", "r_k", "r_seq")
        want = [(a and a[1], a and a[-1], b and b[1], b and b[-1]) for a, b in pairs(live(seen, "a"), live(seen, "b"), how)]
        assert rows(got) == sorted(want, key=repr)
    assert want


def summed(values):
    some = [v for v in values if v is not None]
    if not some:
        return (0, None, None, None, None)
    total = math.fsum(some)
    return (len(some), total, total / len(some), min(some), max(some))


def test_join_of_three_feeds_into_an_aggregate(spark):
    pick, seen, seq = random.Random(5), [], 0
    fed = Fed(spark, FEED)
    two = feeds.joined(side(fed.stream, "a"), side(fed.stream, "b"), [("v", "k")], prefixes=("", "b_"))
    three = feeds.joined(two, side(fed.stream, "c"), [("b_v", "k")], "left", prefixes=("", "c_"))
    aggs = {"n": ("count", "*"), "nd": ("count", "c_d"), "s": ("sum", "c_d"), "a": ("avg", "c_d"), "lo": ("min", "c_d"), "hi": ("max", "c_d")}
    fed.into(feeds.grouped(three, ["g"], aggs))
    for _ in range(3):
        batch, seq = changes(pick, 60, seq, keys=8)
        seen += batch
        got = feeds.settled(fed.give(batch))
        groups = {}
        for a, b in pairs(live(seen, "a"), live(seen, "b"), "inner"):
            for _, c in pairs([(*b[:4], b[4], *b[5:])], live(seen, "c"), "left"):
                groups.setdefault(a[3], []).append(c and c[5])
        want = [(g, len(v), *summed(v)) for g, v in groups.items()]
        assert rows(got) == sorted(want, key=repr)
    assert want


def test_sums_extremes_and_types_stay_exact(spark):
    kinds = "k long, op string, g string, i long, m decimal(38,2), f float, t timestamp, s string, x double, y array<int>, seq long"
    late, early = dt.datetime(9999, 12, 31, 23, 59, 59, 999999, dt.timezone.utc), dt.datetime(1, 1, 2, tzinfo=dt.timezone.utc)
    big = 2**62 + 1

    def change(k, op, i, m, f, t, s, x, seq, g="g"):
        return (k, op, g, i, Decimal(m) if m else None, f, t, s, x, [k], seq)

    first = [
        change(1, "u", big, "999999999999999999999999999999.99", 0.1, late, "zß€", 1e308, 1),
        change(2, "u", -7, "0.01", None, early, "", 1e308, 1),
        change(3, "u", None, None, 1.5, None, None, -1e308, 1),
        change(4, "u", 3, "-0.02", math.inf, None, "a", math.inf, 1),
        change(5, "u", 3, "-0.02", math.nan, None, "a", math.nan, 1),
    ]
    fed = Fed(spark, kinds)
    aggs = {f"{name}_{c}": (name, c) for c in "imfx" for name in ("sum", "avg", "min", "max")} | {"lo_t": ("min", "t"), "hi_t": ("max", "t"), "lo_s": ("min", "s"), "hi_s": ("max", "s"), "n_y": ("count", "y")}
    fed.into(feeds.grouped(feeds.signed(fed.stream, ["k"], ["seq"]), ["g"], aggs))
    (got,) = [r.asDict() for r in feeds.settled(fed.give(first)).collect()]
    assert got["sum_i"] == big - 1 and got["max_i"] == big and got["min_i"] == -7
    assert got["sum_m"] == Decimal("999999999999999999999999999999.96") and math.isnan(got["sum_x"]) and math.isnan(got["max_x"])
    assert (got["lo_t"], got["hi_t"]) == tuple(x.astimezone().replace(tzinfo=None) for x in (early, late)) or got["hi_t"].year == 9999
    assert (got["lo_s"], got["hi_s"], got["n_y"]) == ("", "zß€", 5)
    (got,) = [r.asDict() for r in feeds.settled(fed.give([change(5, "d", None, None, None, None, None, None, 2)])).collect()]
    assert got["sum_x"] == math.inf and got["max_x"] == math.inf and got["sum_f"] == math.inf
    (got,) = [r.asDict() for r in feeds.settled(fed.give([change(4, "d", None, None, None, None, None, None, 2)])).collect()]
    # 1e308 + 1e308 does not fit a double on its way.
    assert got["sum_x"] == 1e308 and got["avg_x"] == 1e308 / 3 and got["sum_i"] == big - 7
    assert got["sum_f"] == math.fsum([float(spark.range(1).select(F.lit(0.1).cast("float")).first()[0]), 1.5])
    gone = [change(k, "d", None, None, None, None, None, None, 3) for k in (1, 2, 3)]
    assert feeds.settled(fed.give(gone)).count() == 0


def test_values_are_read_again_only_when_the_best_have_gone(spark):
    fed = Fed(spark, "k int, op string, g string, v int, seq int")
    fed.into(feeds.grouped(feeds.signed(fed.stream, ["k"], ["seq"]), ["g"], {"lo": ("min", "v"), "hi": ("max", "v")}))
    assert rows(feeds.settled(fed.give([(k, "u", "g", k, 1) for k in range(100)]))) == [("g", 0, 99)]

    def refills():
        state = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "group").load(f"{fed.base}/checkpoint")
        return state.select("value.refills").first()[0]

    # Both lists hold sixteen values: ten that go leave six.
    assert rows(feeds.settled(fed.give([(k, "d", None, None, 2) for k in range(10)]))) == [("g", 10, 99)] and refills() == 0
    assert rows(feeds.settled(fed.give([(k, "d", None, None, 2) for k in range(10, 30)]))) == [("g", 30, 99)] and refills() == 1
    assert rows(feeds.settled(fed.give([(k, "u", "g", -k, 3) for k in range(40, 99)]))) == [("g", -98, 99)] and refills() == 1


def test_values_lie_with_their_group_until_they_are_many(spark):
    fed = Fed(spark, "k int, v double, ts timestamp")
    fed.into(feeds.grouped(feeds.plain(fed.stream), ["k"], {"lo": ("min", "v"), "hi": ("max", "v")}, time="ts", lifetime=12))

    def give(*given):
        return rows(feeds.settled(fed.give([(k, float(v), START + hour * HOUR) for k, v, hour in given])))

    def apart():
        state = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "values0")
        return state.load(f"{fed.base}/checkpoint").count()

    assert give(*[(1, v, v / 100) for v in range(100)], (2, 5, 0)) == [(1, 0.0, 99.0), (2, 5.0, 5.0)] and apart() == 100
    # The life of key 1 has ended and its values go; key 2 lives on.
    assert give((1, 7, 14), (2, 6, 11)) == [(1, 7.0, 7.0), (2, 5.0, 6.0)] and apart() == 0


def stamped(*given):
    return [(k, op, v, START + hour * HOUR, n) for n, (k, op, v, hour) in enumerate(given)]


TIMED = "k int, op string, v int, ts timestamp, seq int"


def test_rows_that_nothing_touches_are_forgotten_with_what_was_made_of_them(spark, newest_watermark):
    fed = Fed(spark, "side string, " + TIMED)

    def timed(name):
        return feeds.signed(fed.stream.where(F.col("side") == name).drop("side"), ["k"], ["seq"], time="ts", lifetime=12)

    met = feeds.joined(timed("a"), timed("b"), [("k", "k")])
    fed.into(feeds.grouped(met, ["l_k"], {"n": ("count", "*"), "s": ("sum", "l_v")}))

    def give(*given):
        return rows(feeds.settled(fed.give([(side, k, op, v, START + hour * HOUR, hour) for side, k, op, v, hour in given])))

    assert give(("a", 1, "u", 10, 0), ("b", 1, "u", 0, 5), ("a", 2, "u", 20, 1), ("b", 2, "u", 0, 1)) == [(1, 1, 10), (2, 1, 20)]
    # Touched again at 10: key 1 lives on, key 2 ends at 13.
    assert give(("a", 1, "u", 11, 10), ("a", 3, "u", 30, 12)) == [(1, 1, 11), (2, 1, 20)]
    assert give(("a", 4, "u", 0, 14)) == [(1, 1, 11)]
    assert give(("b", 3, "u", 0, 16)) == [(1, 1, 11), (3, 1, 30)]
    # A partner that comes after a row was forgotten meets nothing.
    assert give(("a", 5, "u", 0, 40)) == []
    assert give(("b", 1, "u", 0, 41), ("b", 5, "u", 0, 41)) == [(5, 1, 0)]
    with pytest.raises(ValueError, match="lifetime"):
        feeds.signed(fed.stream, ["k"], ["seq"], time="ts", lifetime=169)


def lifetimes(events, hours):
    """Groups whose last row is at most so many hours behind the newest of all, since their last longer gap."""
    held = {}
    for k, v, hour in sorted(events, key=lambda e: e[2]):
        last = held.get(k)
        held[k] = (last[0] + 1, last[1] + v, hour) if last and hour - last[2] <= hours else (1, v, hour)
    newest = max(e[2] for e in events)
    return sorted((k, n, s) for k, (n, s, hour) in held.items() if newest - hour < hours)


def test_groups_start_again_after_their_lifetime(spark):
    pick = random.Random(9)
    events = [(pick.randrange(8), pick.choice([2**60, 1, 5]), pick.randrange(2000) / 10 + 0.01 * i) for i in range(120)]
    events.sort(key=lambda e: e[2])
    fed = Fed(spark, "k int, v long, ts timestamp")
    fed.into(feeds.grouped(feeds.plain(fed.stream), ["k"], {"n": ("count", "*"), "s": ("sum", "v")}, time="ts", lifetime=12))
    for end in (50, 90, 120):
        batch = [(k, v, START + hour * HOUR) for k, v, hour in events[fed.n and (50, 90, 120)[fed.n - 1] : end]]
        assert rows(feeds.settled(fed.give(batch))) == lifetimes(events[:end], 12)


def test_windows_over_a_feed_are_corrected_until_they_end(spark):
    fed = Fed(spark, TIMED)
    held = feeds.signed(fed.stream, ["k"], ["seq"])
    held = held.withColumn("w", F.window("ts", "2 hours")).withColumn("end", F.col("w.end")).drop("w")
    fed.into(feeds.grouped(held, ["end"], {"n": ("count", "*"), "s": ("sum", "v")}, until="end", delay="4 hours"))

    def give(*given):
        got = feeds.settled(fed.give(stamped(*given) if not fed.n else [(k, op, v, ts, n + 100 * fed.n) for k, op, v, ts, n in stamped(*given)]))
        hours = (F.unix_timestamp("end") - F.lit(int(START.timestamp()))) / 3600
        return rows(got.select(hours.cast("int"), "n", "s"))

    assert give((1, "u", 1, 0), (2, "u", 2, 1), (3, "u", 4, 2)) == [(2, 2, 3), (4, 1, 4)]
    # A row moves to another window, one goes, one comes.
    assert give((1, "u", 8, 3), (2, "d", 0, 1), (4, "u", 16, 1)) == [(2, 1, 16), (4, 2, 12)]
    assert give((5, "u", 1, 9)) == [(10, 1, 1), (2, 1, 16), (4, 2, 12)]
    # The watermark stands at 6: the first windows keep their results.
    assert give((4, "u", 99, 1), (3, "d", 0, 2), (6, "u", 7, 8)) == [(10, 2, 8), (2, 1, 16), (4, 2, 12)]


def test_images_need_no_state(spark):
    kinds = "before struct<k: int, v: long>, after struct<k: int, v: long>"
    table = [(None, (1, 2**60)), ((1, 2**60), (1, 5)), ((2, None), None), (None, None)]
    got = feeds.images(spark.createDataFrame(table, kinds), "before", "after")
    assert rows(got) == sorted([(1, 2**60, 1), (1, 2**60, -1), (1, 5, 1), (2, None, -1)], key=repr)
    assert rows(feeds.settled(got)) == [(1, 5)]
    twice = spark.createDataFrame([(1, 3), (1, -1), (2, 1), (2, -1)], "k int, _weight long")
    assert rows(feeds.settled(twice)) == [(1,), (1,)]


def test_refusals(spark):
    fed = Fed(spark, FEED)
    a, b = side(fed.stream, "a"), side(fed.stream, "b")
    with pytest.raises(ValueError, match="salt"):
        feeds.joined(a, b, [("v", "k")], "full", salt=2)
    with pytest.raises(ValueError, match="time"):
        feeds.signed(fed.stream, ["k"], ["seq"], lifetime=12)
    with pytest.raises(ValueError, match="either"):
        feeds.grouped(a, ["g"], {"n": ("count", "*")}, time="seq", lifetime=1, until="g")
