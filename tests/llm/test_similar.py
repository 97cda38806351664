"""Near copies with an exact check, against plain Python."""

import random
import re
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tableflow.llm import mixing, sharding, similar, simhash
from tableflow.llm.store import prepare

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(autouse=True)
def settings(spark):
    prepare(spark)


def shingles(text, n=5):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_kept(rows, least=0.8):
    """Smallest id of each component of similar texts."""
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if likeness(a, b) >= least:
                one, other = top(i), top(j)
                root[max(one, other)] = min(one, other)
    return sorted({top(i) for i, _ in rows})


def family(pick, n, words=60, edits=3):
    base = [f"w{pick.randrange(900)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(pick.randint(0, edits)):
            copy[pick.randrange(words)] = f"x{pick.randrange(900)}"
        out.append(" ".join(copy))
    return out


def test_similarities_equal_plain_sets():
    texts = ["", "a", "A b  c", "a b c", "a b c d e", "a b c d e f", "a b c d e f\tg h", "ä ö ü a b c d", "a " * 40, " \n"]
    pairs = [(a, b) for a in texts for b in texts]
    got = similar.similarities(pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs]))
    assert np.allclose(got, [likeness(a, b) for a, b in pairs])


def test_forest_of_links():
    pick = random.Random(3)
    i, j = (np.array([pick.randrange(50) for _ in range(120)]) for _ in range(2))
    root = np.arange(50)
    at = similar.grow(root, i, j)
    whole = np.arange(50)
    similar.grow(whole, i[at], j[at])
    assert np.array_equal(root, whole) and len(at) == 50 - len(set(root.tolist()))


@pytest.mark.parametrize("part", [4, 1 << 16])
def test_every_pair_a_candidate_equals_brute_force(spark, monkeypatch, part):
    """All keys within budget: dense groups, many vain comparisons and cut leaves still give the components of all pairs."""
    monkeypatch.setattr(similar, "PART", part)
    monkeypatch.setattr(similar, "PAIRS", 64)
    pick = random.Random(11)
    texts = [t for _ in range(4) for t in family(pick, 9, edits=4)] + ["one two", "one two", "One TWO", "", None]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = similar.keep_one(docs, orders=1, key_bits=6, key_budget=6, budget=128)
    assert sorted(r.doc_id for r in kept.collect()) == plain_kept(rows)


def test_later_rounds_do_not_join_all_links_again(spark, monkeypatch):
    """Components of a later round come from one row per text and the links of that round."""
    given, whole = [], similar.components
    monkeypatch.setattr(similar, "components", lambda links: given.append(links.count()) or whole(links))
    pick = random.Random(11)
    rows = list(enumerate(t for _ in range(4) for t in family(pick, 60, edits=2)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = similar.keep_one(docs, orders=1, key_bits=6, key_budget=6, budget=128)
    assert sorted(r.doc_id for r in kept.collect()) == plain_kept(rows)
    assert len(given) > 1 and all(n < given[0] for n in given[1:])


def test_a_pair_is_linked_in_the_first_order_it_meets_in():
    """Tasks of all orders see the same near pair; one gives it back."""
    given = {w: np.array([5, 4, 7, 2**60], np.int64) for w in ("w0", "w1")}
    given = pd.DataFrame({"pair": 0, "side": np.int8(0), **given, "node": np.arange(4), "root": np.arange(4)}).astype({"pair": np.int32})
    found = [similar.forests(given.assign(bits=np.int8(k)), 20, 1, 24, 12, 8) for k in range(12)]
    pairs = [p for f in found for p in zip(f["a"].tolist(), f["b"].tolist())]
    assert len(pairs) == len(set(pairs)) == 6


def test_planted_copies_are_caught(spark):
    pick = random.Random(5)
    texts = [t for _ in range(40) for t in family(pick, 3, words=150, edits=3)]
    rows = list(enumerate(texts))
    kept = {r.doc_id for r in similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = set(plain_kept(rows))
    assert want <= kept and len(kept - want) <= 0.1 * (len(rows) - len(want))


def test_memory_of_a_task_does_not_grow_with_the_forests_of_a_round():
    """A late round asks for thousands of forests; only those with a link are made."""
    n = 4000
    columns = {"pair": np.zeros(n, np.int32), "side": np.zeros(n, np.int8), "bits": np.zeros(n, np.int8)}
    prints = {w: np.random.default_rng(1).integers(0, 2**62, n) for w in ("w0", "w1")}
    prints["w0"][1], prints["w1"][1] = prints["w0"][0], prints["w1"][0]
    node = np.arange(n)
    given = pd.DataFrame(columns | prints | {"node": node, "root": node})
    tracemalloc.start()
    found = similar.forests(given, 20, 1, 24, 1, 4 * 8**4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (found["a"].tolist(), found["b"].tolist()) == ([0], [1]) and peak < 100e6


NAMES = (
    "row mark body node root w0 w1 whole print pair side bits a b alike one other hash id no_id first_id component_id row_mark size kept_row "
    "source_key source_size target copies kept n weight bound total level part axis_value axis_0 axis_1 row_at rows_before rows_in_all "
    "rank_in_all curve shard slot"
).split()


@pytest.fixture
def odd(spark):
    long = " ".join(f"v{i}" for i in range(30000))
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, ""), (None, None), (4, long), (5, long + " z"), (6, "q")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    return docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(NAMES)])


@pytest.mark.parametrize("keep", [similar.keep_one, simhash.keep_first])
def test_odd_rows_and_names(spark, odd, keep):
    got = keep(odd)
    assert got.columns == odd.columns
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == ([1, 2, 4, 6] if keep is similar.keep_one else [1, 2, 4, 6])
    assert all(r[n] == k for r in rows for k, n in enumerate(NAMES))
    assert keep(odd.limit(0)).count() == 0


def test_names_of_mixing_and_sharding(odd):
    assert mixing.mixed(odd).columns == odd.columns and mixing.mixed(odd).count() >= 0
    plan = mixing.planned(odd)
    assert [c for c in plan.columns if c not in mixing.PLAN] == [c for c in odd.columns if c not in mixing.PLAN]
    assert plan.count() == 9 and plan.agg(F.max("source_key")).first()[0] == NAMES.index("source_key")
    got = sharding.sharded(odd, 3, ["source"], ["doc_id"], ["doc_id", "text"])
    added = {"curve", "shard", "slot"}
    assert [c for c in got.columns if c not in added] == [c for c in odd.columns if c not in added]
    rows = got.collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(3) for k in range(3)]
    assert all(r[n] == k for r in rows for k, n in enumerate(NAMES) if n not in added)
