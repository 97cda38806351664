"""Operators over a whole corpus: mixing, sharding, packing, archives, near copies, and the pipeline."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tableflow.llm import curve, graph, mixing, packing, queries, sharding, simhash, store, warc
from tests.conftest import SF
from tests.oracle import compare, connect

ODD = [(None, None, None), (1, None, "a"), (2, "", None), (3, "x y z", "a"), (3, "x y z", "a"), (4, "long " * 20_000, "b"), (5, "x y z", "c")]


@pytest.fixture(scope="module")
def docs(spark):
    store.prepare(spark)
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, s, "x", 1) for i, t, s in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, shard string, copies int")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(connect(SF), queries.QUERIES[name](spark, SF), queries.ORACLES[name]) is None


def shared_out(sizes):
    """Share out by weight and again what is above the bounds, until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(sizes.values()), dict.fromkeys(sizes, 0.0), set(sizes)
    while left > 1e-6 and open_:
        unit = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in sorted(open_, key=str):
            target[s] += unit * weight[s]
            if target[s] > 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
        open_ = {s for s in open_ if target[s] < 2 * sizes[s]}
    return target


def test_targets_equal_shares_given_out_again_and_again(spark):
    for seed in range(6):
        pick = random.Random(seed)
        sizes = {f"s{k}": pick.choice([0, 1, 7, 100, 5000]) for k in range(pick.randint(1, 9))} | {None: 50}
        table = spark.createDataFrame(list(sizes.items()), "source_key string, source_size long")
        got = {r.source_key: r.target for r in mixing.targets(table, (3, 1, 2), 1.5, 2).collect()}
        want = shared_out(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix(spark, docs, odd):
    got = queries.QUERIES["op1_mix_sources"](spark, SF).collect()
    assert got and all(r.taken <= 2 * r.size for r in got)
    assert abs(sum(r.taken for r in got) / (1.5 * sum(r.size for r in got)) - 1) < 0.1
    copies = {r.doc_id: r.copies for r in mixing.planned(docs).select("doc_id", "copies").collect()}
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {i: n for i, n in copies.items() if n}
    assert mixing.planned(odd).count() == len(ODD) and mixing.mixed(odd).columns == odd.columns
    assert mixing.mixed(odd.limit(0)).count() == 0


@pytest.mark.parametrize("n,bits", [(1, 3), (2, 4), (3, 3), (4, 2)])
def test_curve_is_a_path_through_all_points(spark, n, bits):
    points = np.array(np.meshgrid(*[range(1 << bits)] * n, indexing="ij")).reshape(n, -1).T
    names = [f"a{i}" for i in range(n)]
    table = spark.createDataFrame([tuple(int(x) for x in p) for p in points], ", ".join(f"{c} long" for c in names))
    rows = table.select("*", curve.hilbert_index([F.col(c) for c in names], bits).alias("h")).collect()
    path = np.array([r[:n] for r in sorted(rows, key=lambda r: r.h)])
    assert sorted(r.h for r in rows) == list(range(1 << (n * bits)))
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
    assert (curve.hilbert_numbers(np.array([r[:n] for r in rows]), bits) == [r.h for r in rows]).all()


def test_shards(spark, docs, odd):
    rows = queries.QUERIES["op2_hilbert_shards"](spark, SF).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(i, len(t) + 8, zlib.crc32(t)) for i, t in texts.items()}
    # Files of a shard are narrow in each dimension: fewer sources per shard than a random cut would have.
    sources = docs.join(spark.createDataFrame([(r.doc_id, r.shard) for r in rows], "doc_id long, shard int"), "doc_id")
    counts = sources.groupBy("shard").agg(F.countDistinct("source", "lang").alias("n")).agg(F.avg("n")).first()[0]
    assert counts < 0.8 * docs.select("source", "lang").distinct().count()
    few = sharding.sharded(odd.drop("shard"), 3, ["source"], ["copies"], ["doc_id", "text"]).collect()
    assert sorted(r.shard for r in few) == [0, 0, 0, 1, 1, 2, 2]
    assert sharding.sharded(odd.drop("shard").limit(0), 3, ["source"], ["copies"], ["doc_id"]).count() == 0


def test_tokens_are_those_of_the_public_tokenizer():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    encoding = packing.tokenizer(public_tokenizers.path(packing.VOCABULARY))
    pick = random.Random(3)
    letters = "abzé'sß t\n\t  .,!123中文 ​ <|endoftext|>"
    texts = ["".join(pick.choice(letters) for _ in range(pick.randrange(80))) for _ in range(500)] + ["<|endoftext|>"]
    texts += ["".join(chr(c) for c in range(k, k + 64)) for k in range(0, 0x3000, 64)]
    assert [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)] == [encoding.encode_ordinary(t) for t in texts]
    assert isinstance(encoding, tiktoken.Encoding)


def check_packed(rows, ids):
    at, last = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.start)):
        own = ids[r.doc_id]
        assert r.start == at.get(r.doc_id, 0) and r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        at[r.doc_id] = r.start + r.length
    assert at == {i: len(x) for i, x in ids.items()}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == last.get(r.sequence_id, 0)
        last[r.sequence_id] = r.offset + r.length
    assert max(last.values()) <= 1024
    return last


def test_packing(spark, docs):
    encoding = packing.tokenizer(public_tokenizers.path(packing.VOCABULARY))
    ids = {r.doc_id: encoding.encode_ordinary(r.text or "") + [0] for r in docs.collect()}
    lengths = check_packed(queries.QUERIES["op4_pack_along_curve"](spark, SF).collect(), ids)
    assert sum(n < 1024 for n in lengths.values()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = packing.pack(docs)
    whole = packing.sequences(pieces).collect()
    assert sum(r.n_ids for r in whole) == sum(map(len, ids.values())) and all(len(r.ids) == 4 * r.n_ids for r in whole)


def test_packing_of_odd_rows(spark, odd):
    rows = odd.where("doc_id is null or doc_id <> 3 or text is null").select("doc_id", "text")
    encoding = packing.tokenizer(public_tokenizers.path(packing.VOCABULARY))
    ids = {r.doc_id: encoding.encode_ordinary(r.text or "") + [0] for r in rows.collect()}
    check_packed(queries.pieces_digest(packing.pack(rows)).collect(), ids)
    assert packing.pack(odd).where("doc_id = 3").agg(F.sum("length")).first()[0] == 2 * (len(encoding.encode_ordinary("x y z")) + 1)
    assert packing.pack(odd.limit(0)).count() == 0


def test_archives_give_back_every_payload(spark, folder):
    big = "x" * 150
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0 "
    rows = [(3, "http://a\r\nb", big), (1, "u", big), (None, "n", big), (2, None, None), (4, "e", ""), (5, "w", inner * 3)]
    rows += [(6, "w", "é" * 80), (7, "w", "é" * 80), (8, "s", "small"), (9, "s", "small"), (10, "r", big + "r"), (10, "r", big + "r")]
    rows += [(11, "z", "\x00" * 200 + "WARC/1."), (12, "l", "long\r\n\r\n" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, f"{folder}/a")
    records = warc.read_archives(spark, f"{folder}/a")
    assert records.count() == 3 * len(rows) and records.where("not whole").count() == 0
    got = warc.captures(records).collect()
    assert len(got) == len(rows)
    html = {i: (h or "").encode() for i, _, h in rows}
    revisits = {3: 1, None: 1, 7: 6}
    for r in got:
        assert r.kind == ("revisit" if r.page_id in revisits else "response")
        assert r.answer_page == revisits.get(r.page_id) and r.main.payload_bytes == len(html[r.page_id])
        assert r.kind == "revisit" or bytes(r.main.payload) == html[r.page_id]
        assert r.request is not None and r.metadata is not None
    warc.write_archives(pages.limit(0), f"{folder}/b")
    assert warc.captures(warc.read_archives(spark, f"{folder}/b")).count() == 0


def brute_components(values, budget):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if int(values[i] ^ values[j]).bit_count() <= budget:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def test_near_copies(spark, docs, odd):
    rows = queries.QUERIES["op9_simhash_near_copies"](spark, SF).collect()
    values = [int(r.fingerprint, 16) for r in rows]
    least = {}
    roots = brute_components(values, 2)
    for r, c in zip(rows, roots):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    assert [r.component_id for r in rows] == [least[c] for c in roots]
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    got = simhash.near_copies(odd).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 1), (1, 1), (2, 1), (3, 3), (3, 3), (4, 4), (5, 3)]
    assert sorted(r.doc_id for r in simhash.keep_first(odd).collect()) == [1, 3, 4]
    assert simhash.keep_first(odd.limit(0)).count() == 0 and simhash.near_copies(odd.limit(0)).count() == 0


def test_dense_fingerprints_split_below_a_prefix(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 8)
    pick = random.Random(5)
    values = {pick.getrandbits(64) for _ in range(40)}
    for seed in list(values)[:6]:
        for _ in range(30):
            near = seed
            for _ in range(pick.randint(1, 4)):
                near ^= 1 << pick.randrange(64)
            values.add(near)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame(list(enumerate(signed)), "doc_id long, print long")
    depths, _, _ = simhash.parts(prints.select("print"), 2)
    assert len(set(depths.tolist())) > 1
    got = {r.doc_id: r.component_id for r in simhash.grouped(prints).collect()}
    roots = brute_components(values, 2)
    least = {}
    for i, c in enumerate(roots):
        least.setdefault(c, i)
    assert got == {i: least[c] for i, c in enumerate(roots)}


def test_components_of_a_long_path(spark):
    path = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_pipeline(spark, docs):
    stage = {name: f for name, f in corpus_pipeline.STAGES}
    known = stage["language ID"](spark, docs, SF)
    assert known.columns == docs.columns and known.count() > 0.95 * docs.where(F.rlike("text", F.lit("[a-z]"))).count()
    good = stage["quality rules"](spark, docs, SF)
    verdict = queries.QUERIES["op10_quality_rules"](spark, SF).where("kept")
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in verdict.collect()}
    pieces = corpus_pipeline.run(spark, SF)
    last = corpus_pipeline.STAGES
    expected = docs
    for _, f in last[:-1]:
        expected = store.stored(f(spark, expected, SF), "expected")
    assert expected.columns == docs.columns
    counts = expected.groupBy("doc_id").agg(F.count("*").alias("n"))
    starts = pieces.where("start = 0").groupBy("doc_id").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, starts.collect()))


def test_stages_take_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (2, "", None, None, 0)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (odd, odd.limit(0)):
        for name, f in corpus_pipeline.STAGES:
            out = f(spark, frame, SF)
            assert out.count() >= 0 and (name == "packing" or out.columns == odd.columns)
