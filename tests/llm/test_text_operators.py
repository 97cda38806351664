"""Operators that look at one text at a time, against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tableflow.llm import bloom_lm, language, pages, quality, queries, simhash, sketch, spans
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.none() | st.text("ab A\n\té #|　\x00", max_size=40), max_size=8)
ODD = [(None, None), (1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (5, "é ß 漢 x " * 3000), (6, "x" * 200_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, repeated and very long rows, with a column of a clashing name."""
    rows = [(i, t, None, "s", "clash") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size string")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def plain_rules(text):
    text = text or ""
    words, seen, lines = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    grams, inside = Counter(zip(words, words[1:], words[2:])), set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, lines, len(inside), failed


def rules(texts):
    got = quality.measures(pa.array(texts, pa.string()))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return list(zip(*(got[n].tolist() for n in names))), got["kept"].tolist()


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_rules_equal_plain_counts(texts):
    assert rules(texts)[0] == [plain_rules(t) for t in texts]


def test_rules_keep_clean_and_reject_repeated():
    clean = " ".join(f"word{i}" for i in range(200))
    banner = "one two three four five six seven\n"
    loop = "buy now and save\n" * 60
    assert rules([clean, banner + clean + banner, loop])[1] == [True, True, False]


def test_rules_query(spark, docs):
    got = {r.doc_id: r for r in queries.QUERIES["op10_quality_rules"](spark, SF).collect()}
    for row in docs.collect():
        r = got.pop(row.doc_id)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_rules(row.text)
        assert not (r.kept and r.base_failed)
    assert not got


def plain_simhash(text):
    words = WORD.findall(lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(TEXTS)
@settings(max_examples=80, deadline=None)
def test_simhash_equals_plain(texts):
    assert [int(x) for x in simhash.simhashes(pa.array(texts, pa.string()))] == [plain_simhash(t) for t in texts]


@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 63), max_size=60), st.integers(0, 3))
@settings(max_examples=60, deadline=None)
def test_trie_join_finds_all_pairs_once(values, budget):
    a = np.unique(np.array(values, np.uint64))
    want = {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if int(a[i] ^ a[j]).bit_count() <= budget}
    got = [p for i, j in simhash.descend(a, a, budget, True) for p in zip(i.tolist(), j.tolist())]
    assert len(got) == len(set(got)) and set(got) == want
    b = a[::2]
    want = {(i, j) for i in range(len(a)) for j in range(len(b)) if int(a[i] ^ b[j]).bit_count() <= budget}
    got = [p for i, j in simhash.descend(a, b, budget, False) for p in zip(i.tolist(), j.tolist())]
    assert len(got) == len(set(got)) and set(got) == want


def shingles(text):
    words = WORD.findall(text or "")
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_sketches_estimate_and_merge():
    texts = [" ".join(f"w{i}" for i in range(a, b)) for a, b in ((0, 900), (300, 1200), (0, 60), (20, 60))] + ["", "a b"]
    made = sketch.bottom_k(pa.array(texts))
    for a in range(len(texts)):
        assert (sketch.decode(sketch.encode(made[a])) == made[a]).all()
        for b in range(len(texts)):
            x, y = shingles(texts[a]), shingles(texts[b])
            true = len(x & y) / len(x | y) if x | y else 1.0
            assert abs(sketch.resemblance(made[a], made[b]) - true) < 0.15
            assert abs(sketch.containment(made[a], made[b]) - (len(x & y) / len(x) if x else 1.0)) < 0.25
    assert abs(sketch.distinct_shingles(made[0]) / 896 - 1) < 0.3 and sketch.distinct_shingles(made[2]) == 56
    both = sketch.bottom_k(pa.array([texts[0] + " | " + texts[1]]))[0]
    assert len(np.intersect1d(sketch.merge(made[:2]), both)) > 0.9 * sketch.K


def test_merged_sketches_per_group(spark, docs):
    prints = docs.join(sketch.fingerprints(docs), "doc_id").select("source", "fingerprint")
    want = {}
    for r in prints.collect():
        want.setdefault(r.source, []).append(sketch.decode(r.fingerprint))
    got = {r.source: r.fingerprint for r in sketch.merged(prints, "source").collect()}
    assert got == {s: sketch.encode(sketch.merge(x)) for s, x in want.items()}


def edited_by_hand(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        out.append((i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_edited_texts(spark, docs, odd):
    got = queries.QUERIES["op3_bottom_k_fingerprints"](spark, SF).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == edited_by_hand(rows)
    texts = dict(rows)
    by_text = {}
    for r in got:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    got = sketch.edited_likeness(odd).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == edited_by_hand(ODD)
    assert sketch.edited_likeness(odd.limit(0)).count() == 0


def test_language_models_are_distributions_and_accurate(spark, docs):
    models = language.learn(docs.where(queries.fold(3) != 1))
    symbols = sorted({c for r in docs.collect() for c in r.text.lower() if c.isalpha()})
    for context in ("t", "an", "de"):
        found, place, bounds = language.marked(*language.letter_words([context + c for c in symbols])[:3])
        chances = 2.0 ** -models.bits(found, place)[bounds[:-1] + len(context) + 1]
        end, place, _ = language.marked(*language.letter_words([context])[:3])
        total = chances.sum(axis=0) + 2.0 ** -models.bits(end, place)[-1]
        # A little over 1: each letter that a language never saw has the share of its one unknown symbol.
        assert ((total > 0.95) & (total < 1.01)).all()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = queries.QUERIES["op6_language_id"](spark, SF).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and held
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    names, score, rejected = language.decide(models, [None, "", "12 !?", "qxz vkj wqx zzk jjq xvq kkz qqw" * 5])
    assert names[:3] == ["und"] * 3 and score[:3].tolist() == [0, 0, 0] and rejected.all()


def test_language_without_labels(spark, odd):
    models = language.learn(odd)
    got = language.predicted(odd, models).collect()
    assert {r.lang_pred for r in got} == {"und"} and sum(not r.rejected for r in got) == 4
    assert language.predicted(odd.limit(0), models).count() == 0


def test_scores(spark, docs):
    got = {r.doc_id: r for r in queries.QUERIES["op7_bloom_lm_scores"](spark, SF).collect()}
    tokens = {r.doc_id: WORD.findall(lower(r.text)) + [None] for r in docs.collect()}
    train = {i for i in tokens if zlib.crc32(str(i).encode()) % 5 != 1}
    counts = Counter(w for i in train for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    assert set(got) == set(tokens)
    for i, words in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (i not in train, len(words), n)
        assert r.n_known == sum(w in counts for w in words)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), rel_tol=1e-9, abs_tol=1e-6)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_of_odd_rows(spark, odd):
    got = bloom_lm.scored(odd, F.lit(True)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == sorted((i or 0, len(WORD.findall(t or "")) + 1) for i, t in ODD)
    assert all(r.n_known == r.n_tokens for r in got)
    assert {abs(r.base_score) < 1e-9 and r.score == 0 for r in bloom_lm.scored(odd, F.lit(False)).collect()} == {True}
    assert bloom_lm.scored(odd.limit(0), F.lit(True)).count() == 0


def test_filters_give_back_levels():
    pick = np.random.default_rng(5)
    hashes = pick.integers(0, 1 << 64, 40_000, np.uint64)
    counts = (pick.pareto(1.0, len(hashes)) + 1).astype(np.uint64)
    shard = bloom_lm.shard_of(hashes, 7)
    found = {s: bloom_lm.shard_filter(hashes[shard == s], counts[shard == s]) for s in range(2, 6) if s != 4}
    words = np.sort(hashes[(hashes & bloom_lm.PAIR == 0) & (shard >= 2) & (shard < 6)])
    filters = bloom_lm.Filters(7, 2, 6, found, words, np.arange(1, len(words) + 1, dtype=np.uint64))
    assert (filters.exact(words[::-1]) == np.arange(len(words), 0, -1)).all() and not filters.exact(words + np.uint64(2)).any()
    mine = filters.mine(hashes)
    assert (mine == (shard >= 2) & (shard < 6)).all()
    level = filters.level(hashes[mine])
    want = np.where(shard[mine] == 4, 0, bloom_lm.levels(counts[mine]))
    assert (level >= want).all() and (level > want).mean() < 0.1 and not level[shard[mine] == 4].any()
    unseen = pick.integers(0, 1 << 64, 20_000, np.uint64)
    assert (filters.level(unseen[filters.mine(unseen)]) > 0).mean() < 0.1


def test_rows_of_the_counts_grow_with_the_text(spark, monkeypatch):
    monkeypatch.setattr(bloom_lm, "FLUSH", 1 << 10)
    monkeypatch.setattr(bloom_lm, "SHARD_TOKENS", 1 << 10)

    def rows(n):
        texts = spark.createDataFrame([(i, " ".join(f"w{(i * 37 + k) % 997}" for k in range(200))) for i in range(n)], "doc_id long, text string")
        bodies = bloom_lm.hashed(texts.repartition(n // 10).withColumn("train", F.lit(True)), "doc_id", "text").where("words is not null").select(*bloom_lm.BODY)
        return bodies.count(), bloom_lm.summed(bodies, max(1, n // 50)).count()

    (small, few), (large, many) = rows(100), rows(400)
    assert 3 <= large / small <= 5 and many <= 4.2 * few


def test_blocks_of_broken_pages():
    def texts(page):
        return [b.text for b in pages.blocks(page)]

    assert texts(None) == texts("") == texts("<script>var a='<p>x</p>';</script><!-- c --><style>p{}</style>") == []
    assert texts("<p>a<p>b &lt;x&gt; &amp;\n c<br>d") == ["a", "b <x> & c d"]
    assert texts("<div>a<b>b<i>c</b>d</div>e</p>f") == ["abcd", "e", "f"]
    assert texts("<ul><li>a<li>b</ul>1 < 2") == ["a", "b", "1 < 2"]
    assert texts("<p title='a>b' class=\"x>y\">t</p><p") == ["t"]


def test_articles(spark):
    table = spark.read.parquet(f"{SF}/pages.parquet")
    field = pages.learn(table)
    got = {r.page_id: r for r in pages.extracted(table, field).collect()}
    for row in table.collect():
        found = [b.text for b in pages.blocks(row.html) if any(t == "article" for t, _ in b.path)]
        assert got[row.page_id].text == " ".join(found) and got[row.page_id].n_chars == len(got[row.page_id].text)
    page = (
        '<body><header class="top"><a href="/">Home</a></header><div id="cookie-notice">We use cookies. Please agree.</div>'
        '<div class="article-body"><h1>A title</h1><p>First words of the story. More of it.</p><p>Short.</p></div>'
        '<section class="comments"><p>I do not agree at all. It is wrong.</p></section><footer>&copy; us</footer></body>'
    )
    assert pages.main_text(field, page) == "A title First words of the story. More of it. Short."
    odd = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", "<p>x")], "page_id long, url string, html string")
    assert pages.extracted(odd, field).count() == 3
    assert pages.extracted(odd.limit(0), pages.learn(odd.limit(0))).count() == 0


def test_learnt_labels_hold_on_unseen_layouts(spark):
    import random

    table = spark.read.parquet(f"{SF}/pages.parquet")
    field, pick = pages.learn(table), random.Random(99)
    words = [w for r in table.limit(30).collect() for b in pages.blocks(r.html) for w in b.text.split()]
    right = total = 0
    for _ in range(80):
        paragraphs = [" ".join(pick.choice(words) for _ in range(pick.randint(8, 60))) for _ in range(pick.randint(1, 12))]
        found, labels = pages._dressed(paragraphs, words, pick)
        got = field.decode(pages.features(found), pages.joints(found))
        right += sum(a == b for a, b in zip(got, labels))
        total += len(labels)
    assert right / total > 0.95


def test_word_hashes_do_not_depend_on_place():
    buf, offsets = spans.buffers(pa.array(["a bc a", "bc"]))
    hashes = spans.span_hashes(buf, *spans.words(buf, offsets)[:2])
    assert hashes[0] == hashes[2] and hashes[1] == hashes[3] and hashes[0] != hashes[1]


def test_model_of_many_shards_and_rounds_keeps_every_level(spark, docs, monkeypatch):
    monkeypatch.setattr(bloom_lm, "SHARD_TOKENS", 1 << 12)
    monkeypatch.setattr(bloom_lm, "ROUND_BYTES", 1 << 13)
    monkeypatch.setattr(bloom_lm, "FLUSH", 1 << 13)
    texts = {r.doc_id: WORD.findall(lower(r.text)) + [None] for r in docs.collect()}
    ones = Counter(w for t in texts.values() for w in t)
    twos = Counter(p for t in texts.values() for p in zip([None] + t, t))
    total, once = sum(ones.values()), sum(n == 1 for n in ones.values())
    middle = {n: (3 * 2 ** (n.bit_length() - 1) - 1) / 2 for n in ones.values()}
    unknown, mass = min(0.5, max(once, 1) / (total + 1)), sum(middle[n] for n in ones.values())

    def chance(before, word):
        # The least count of the pair's level over the most of its context's.
        follow = 2 ** (twos[before, word].bit_length() - 1) / (2 ** ones[before].bit_length() - 1)
        return math.log10(0.3 * follow + 0.7 * (1 - unknown) * middle[ones[word]] / mass)

    off = 0
    for r in bloom_lm.scored(docs, F.lit(True)).collect():
        t = texts[r.doc_id]
        want = sum(chance(b, w) for b, w in zip([None] + t, t))
        assert r.n_known == r.n_tokens == len(t) and r.train_tokens == total
        off += abs(r.score - want) / len(t)
    # Only chance hits of the filter part the two.
    assert off / len(texts) < 0.05
    after = Counter()
    for (before, word), n in twos.items():
        after[before] += 2 ** (n.bit_length() - 1) / (2 ** ones[before].bit_length() - 1)
    assert max(after.values()) <= 1


def test_every_language_learns_from_different_texts(spark):
    words = ["alpha beta", "gamma delta", "epsilon zeta", "eta theta", "iota kappa", "lambda omega", "sigma tau", "phi chi"]
    hot = [(f"l{k}", w) for k, w in enumerate(words)] * 3000
    many = [("many", f"text {chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}") for k in range(2000)] * 2
    rows = spark.createDataFrame(hot + many + [("none", "12 !?")], "lang string, text string")
    models = language.learn(rows)
    assert models.names == [f"l{k}" for k in range(8)] + ["many"]
    assert language.decide(models, words)[0] == models.names[:8]
    sample = language.sampled(rows.withColumnsRenamed({"lang": "label", "text": "body"}), 600).collect()
    taken = Counter(r.label for r in sample)
    assert taken == {**dict.fromkeys(models.names[:8], 1), "many": 600}
    assert len({(r.label, r.body) for r in sample}) == 608
    assert all(r.n == taken[r.label] and 1 <= r.place <= r.n for r in sample)


def test_head_ends_without_its_end_tag():
    def texts(page):
        return [b.text for b in pages.blocks(page)]

    head = "<html><head><meta charset=utf-8><title>t</title><script>a<b</script><template><p>x</p></template>"
    whole = pages.blocks(f"{head}</head><body><p>a</p>b</body></html>")
    assert pages.blocks(f"{head}<body><p>a</p>b</body></html>") == whole and [b.text for b in whole] == ["a", "b"]
    assert texts(f"{head}\n <div>a</div></head>b") == ["a", "b"]
    assert texts(f"{head}a<p>b") == ["a", "b"]
    assert texts(f"{head}<img src=x>a") == ["a"] and texts(f"{head}< a") == ["< a"]
    assert texts("<p>a<math/>b</p>c<math><mi>x</mi></math>") == ["a", "b", "c"]
