"""Hard negatives, filter audits and url filters against plain Python."""

import math
import random
import re
from itertools import permutations

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tableflow.llm import filter_audit, negatives, queries, store, urls
from tests.conftest import SF, rows
from tests.oracle import compare

VECTORS = "vec_id long, label int, vector array<long>, score string, anchor int, id int, place int"


@pytest.fixture(autouse=True)
def settings(spark):
    store.prepare(spark)


def mined(table, anchors, positives=5, count=3, low=50, high=95):
    """By full sorted lists per anchor. ``table``: (id, label, vector)."""
    known = [r for r in table if None not in r and None not in r[2]]
    of = {}
    for i, label, v in known:
        if anchors(i):
            of[i] = min(of.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in of.items():
        scored = [(-max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(v, w)))), i, other) for i, other, w in known if len(w) == len(v)]
        first = sorted((s, i) for s, i, other in scored if other == label and i != a)[:positives]
        other = sorted((s, i) for s, i, o in scored if o != label)
        for s, i in first:
            fits = [(t, j) for t, j in other if low * -s <= 100 * -t <= high * -s][:count]
            out += [(a, i, k + 1, j, -s, -t) for k, (t, j) in enumerate(fits)]
    return sorted(out, key=repr)


def vectors(seed, n=240):
    pick = random.Random(seed)
    table = []
    for i in range(n):
        dim = pick.choice([4, 4, 4, 4, 4, 3, 0])
        big = pick.choice([2] * 60 + [2**27, 2**40])
        table.append((i % (n - 7), pick.randrange(3), [pick.randint(-big, 2 * big) for _ in range(dim)]))
    table += [(None, 1, [1, 2, 3, 4]), (500, None, [1, 2, 3, 4]), (550, 1, None), (600, 1, [1, None, 3, 4]), (700, 1, [0, 0, 0, 0])]
    return table + [table[0], table[10], (10, 2, [1, 1, 1, 1])]


@pytest.mark.parametrize("seed", range(3))
def test_negatives_equal_sorted_lists(spark, monkeypatch, seed):
    table = vectors(seed)
    frame = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in table], VECTORS)
    found = negatives.mine(frame, F.col("vec_id") % 10 == 0)
    want = mined(table, lambda i: i % 10 == 0)
    assert want and rows(found) == want
    # Many rounds, tasks and tiles give the same rows.
    monkeypatch.setattr(negatives, "ROUND_VALUES", 40)
    monkeypatch.setattr(negatives, "TILE", 64)
    monkeypatch.setattr(negatives, "TASK_SCORES", 500)
    assert rows(negatives.mine(frame, F.col("vec_id") % 10 == 0)) == want


def test_negatives_at_score_zero_and_other_limits(spark):
    table = [(0, 1, [1, 0]), (9, 1, [0, 5]), (3, 2, [0, 7]), (4, 2, [0, 8]), (5, 2, [-1, 0]), (8, 1, [-3, 0]), (2, 2, [-2, 0])]
    frame = spark.createDataFrame(table, "vec_id long, label int, vector array<long>")
    assert rows(negatives.mine(frame, F.col("vec_id") == 0)) == [(0, 9, 1, 3, 0, 0), (0, 9, 2, 4, 0, 0)] == mined(table, lambda i: i == 0)
    other = vectors(7)
    frame = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in other], VECTORS)
    found = negatives.mine(frame, F.col("vec_id") % 20 == 0, positives=2, negatives=7, low=10, high=100)
    assert rows(found) == mined(other, lambda i: i % 20 == 0, 2, 7, 10, 100)


def test_negatives_of_nothing(spark):
    frame = spark.createDataFrame([(1, 1, [1])], "vec_id long, label int, vector array<long>")
    for empty in (negatives.mine(frame.limit(0), F.lit(True)), negatives.mine(frame, F.lit(False)), negatives.mine(frame, F.col("vec_id") == 1)):
        assert empty.count() == 0 and empty.columns[0] == "anchor_id"


def test_quantised(spark):
    table = [([0.5, -0.001],), ([math.nan],), ([math.inf],), ([None, 1.0],), (None,), ([],)]
    got = spark.createDataFrame(table, "v array<float>").select(negatives.quantised(F.col("v")).alias("v")).collect()
    assert [r.v for r in got] == [[128, -1], None, None, None, None, []]


def test_a_third_of_the_rows_share_a_label_or_vector(spark):
    table = [(i, 1 if i % 3 else 2, [7, 7] if i % 3 == 1 else [i % 11, 5]) for i in range(3000)]
    frame = spark.createDataFrame(table, "vec_id long, label int, vector array<long>")
    assert rows(negatives.mine(frame, F.col("vec_id") % 500 == 0)) == mined(table, lambda i: i % 500 == 0)


# ---------------------------------------------------------------------------------------------------------------


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
    }


def audited(docs, labels):
    """Each order step by step, document by document. ``docs``: (id, text, source)."""
    first, good, toxic = {}, set(), set()
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, q, t in labels:
        good |= {i} if q == 1 and i is not None else set()
        toxic |= {i} if t == 1 and i is not None else set()
    known = []
    for i, text, source in docs:
        found = fails(text or "")
        found["E"] = i is not None and i > first[text or ""]
        known.append((source or "", {x for x, bad in found.items() if bad}, i in good, i in toxic))
    out, shares = [], {}
    for part in {d[0] for d in known}:
        for order in permutations("ABCDE"):
            left = [d for d in known if d[0] == part]
            for k, x in enumerate(order):
                here = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                earlier = [d for d in known if d[0] == part and x in d[1] and d[1] & set(order[:k])]
                alone = sum(d[0] == part and d[1] == {x} for d in known)
                shares[part, x] = shares.get((part, x), 0) + len(here)
                out.append([part, "".join(order), k + 1, len(left), len(here), len(earlier), alone, sum(d[2] for d in here), sum(d[3] for d in here)])
    return sorted((*r, shares[r[0], r[1][r[2] - 1]]) for r in out)


AUDIT_DOCS = "doc_id long, text string, source string, id int, mask int, part string, labelled int"


def audit_table(seed):
    pick = random.Random(seed)
    texts = [None, "", "Few words", "a b " * 40, " ".join(f"w{i}" for i in range(60)), " ".join(f"W{i}" for i in range(60))]
    texts += [" ".join(f"w{i}" for i in range(k, k + 55)) + pick.choice(["", " $", " #x", " SHOUT" * 30]) for k in range(4)]
    texts += ["ü€😀 " * 30_000, " a b " * 60]
    docs = [(i, pick.choice(texts), pick.choice(["s", "s", "s", "t", "", None])) for i in range(60)]
    docs += [(None, texts[4], "s"), (None, None, None), docs[5], docs[5], (5, "other text", "t")]
    labels = [(i, pick.choice([0, 1, None]), pick.choice([0, 1, None])) for i in range(0, 60, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("seed", range(2))
def test_audit_equals_every_order_by_hand(spark, seed):
    docs, labels = audit_table(seed)
    frame = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in docs], AUDIT_DOCS)
    marks = spark.createDataFrame([(*r, 7) for r in labels], "doc_id long, quality int, toxic int, part int")
    assert rows(filter_audit.audit(filter_audit.cells(frame, marks))) == sorted(audited(docs, labels), key=repr)


def test_audit_has_all_rows_and_shapley_shares_sum_up(spark):
    got = queries.QUERIES["op12_filter_audit"](spark, SF).collect()
    parts = {r.part for r in got}
    assert len(got) == 600 * len(parts)
    for part in parts:
        own = [r for r in got if r.part == part]
        removed = sum(r.removed for r in own if r.filter_order == "ABCDE")
        assert sum({r.filter_order[r.step - 1]: r.shapley for r in own}.values()) == 120 * removed
        assert len({r.kept for r in own if r.step == 5}) == 1


def test_audit_of_nothing_and_row_limit(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.cells(docs, labels)).count() == 0
    spark.conf.set("spark.sql.cteRecursionRowLimit", "10")
    one = spark.createDataFrame([(1, "text", "s")], "doc_id long, text string, source string")
    assert filter_audit.audit(filter_audit.cells(one, labels)).count() == 600
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "10"
    spark.conf.unset("spark.sql.cteRecursionRowLimit")


# ---------------------------------------------------------------------------------------------------------------

PAGES = [
    (1, "http://blog.example.org/es/a", ""),
    (2, "http://other.net/a", '<link rel="canonical" href="http://blog.example.org/es/a">'),
    (3, "http://other.net/b", "<head><meta http-equiv=refresh content='0; url=/a'>"),
    (4, "HTTP://Other.NET/c#part", "<LINK HREF=b rel='x Canonical'>"),
    (5, "http://shop.com/fr/x", '<link rel=canonical href="http://spam.com/de/x">'),
    (6, "http://spam.com/de/x", None),
    (7, "http://alias.net/1", '<link rel="canonical" href="//shop.com/fr/x?a=1&amp;b=2">'),
    (8, "http://shop.com/fr/x?a=1&b=2", '<link rel="canonical" href="http://spam.com/de/x">'),
    (9, "http://net.net/?q", '<!-- <link rel="canonical" href="http://spam.com/de/x"> --><script>"<link rel=canonical href=http://spam.com/de/x>"</script>'),
    (10, "http://only.net/y", '<link rel="canonical" href="http://far.com/de/never-seen">'),
    (11, "no scheme", '<link rel="canonical" href="http://spam.com/de/z">'),
    (12, None, '<link rel="canonical" href="http://spam.com/de/z">'),
    (13, "", "x" * 2_000_000),
    (14, "http://a.org", ""),
    (15, "http://a.org/", ""),
    (16, "http://example.organ/es/", ""),
    (17, "http://notexample.org/es/", ""),
    (18, "http://example.org/en/12?x", ""),
    (18, "http://example.org/en/12?x", ""),
    (19, "x#http://a.com/de/", ""),
    (20, "http://a.com?://b.org/", '<link rel="canonical" href="mailto:x"><link rel="canonical" href="#top"><link rel="canonical" href="">'),
    (21, "http://red.net/1", ""),
    (22, "http://red.net/2", ""),
]
REDIRECTS = [("http://red.net/1", "http://red.net/2"), ("http://red.net/2#x", "HTTP://q.Com/de/"), (None, "http://red.net/1"), ("http://red.net/1", None)]


def split_url(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")


def rule_of(url, rules):
    name, start = split_url(url)
    fits = [(-len(h + p), v, h + p) for h, p, v in rules if (name == h or name.endswith("." + h)) and start.startswith(p)]
    return min(fits) if fits else None


def test_urls_equal_union_find(spark):
    rules = queries.RULES
    frame = spark.createDataFrame([(*r, "x", "y", 1) for r in PAGES], "page_id long, url string, html string, rule string, node string, id int")
    redirects = spark.createDataFrame(REDIRECTS, "source string, target string")
    got = rows(urls.judged(frame, rules, redirects))
    spam, shop = "http://spam.com/de/x", "http://shop.com/fr/x"
    links = [
        ("http://other.net/a", "http://blog.example.org/es/a"), ("http://other.net/b", "http://other.net/a"),
        ("http://other.net/c", "http://other.net/b"), (shop, spam), ("http://alias.net/1", shop + "?a=1&b=2"),
        (shop + "?a=1&b=2", spam), ("http://only.net/y", "http://far.com/de/never-seen"), ("no scheme", "http://spam.com/de/z"),
        ("http://red.net/1", "http://red.net/2"), ("http://red.net/2", "http://q.com/de/"),
    ]
    at = {}

    def root(x):
        while at.setdefault(x, x) != x:
            x = at[x]
        return x

    for a, b in links:
        at[root(a)] = root(b)
    groups = {}
    for x in list(at):
        found = rule_of(x, rules)
        groups.setdefault(root(x), set()).update({found[1]} if found else set())
    want = []
    for i, url, _ in PAGES:
        found = rule_of(url, rules)
        name = (url or "").split("#")[0].replace("HTTP://Other.NET", "http://other.net") if url and "://" in url.split("#")[0] else url
        passed = groups.get(root(name), set()) if name in at else set()
        verdict = found[1] if found else "allow" if "allow" in passed or not passed else "block"
        want.append((i, *split_url(url), found and found[2], verdict))
    assert got == sorted(want, key=repr)
    table = tuple(zip(*PAGES))
    con = duckdb.connect()
    pages = pa.table({n: pa.array(c, k) for n, c, k in zip(("page_id", "url", "html"), table, (pa.int64(), pa.string(), pa.string()))})
    con.register("pages", pages)
    plain = urls.judged(spark.createDataFrame(PAGES, "page_id long, url string, html string"), rules)
    assert compare(con, plain, queries.URLS_SQL) is None
    # Links pass a decision on, and only where no rule fits.
    verdicts = {r[0]: (r[3], r[4]) for r in got}
    assert [verdicts[i] for i in (2, 3, 4, 10, 11, 21, 22)] == [(None, "block")] * 7
    assert verdicts[7] == (None, "allow") and verdicts[9] == (None, "allow") and verdicts[6] == ("com/de/", "block")
    assert verdicts[5] == ("com/fr/", "allow") and verdicts[14] == (None, "allow") and verdicts[15] == ("org/", "allow")


def test_urls_of_many_rules_and_of_none(spark, monkeypatch):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert {r.rule for r in urls.judged(frame, []).collect()} == {None}
    assert urls.judged(frame.limit(0), queries.RULES).count() == 0
    pick = random.Random(3)
    rules = [(f"h{pick.randrange(9)}.net", "/" + "ab"[pick.randrange(2)] * pick.randrange(4), pick.choice(["allow", "block"])) for _ in range(200)] + [("net", "", "block")]
    table = [(i, f"http://{'s.' * (i % 3)}h{i % 11}.net/{'ab'[i % 2] * (i % 5)}", "") for i in range(300)]
    monkeypatch.setattr(urls, "BROADCAST_ROWS", 0)
    got = rows(urls.judged(spark.createDataFrame(table, "page_id long, url string, html string"), rules))
    assert got == sorted(((i, *split_url(u), rule_of(u, rules)[2], rule_of(u, rules)[1]) for i, u, _ in table), key=repr)


def test_a_long_chain_and_a_hub_of_aliases(spark):
    chain = [(i, f"http://c.net/{i}", f'<link rel="canonical" href="{i + 1}">') for i in range(60)]
    hub = [(100 + i, f"http://h.net/{i}", '<link rel="canonical" href="http://h.com/de/">') for i in range(500)]
    table = [*chain, (60, "http://c.net/60", '<meta http-equiv="Refresh" content="5;URL=http://x.com/de/1">'), *hub]
    got = urls.judged(spark.createDataFrame(table, "page_id long, url string, html string"), queries.RULES)
    assert {r.verdict for r in got.collect()} == {"block"}


def test_url_query_runs_without_python(spark):
    found = queries.QUERIES["op13_url_filters"](spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", plan)
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    want = [(p.page_id, *split_url(p.url), (rule_of(p.url, queries.RULES) or (0, 0, None))[2], (rule_of(p.url, queries.RULES) or (0, "allow"))[1]) for p in pages]
    assert rows(found) == sorted(want, key=repr)
