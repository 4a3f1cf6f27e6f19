"""URL filters, source divergence and ranked lexical search against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from proofsieve.llm import divergence, lexical, urls

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {b: b + 32 for b in range(65, 91)}


# URL filters

def judged(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.translate(LOWER)
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, default))
    return host, path, best[2], best[3]


ODD_URLS = [None, "", "no scheme", "://", "http://", "HTTP://A.Example.NET", "http://a.example.net/en/x?y#z", "http://net/", "http://.net/", "http://net./", "http://x.net?/en/", "http://example.com/de", "http://example.com/de/",
            "http://u:p@example.com:80/de/", "http://aexample.net/en/", "a://b://c.org/fr/1", "http://ÄÖ.org/fr/é", "http://org/fr/\nx", "http://" + "a." * 3000 + "net/" + "x" * 5000, "http://x.org//fr/", "http://X.ORG/FR/"]


def test_urls_by_fixed_rules(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(ODD_URLS + ODD_URLS[5:8])] + [(None, "http://net/"), (3, "http://net/")], "page_id long, url string")
    got = urls.report(pages)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = sorted(((r.page_id, *judged(r.url, urls.RULES)) for r in pages.collect()), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want


@pytest.mark.parametrize("most_bytes", [urls.MOST_BYTES, 60])
def test_urls_by_many_rules(spark, most_bytes):
    rng = random.Random(3)
    name = lambda: ".".join(rng.choice("ab") * rng.randint(1, 2) for _ in range(rng.randint(1, 3)))
    way = lambda: "".join(rng.choice(["/", "/c", "/d/"]) for _ in range(rng.randint(0, 2)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((name(), way()) for _ in range(90))}.values())
    pages = [(i, f"https://{name()}{way()}") for i in range(400)]
    odd = [("", "/", "block"), ("b", "no-slash", "block"), (None, "/", "block")]  # rules that fit nothing
    rule_rows = spark.createDataFrame(rules + odd, "host string, path string, verdict string")
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), rule_rows, default="block", most_bytes=most_bytes)
    assert sorted(map(tuple, got.collect())) == sorted((i, *judged(u, rules, "block")) for i, u in pages)


def test_cascade_is_exact(spark, monkeypatch):
    monkeypatch.setattr(urls, "BITS", 2)  # a wrong answer for a large share of keys on every level
    monkeypatch.setattr(urls, "POSITIONS", 1)
    listed, others = [f"l{i}" for i in range(300)], [f"o{i}" for i in range(3000)]
    keys = lambda x: spark.createDataFrame([(k,) for k in x], "key string")
    first = urls.filter_of(keys(listed), len(listed), 0)
    wrong = [k for k, p in zip(others, first.passes(others), strict=True) if p]
    cascade = urls.grown(first, keys(listed), keys(wrong))
    assert len(wrong) > 300 and len(cascade.levels) > 3
    assert cascade.has(listed).all() and not cascade.has(others).any()


def test_urls_empty_and_other_columns(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urls.report(pages).collect() == []
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    rows = spark.createDataFrame([(1, "http://a.net/", "r", "h", "p")], "page_id int, url string, rule string, host string, key string")
    assert [tuple(r) for r in urls.judge(rows, rules).collect()] == [(1, "a.net", "/", None, "allow")]
    block = spark.createDataFrame([("NET", "/", "block")], "host string, path string, verdict string")
    both = rows.unionAll(spark.createDataFrame([(2, None, None, None, None)], rows.schema))
    assert [tuple(r) for r in urls.allowed(both, block).collect()] == [(2, None, None, None, None)]


# source divergence

def divergence_by_hand(rows, least=3, most=200):
    langs = defaultdict(list)
    for lang, source, text in rows:
        langs[lang or ""].append((source or "", Counter(TERM.findall((text or "").translate(LOWER)))))
    out = []
    for lang, docs in langs.items():
        df = Counter(t for _, c in docs for t in c)
        kept = sorted(t for t, n in df.items() if n >= least)
        count = defaultdict(Counter)
        for source, c in docs:
            count[source].update({t: n for t, n in c.items() if t in set(kept)})
        every = sum(count.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(every)
        f = lambda a, b: (a - b) ** 2 // b
        for s in count:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in count if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, items, end in (("pair", pairs, None), ("term", terms, most)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:end]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def some_documents(n=300, seed=5):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "don't", "x1y", "Ähre", "ñandú", "日本", "THE", "the", "z"] + [f"w{c}{d}" for c in "abcdef" for d in "ghij"]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", "É", None]), " ".join(rng.choices(words, k=rng.randint(0, 30)))) for _ in range(n)]
    return rows + [("en", "a", "copy of one text the beta")] * 100 + [("en", "b", "copy of one text the beta")] * 7 + [("fr", "only", "few words"), ("fr", "other", None), ("it", "s", ""), ("en", "d", None), (None, None, None)]


@pytest.mark.parametrize("small", [False, True])
def test_divergence(spark, monkeypatch, small):
    if small:  # blocks, pairs and memory of a few rows each; the functions of a task carry the values along
        for name, value in (("REMEMBERED", 3), ("BLOCK", 400), ("ROWS", 5), ("PAIRS", 64)):
            monkeypatch.setattr(divergence, name, value)
    rows = some_documents()
    docs = spark.createDataFrame([(i, *r, i) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, n long").repartition(5)
    got = divergence.report(docs, most_terms=6)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == divergence_by_hand(rows, most=6)


def test_divergence_of_many_sources_and_long_texts(spark):
    rng = random.Random(8)
    text = " ".join(f"q{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(200_000))
    rows = [("en", f"s{i}", "shared words of all") for i in range(40)] + [("en", "s1", text), ("en", "s2", text), ("en", "s3", text + " more")] + [("en", f"s{rng.randint(0, 39)}", "words of some") for _ in range(30)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(map(tuple, divergence.report(docs).collect())) == divergence_by_hand(rows)


def test_divergence_of_nothing(spark):
    assert divergence.report(spark.createDataFrame([], "lang string, source string, text string")).collect() == []
    rows = [("en", "a", None), ("en", "b", "one"), ("en", "b", "")]
    got = divergence.report(spark.createDataFrame(rows, "lang string, source string, text string"))
    assert sorted(map(tuple, got.collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_shares_are_exact(spark):
    counts = [(0, 0, 1), (10**13, 10**14, 10**9), (10**13 + 1, 3 * 10**13 + 7, 12345), (5, 9, 0)]
    got = spark.createDataFrame(counts, "c long, n long, v long").select(divergence.shares("c", "n", "v")).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (c + 1) // (n + v) if v else None for c, n, v in counts]


# ranked lexical search

def found_by_hand(docs, items, k=10):
    bags = [(d, Counter(WORD.findall((t or "").translate(LOWER)))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    asked = defaultdict(Counter)
    for item, text in dict.fromkeys(items):
        asked[item].update(WORD.findall((text or "").translate(LOWER)))
    out = []
    for item, terms in asked.items():
        hits = []
        for d, b, n in bags:
            m = 100 - 75 + 75 * n * n_docs // n_terms
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t, times in terms.items() if t in b)
            hits.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(h for h in hits if h[0] < 0)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_lexical(spark, monkeypatch, small):
    if small:
        for name, value in (("CELLS", 8), ("PART", 200)):
            monkeypatch.setattr(lexical, name, value)
    rng = random.Random(2)
    words = ["Alpha", "beta", "1a", "x", "ÄB", "äb", "日本", "don", "t", "42"] + [f"w{i}" for i in range(40)]
    docs = [(i, rng.choice([" ", "-", "\n"]).join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(400)]
    docs += [(1000 + i, "beta copies of one") for i in range(60)] + [(7, "beta 42"), (7, "beta 42"), (None, "beta 42 ÄB"), (900, None), (901, ""), (902, "don't x " * 20_000)]
    items = [(0, "Beta x BETA w1"), (1, "copies of one"), (2, "unheard"), (3, None), (4, "ÄB äb 日本-42"), (5, "w3 w4 w5 w6 w7"), (5, "w8"), (1, "copies of one"), (None, "t don")]
    docs_df = spark.createDataFrame([(*r, "more") for r in docs], "doc_id long, text string, item_id string").repartition(4)
    got = lexical.search(docs_df, spark.createDataFrame(items, "item_id int, text string"), most_terms=10 if small else lexical.MOST_TERMS)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == found_by_hand(docs, items)


def test_lexical_of_nothing(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    no_items, item = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for docs, items in ((none, item), (some, no_items), (none, no_items), (spark.createDataFrame([(1, None)], "doc_id long, text string"), item)):
        got = lexical.report(docs, items)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.collect() == []


def test_bits_of_a_class_are_verified(spark):
    """Classes that share a hash stay apart, since they are grouped by the whole bag."""
    bag = lambda *x: np.array(x, np.int32).tobytes()
    held = spark.createDataFrame([(3, 4, bag(0, 1)), (1, 4, bag(0, 1)), (2, 4, bag(1, 1)), (4, 9, bag(0, 1))], "doc_id long, n long, bag binary")
    got = {(r.m, bytes(r.bag)): r.members for r in lexical.classed(held, 4, 21, 1).collect()}
    assert got == {(82, bag(0, 1)): [1], (82, bag(1, 1)): [2], (25 + 75 * 9 * 4 // 21, bag(0, 1)): [4]}
