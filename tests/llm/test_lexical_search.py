"""Search against plain Python and DuckDB, cuts of blocks against all cuts, and what blocks skip."""

import collections
import itertools
import math
import random
import re

import duckdb
import numpy as np

from spanloom.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, best):
    held = [(k, c) for k, t in docs if (c := collections.Counter(terms(t)))]
    n_docs, n_words = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for k, c in held:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, k is None, k))
        out += [(item, r, k, -s) for r, (s, _, k) in enumerate(sorted(found)[:best], 1)]
    return sorted(out, key=str)


def corpus(r, n):
    bits = ["the", "The", "of", "a", "é", "É", "x1", "rare", "日本", "ẞ", "ß", "İ", "k"] + [f"w{k}" for k in range(30)]
    return [(k, "".join(r.choice(bits[: r.choice([4, 43])]) + r.choice([" ", "-", "\n", "_", "\x00", "  "]) for _ in range(r.choice([0, 1, 5, 40])))) for k in range(n)]


def test_search(spark):
    r = random.Random(2)
    docs = corpus(r, 500) + [(None, "rare w1"), (7, "w1 w2"), (7, "w1 w2"), (1000, None), (1001, ""), (1002, "w3 the " * 40_000)]
    items = corpus(r, 25) + [(90, None), (91, "!!"), (92, "absent"), (None, "rare"), (93, "the of a " * 3)]
    d = spark.createDataFrame([(k, t, "s") for k, t in docs], "doc_id long, text string, score string").repartition(5)
    i = spark.createDataFrame(items, "item_id int, text string")
    want = brute(docs, items, 50)
    for shard, size in ((1 << 20, 1 << 20), (700, 1 << 20), (2000, 600)):
        assert sorted((tuple(x) for x in ls.search(d, i, item_bytes=size, shard_postings=shard).collect()), key=str) == want
    assert sorted((tuple(x) for x in ls.search(d, i, best=3, shard_postings=700).collect()), key=str) == brute(docs, items, 3)


def test_empty_tables(spark):
    d, i = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ls.search(d.limit(0), i).collect() == []
    assert ls.search(d, i.limit(0)).collect() == []
    assert [tuple(x) for x in ls.search(d, i).collect()] == brute([(1, "a b")], [(1, "a")], 50)


def test_blocks_are_the_cheapest(monkeypatch):
    monkeypatch.setattr(ls, "LONGEST", 4)
    r = np.random.default_rng(3)
    for _ in range(60):
        sizes = r.integers(0, 9, 4)
        lists = np.concatenate([[0], np.cumsum(sizes)])
        scores = r.integers(0, 50, lists[-1])
        docs = np.concatenate([np.sort(r.choice(40, n, replace=False)) for n in sizes])
        first = ls.cut_blocks(docs, scores, lists)
        for a, b in zip(lists[:-1], lists[1:], strict=True):
            own, at = scores[a:b], docs[a:b]
            price = ls.PRICE * own.mean() + 1 if b > a else 0

            def cost(cuts, own=own, at=at, price=price):
                parts = list(itertools.pairwise(cuts))
                if not all(0 < y - x <= 4 for x, y in parts):
                    return math.inf
                return sum((at[y - 1] - at[x] + 1) * own[x:y].max() - own[x:y].sum() + price for x, y in parts)

            if b > a:
                got = [*(first[(first >= a) & (first < b)] - a), b - a]
                best = min(cost([0, *c, b - a]) for k in range(b - a) for c in itertools.combinations(range(1, b - a), k))
                assert math.isclose(cost(got), best, rel_tol=1e-9, abs_tol=1e-6)


def test_windows_are_skipped():
    r = np.random.default_rng(4)
    n = 20_000
    parts = [(np.sort(r.choice(n, size, replace=False)), t) for t, size in enumerate((12_000, 6_000, 300, 40))]
    doc = np.concatenate([d for d, _ in parts])
    term = np.concatenate([np.full(len(d), t) for d, t in parts])
    score = (r.gamma(2, 50, len(doc)) * np.array([1, 3, 20, 60])[term]).astype(np.int64)
    shard = ls.Shard(n, doc, term, score, 4)
    found, scores = shard.best(np.arange(4), 20)
    whole = np.bincount(doc, score, n).astype(np.int64)
    order = np.lexsort((np.arange(n), -whole))[:20]
    assert found.tolist() == order.tolist() and scores.tolist() == whole[order].tolist()
    assert shard.scored < len(doc) / 3


def test_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    got = ls.search(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"), shard_postings=20_000)
    assert sorted(tuple(x) for x in got.collect()) == sorted(con.sql(ls.search_sql()).fetchall())
