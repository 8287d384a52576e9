"""Runs against a search of all periods and starts, and the report's digests against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from spanloom.llm import periodic_runs as pr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least):
    """All runs of w: of each period the stretches in which words that far apart are equal, without those that a smaller period explains."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, 2 * q):
                part = w[i : i + size]
                if not any(all(part[k] == part[k + r] for k in range(size - r)) for r in range(1, q)):
                    out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


@pytest.mark.parametrize("few", [0, 2, 48])
def test_runs(few, monkeypatch):
    monkeypatch.setattr(pr, "FEW", few)
    r = random.Random(few)
    for _ in range(150):
        texts = []
        for _ in range(r.randrange(1, 6)):
            n, k = r.choice([0, 1, 2, 3, 10, 30, 60, 120]), r.choice([1, 2, 3, 10])
            d = [r.randrange(k) for _ in range(n)]
            if n and r.random() < 0.5:
                a = r.randrange(n)
                p = 1 + (n - a) // (3 + r.randrange(8))
                d = [d[i] if i < a else d[a + (i - a) % p] for i in range(n)]
            texts.append(d)
        least = r.choice([2, 12])
        offsets = np.concatenate([[0], np.cumsum([len(d) for d in texts])]).astype(np.int64)
        found = pr.runs(np.array([x for d in texts for x in d], np.int64), offsets, least)
        got = [[] for _ in texts]
        for t, *run in zip(*(x.tolist() for x in found), strict=True):
            got[t].append(tuple(run))
        assert got == [brute(d, least) for d in texts]


def want(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w, 12)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(x for k, x in enumerate(w) if k not in gone))]
    if not runs:
        return (0, None, None, None, None, *sha)
    s, n, q = min(runs, key=lambda x: (-x[1], x[0], x[2]))
    return (len(runs), s, n, q, 1000 * n // q, *sha)


def test_report(spark):
    r = random.Random(5)
    gaps = [" ", "\n", "\t", "\x0b", "\x0c", "\r", "  ", "  ", "\x1c "]
    texts = ["".join(r.choice(["a", "b", "é", "A", "ab", "😀"][: r.choice([2, 6])]) + r.choice(gaps) for _ in range(r.choice([0, 5, 20, 60, 150]))) for _ in range(300)]
    texts += [None, "", " \n", "x " * 5000, "q" * 200_000, "one two " * 300 + "three"]
    rows = [(k, t, "clash") for k, t in enumerate(texts)] + [(3, texts[3], "again"), (None, "b b b b b b b b b b b b b", "null")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    got = sorted((tuple(x) for x in pr.run_report(docs).collect()), key=str)
    assert got == sorted(((k, *want(k, t)) for k, t, _ in rows), key=str)
    assert sum(x[1] > 0 for x in got) > 10
    assert pr.run_report(docs.limit(0)).collect() == []


def test_a_long_text_takes_no_quadratic_time(spark):
    text = "w " * 300_000 + " ".join(f"u{k % 40_000}" for k in range(120_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [tuple(x)[1:] for x in pr.find_runs(docs).select("doc_id", "start", "length", "period").orderBy("start").collect()]
    assert got == [(0, 300_000, 1), (300_000, 120_000, 40_000)]


def test_collapse(spark):
    docs = spark.createDataFrame([(1, "x  " + "a b " * 9 + "y", 7), (2, "a  b", 8), (3, None, 9)], "doc_id long, text string, n_runs int")
    got = {x.doc_id: (x.text, x.n_runs) for x in pr.collapse(docs).collect()}
    assert got == {1: ("x a b y", 7), 2: ("a  b", 8), 3: (None, 9)}
    assert [tuple(x) for x in pr.find_runs(docs).collect()] == [(1, 1, 18, 2, "a b")]
