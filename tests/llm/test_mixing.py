"""Source mixing: targets against a plain computation, balance, limits, odd tables."""

import random
import re

import numpy as np

from spanloom.llm.mixing import flight, landing, mix, mixed_documents

SCHEMA = "doc_id long, source string, text string"


def plain_targets(sizes):
    """Targets of sources in order: shares by weight, with what is above the limits shared anew."""
    names = sorted(x for x in sizes if x is not None) + [x for x in sizes if x is None]
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        out |= {s: 3 * sizes[s] for s in over}
        open_ -= over
    return out


def rows_of(seed, n=600):
    r = random.Random(seed)
    sources = ["a", "b", "c", "é", None, "tiny"]
    out = [(k, r.choices(sources, [40, 10, 30, 10, 9, 1])[0], " ".join("w" for _ in range(r.choice([0, 1, 5, 40, 200])))) for k in range(n)]
    return out + [(n, "empty", ""), (n + 1, "a", None)]


def test_targets_and_balance(spark):
    rows = rows_of(1)
    for block in (20_000, 16):
        got = mix(spark.createDataFrame(rows, SCHEMA), block).collect()
        sizes, largest, taken, target, source = {}, {}, {}, {}, {k: s for k, s, _ in rows}
        for k, s, t in rows:
            n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            sizes[s], largest[s] = sizes.get(s, 0) + n, max(largest.get(s, 0), n)
        assert sorted(r["doc_id"] for r in got) == [r[0] for r in rows]
        for r in got:
            s = source[r["doc_id"]]
            taken[s], target[s] = taken.get(s, 0) + r["taken"], r["target"]
            assert r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[s]
        for s, t in plain_targets(sizes).items():
            assert abs(target[s] - t) < 1e-6 * max(1, t)
            assert abs(taken[s] - t) <= largest[s]


def test_reruns_agree(spark):
    docs = spark.createDataFrame(rows_of(2), SCHEMA)
    assert sorted(mix(docs).collect()) == sorted(mix(docs.repartition(5)).collect())


def test_flight_keeps_sums_and_means():
    p, size = np.linspace(0.1, 0.9, 50), np.arange(50) % 7 + 1.0
    ends = [flight(p, size, np.random.default_rng(k)) for k in range(400)]
    for q in ends[:50]:
        assert ((q > 0) & (q < 1)).sum() <= 2
        assert abs(q.sum() - p.sum()) < 1e-6 and abs(q @ size - p @ size) < 1e-5
    assert np.abs(np.mean(ends, axis=0) - p).max() < 0.12
    assert set(landing(ends[0], size)) <= {0.0, 1.0}


def test_odd_tables(spark):
    rows = [(1, "a", "x y"), (1, "a", "x y"), (None, None, None), (2, "b", " "), (3, "b", "z " * 5000)]
    docs = spark.createDataFrame([(*r, "extra", 7) for r in rows], SCHEMA + ", size string, target long")
    got = mix(docs).collect()
    assert len(got) == 5 and all(r["taken"] <= 3 * r["size"] for r in got)
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r["copies"] for r in got)
    assert mix(docs.limit(0)).count() == 0 and mixed_documents(docs.limit(0)).count() == 0


def test_clashing_names_and_repeated_rows(spark):
    rows = [(1, "a", "x y z", 1, 2, 3), (1, "a", "x y z", 1, 2, 3), (None, "b", "u v", 4, 5, 6), (2, "b", "w " * 5000, 7, 8, 9)]
    docs = spark.createDataFrame(rows, SCHEMA + ", _id int, key int, copies int")
    got = mix(docs).collect()
    out = mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in got)
    assert {tuple(r) for r in out.collect()} <= set(rows)
