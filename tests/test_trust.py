"""Trust folds and walks on hand-made ledgers."""

import random

import pytest

from spanloom.operators import trust as T
from spanloom.plans import community


def decided(spark, *runs):
    rows = [(a, k, ok) for a, oks in runs for k, ok in enumerate(oks)]
    return {r.author: r.score for r in T.fold(spark.createDataFrame(rows, "author string, seq long, accepted boolean")).collect()}


def test_fold(spark):
    got = decided(spark, ("three", [True] * 3), ("bad", [False] * 50), ("good", [True] * 1000), ("mixed", [False, True]), ("cutoff", [True] * 14))
    assert got == {"three": pytest.approx(0.25), "bad": 0.0, "good": 2.0, "mixed": pytest.approx(0.07), "cutoff": pytest.approx(0.8)}


def boot(spark, direct, edges):
    d = spark.createDataFrame([(a, s, 1) for a, s in direct], "author string, score double, n long")
    e = spark.createDataFrame(edges, "author string, target string, score double")
    return d, {r.author: r.bootstrap for r in T.bootstrap(d, e).collect()}


def test_chain(spark):
    _, got = boot(spark, [("A", 0.8)], [("A", "B", 0.95), ("B", "C", 0.9)])
    assert 0.1 + got["C"] == pytest.approx(0.271)


def test_many_endorsers_are_capped(spark):
    direct, edges = [(f"s{k}", 1.0) for k in range(30)], [(f"s{k}", "X", 1.0) for k in range(30)]
    d, _ = boot(spark, direct, edges)
    b = T.bootstrap(d, spark.createDataFrame(edges, "author string, target string, score double"))
    authors = spark.createDataFrame([("X",), ("Y",), ("s1",)], "author string")
    got = {r.author: r.weight for r in T.effective(authors, d, b).collect()}
    assert got == {"X": 0.4, "Y": 0.1, "s1": 1.0}


def test_cycles_end(spark):
    _, got = boot(spark, [("A", 1.0)], [("A", "B", 1.0), ("B", "A", 1.0), ("B", "C", 1.0)])
    assert got == {"B": pytest.approx(0.5), "A": pytest.approx(0.25), "C": pytest.approx(0.25)}


def test_promotion_starts_from_the_graph(spark):
    d = spark.createDataFrame([("A", 0, True), ("B", 0, False)], "author string, seq long, accepted boolean")
    b = spark.createDataFrame([("A", 5.0), ("B", 5.0)], "author string, bootstrap double")
    assert {r.author: r.score for r in T.fold(d, b).collect()} == {"A": 0.45, "B": 0.32}


def plain_evict(edges, direct, most):
    """One author after the other, all weights taken anew each time by a search of all paths."""
    held = {}
    for a, t, x in edges:
        held.setdefault(a, {})[t] = x

    def given(target):
        total, stack = 0.0, [(a, s, 1, {a}) for a, s, n in direct if n > 0 and s >= 0.8]
        while stack:
            node, value, depth, seen = stack.pop()
            for nxt, x in held.get(node, {}).items():
                if nxt == target:
                    total += 0.5**depth * value * x
                if depth < 4 and nxt not in seen and nxt in held:
                    stack.append((nxt, value * x, depth + 1, seen | {nxt}))
        return total

    fixed = {a: s for a, s, n in direct if n > 0}
    while sum(map(len, held.values())) > most:
        weight = {a: round(fixed[a] if a in fixed else min(max(0.1 + given(a), 0.1), 0.4), 9) for a in held}
        del held[min(held, key=lambda a: (weight[a], a))]
    return {(a, t) for a, e in held.items() for t in e}


@pytest.mark.parametrize("seed", range(2))
def test_eviction_takes_weights_anew(spark, seed):
    r = random.Random(seed)
    names = [f"a{k}" for k in range(9)]
    edges = [(a, t, round(r.random(), 3)) for a in names for t in r.sample(names, r.randrange(0, 5)) if a != t]
    direct = [(a, round(r.choice([0.05, 0.3, 0.9, 1.7]), 3), r.choice([0, 1, 3])) for a in r.sample(names, 4)]
    e = spark.createDataFrame(edges, "author string, target string, score double")
    d = spark.createDataFrame(direct, "author string, score double, n long")
    for most, small in [(len(edges) // 3, 0)] + [(n, 10_000) for n in (len(edges) // 3, len(edges) // 2)]:
        assert {(x.author, x.target) for x in T.evict(e, d, most, small).collect()} == plain_evict(edges, direct, most)


def test_running_sum(spark):
    rows = [(k * 7 % 101, k) for k in range(101)]
    got = {x.k: x.upto for x in T.running_sum(spark.createDataFrame(rows, "k long, v long"), ["k"], "v", "upto").collect()}
    total, want = 0, {}
    for k, v in sorted(rows):
        total += v
        want[k] = total
    assert got == want


@pytest.mark.parametrize("name", ["o6_evicted_endorsements", "g1_bootstrap", "g2_effective_weight"])
def test_endorsements_are_made_once(spark, name):
    """The lines behind the endorsements are grouped once: what a query joins again and again is a stored table."""
    out = community.queries()[name](spark, "/root/testdata/sf0.001")
    assert not [f for f in out.inputFiles() if "lineitem" in f]
