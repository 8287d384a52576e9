"""Repeated passages against all pairs of paragraphs."""

import random
import re

import numpy as np
import pytest

from spanloom.llm.substring_dedup import LEAST_WORDS, SPACING, WINDOW, anchors, paragraphs, repeated_passages, without_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def units(text):
    """Paragraphs as (start, end, words), by plain loops."""
    lines, at = [], 0
    for line in (text or "").split("\n"):
        lines.append([(m.start() + at, m.end() + at, m.group().lower()) for m in WORD.finditer(line)])
        at += len(line) + 1
    out = []
    for k, words in enumerate(lines):
        if not words:
            continue
        own, j = list(words), k + 1
        while len(words) < 50 and len(own) < 50 and j < len(lines) and len(lines[j]) < 50:
            own += lines[j]
            j += 1
        if len(own) >= 50:
            out.append((own[0][0], own[-1][1], [w for *_, w in own]))
    return out


def brute(rows):
    every = [(doc, s, e, {tuple(w[k : k + 5]) for k in range(len(w) - 4)}) for doc, text in rows for s, e, w in units(text)]
    root = list(range(len(every)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(every)):
        for b in range(a):
            both = len(every[a][3] & every[b][3])
            if both and 100 * both >= 75 * (len(every[a][3]) + len(every[b][3]) - both):
                root[find(a)] = find(b)
    groups = {}
    for k, (doc, s, e, _) in enumerate(every):
        groups.setdefault(find(k), []).append((doc, s, e))
    out = []
    for g in groups.values():
        if len({doc for doc, *_ in g}) > 1:
            keeper = min(g)[0]
            out += [(doc, s, e, keeper, doc != keeper) for doc, s, e in g]
    return sorted(out)


def repeated_words(rows, n):
    """Of each row, start and end of its words and whether each lies in n words that another row has too."""
    words = [[(m.start(), m.end(), m.group().lower()) for m in WORD.finditer(t or "")] for _, t in rows]
    where = {}
    for k, own in enumerate(words):
        for a in range(len(own) - n + 1):
            where.setdefault(tuple(x for *_, x in own[a : a + n]), set()).add(k)
    out = []
    for own in words:
        told = [False] * len(own)
        for a in range(len(own) - n + 1):
            if len(where[tuple(x for *_, x in own[a : a + n])]) > 1:
                told[a : a + n] = [True] * n
        out.append([(s, e, t) for (s, e, _), t in zip(own, told, strict=True)])
    return out


def check_runs(rows, found):
    """Every passage of 50 words is found but for its edges, and every run consists of words of repeated windows."""
    spans = {}
    for x in found:
        spans.setdefault(x.doc_id, []).append((x.start_char, x.end_char, x.cluster_id < 0))
    for (doc, _), long, short in zip(rows, repeated_words(rows, LEAST_WORDS), repeated_words(rows, WINDOW), strict=True):
        own = spans.get(doc, [])
        inside = [any(a <= s and e <= b for a, b, _ in own) for s, e, _ in long]
        for k, (_, _, told) in enumerate(long):
            assert not told or any(inside[max(0, k - SPACING + 1) : k + SPACING])
        for (s, e, told), near in zip(short, inside, strict=True):
            assert told or not any(run and a <= s and e <= b for a, b, run in own), (doc, s, e, near)


def test_passages_inside_lines(spark):
    r = random.Random(7)
    line = lambda n: " ".join(f"v{r.randrange(5000)}" for _ in range(n))
    passages = [line(n) for n in (50, 51, 53, 58, 80, 300)]
    rows = [(k, f"{line(r.randrange(40))} {passages[k % 6]} {line(r.randrange(200))}") for k in range(48)]
    rows += [(100, line(300)), (101, f"{line(30)} {passages[0][:150]} {line(30)}"), (102, passages[4]), (103, f"{passages[5]}\n{line(8)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = repeated_passages(docs).collect()
    check_runs(rows, found)
    assert {x.doc_id for x in found} == set(range(48)) | {102, 103}
    runs = [x for x in found if x.cluster_id < 0]  # some of the lines are similar as paragraphs, too
    assert {x.keep_doc_id for x in runs} == set(range(6)) and {x.doc_id for x in runs if not x.removed} == set(range(6))


def test_copy_groups_that_share_a_passage(spark):
    r = random.Random(11)
    line = lambda n: " ".join(f"z{r.randrange(10**6)}" for _ in range(n))
    passage = line(60)
    x, y = (f"{line(70)} {passage} {line(70)}" for _ in range(2))
    docs = spark.createDataFrame([(1, x), (2, x), (3, y), (4, y)], "doc_id long, text string")
    inner = passage.split()[SPACING:-SPACING]
    kept = {d.doc_id: d.text for d in without_repeats(docs).collect()}
    assert [d for d, text in sorted(kept.items()) if " ".join(inner) in text] == [1]
    assert kept[1] == x and not kept[2] and not kept[4]
    assert kept[3].startswith(y[: y.index(passage)]) and kept[3].endswith(y[y.index(passage) + len(passage) :])


def test_lost_words_stay_in_their_keeper(spark):
    r = random.Random(13)
    line = lambda n: " ".join(f"y{r.randrange(10**6)}" for _ in range(n))
    p, q = line(60), line(140)
    rows = [(1, f"{line(150)} {p} {line(150)}"), (5, f"{line(400)} {p} {q} {line(400)}"), (6, f"{line(400)} {p} {q} {line(400)}")]
    chain = line(600).split()  # each row overlaps the next ones
    rows += [(10 + k, f"{line(300)} {' '.join(chain[a : a + 90 + 10 * (k % 5)])} {line(300)}") for k, a in enumerate(r.sample(range(0, 500, 9), 40))]
    # a near copy loses a paragraph with a passage that its keeper lacks, and that another row has in a longer line
    near = line(400).split()
    rows += [(60, " ".join(near[:200] + ["other"] + near[201:])), (61, " ".join(near)), (62, f"{line(400)} {' '.join(near[170:235])} {line(400)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts, found = dict(rows), repeated_passages(docs).collect()
    check_runs(rows, found)
    kept = {d.doc_id: f" {' '.join(d.text.split())} " for d in without_repeats(docs).collect()}
    lost = [x for x in found if x.cluster_id < 0 and x.removed]
    for x in lost:
        words = texts[x.doc_id][x.start_char : x.end_char].split()
        assert len(words) == x.n_words and f" {' '.join(words)} " in kept[x.keep_doc_id] and x.keep_doc_id != x.doc_id
    assert f" {q.rsplit(' ', SPACING)[0]} " in kept[5] and q.split()[60] not in kept[6]
    assert {1, 5} <= {x.keep_doc_id for x in found} and len({x.doc_id for x in lost}) > 20
    assert " ".join(near[180:225]) in kept[62]


def test_anchors_leave_no_gap():
    r = np.random.default_rng(3)
    words = r.integers(0, 1 << 63, 4000, dtype=np.uint64)
    text = np.repeat([0, 1, 2], [60, 40, 3900])
    chosen = anchors(words, text)
    assert (text[chosen] == text[chosen + WINDOW - 1]).all() and not (text[chosen] == 1).any()
    assert np.diff(chosen[text[chosen] == 2]).max() <= SPACING


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}é" for k in range(3000)]
    line = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared = [line(n) for n in (55, 60, 120, 51)] + ["\n".join(line(20) for _ in range(3)), "\n\n".join(line(9) for _ in range(8))]
    rows = []
    for k in range(60):
        parts = [line(r.choice([3, 10, 30, 60, 100])) for _ in range(r.randrange(0, 6))]
        if r.random() < 0.5:
            words = re.split(r"( |\n)", r.choice(shared))
            for _ in range(r.choice([0, 0, 1])):
                words[2 * r.randrange(len(words) // 2)] = r.choice(vocabulary).upper()
            parts.insert(r.randrange(len(parts) + 1), "".join(words))
        rows.append((k * 2, "\n".join(parts)))
    rows += [(501, rows[3][1]), (503, None), (505, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = repeated_passages(docs).collect()
    got = sorted((x.doc_id, x.start_char, x.end_char, x.keep_doc_id, x.removed) for x in found if x.cluster_id >= 0)
    assert got == brute(rows) and len(got) > 20
    check_runs(rows, found)
    got = [(x.doc_id, x.start_char, x.end_char, x.keep_doc_id, x.removed) for x in found]
    kept = {x.doc_id: x.text for x in without_repeats(docs).collect()}
    lost = {}
    for doc, s, e, _, removed in got:
        if removed:
            lost.setdefault(doc, set()).update(range(s, e))
    for doc, text in rows:
        assert kept[doc] == (text if doc not in lost else "".join(c for k, c in enumerate(text) if k not in lost[doc]))


def test_paragraphs_of_lines():
    a, b = paragraphs(np.array([60, 20, 0, 20, 20, 55, 10, 45, 10]), np.array([0, 0, 0, 0, 0, 0, 0, 1, 1]))
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 1), (1, 5), (5, 6), (7, 9)]


def test_odd_tables(spark):
    assert repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    text = " ".join(f"x{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text, 1), (1, text, 2), (None, text, 3), (2, "short", 4)], "doc_id long, text string, key int")
    got = [(x.doc_id, x.removed) for x in repeated_passages(docs).collect()]
    assert sorted(got, key=str) == [(1, True), (1, True), (None, False)]
    assert sorted(x.text for x in without_repeats(docs).collect()) == ["", "", "short", text]
