"""Counts against plain Python, and the model on labelled rows."""

import collections
import random
import re

from spanloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    marked = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


def test_counts(spark):
    r = random.Random(3)
    bits = ["a", "A", "b", "é", "😀", " ", " ", "\n", "\n", "\t", "\x0b", "#", "<a>", "a b a\n", "|", " ", "a a a "]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(0, 120))) for _ in range(400)] + [None, "", "\n", "x y z " * 40000, "w " * 60, "q" * 300000]
    docs = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)], "doc_id long, text string, quality int").repartition(4)
    rows = {x.doc_id: x for x in quality.judge(docs, quality.Model()).collect()}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        x, want = rows[k], brute(t)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want, t
        assert x.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert x.kept == (not x.base_failed)


def test_model_tells_labelled_rows_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    half = labels.where("doc_id % 2 = 0")
    got = quality.judge(docs, quality.learn(docs, half)).join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed").collect()
    assert len(got) > 100
    assert sum(x.kept == (x.quality == 1) for x in got) >= 0.97 * len(got)
    assert sum(x.kept for x in got if x.quality == 1) >= 0.99 * sum(x.quality for x in got)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (None, 0), (1, None)], "doc_id long, quality int")
    assert quality.judge(empty, quality.learn(empty, labels)).collect() == []
    docs = spark.createDataFrame([(1, "word " * 10 + "a b c d e f g h i j k l m n o p q r s t u v w x y z 1 2 3 4 5 6 7 8 9 0 11 12 13 14 15 16"), (None, None)], "doc_id long, text string")
    got = {x.doc_id: (x.kept, x.probability) for x in quality.judge(docs, quality.learn(docs, labels)).collect()}
    assert got == {1: (True, 1.0), None: (False, 1.0)}
