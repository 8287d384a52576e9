"""Language identification: code lengths against a plain model, held-out accuracy, odd tables."""

import math
import random

import numpy as np

from spanloom.llm import language_id
from spanloom.llm.language_id import ORDER, PAD, Model, count_tree, held_out, identify, keep_identified, learn

DIR = "/root/testdata/sf0.001"


def plain_bits(trained, text):
    """Bits of text under a context tree learnt from the trained texts, context by context."""
    seen = [{} for _ in range(ORDER + 1)]
    for x in trained:
        s = list(PAD + x)
        for k in range(ORDER, len(s)):
            for order in range(ORDER + 1):
                at = seen[order].setdefault(tuple(s[k - order : k]), {})
                at[s[k]] = at.get(s[k], 0) + 1
    total, s = 0.0, list(PAD + text)
    for k in range(ORDER, len(s)):
        for order in range(ORDER, -2, -1):
            if order < 0:
                total += 8
                break
            counts = seen[order].get(tuple(s[k - order : k]))
            if counts is None:
                continue
            n, distinct = sum(counts.values()), len(counts)
            if s[k] in counts:
                total -= math.log2(counts[s[k]] / (n + distinct))
                break
            total -= math.log2(distinct / (n + distinct))
    return total


def test_bits_are_those_of_a_plain_tree(monkeypatch):
    r = random.Random(5)
    trained = [[" ".join("".join(r.choice(letters) for _ in range(4)) for _ in range(30)).encode() for _ in range(3)] for letters in ("abcde", "cdéfgß")]
    monkeypatch.setattr(language_id, "CHUNK", 50)
    model = Model(["a", "b"], np.zeros(2), [count_tree(x) for x in trained])
    for text in (b"abc cde", "fgß é".encode(), b"zzz 9 !", b"a", trained[0][0]):
        assert np.allclose(model.bits([text])[0], [plain_bits(x, text) for x in trained], atol=1e-2)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    told = identify(docs, learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(told) > 20
    assert sum(r["lang"] == r["lang_pred"] for r in told) >= 0.95 * len(told)


def test_learning_leaves_held_out_rows_alone(spark):
    schema = "doc_id long, text string, lang string"
    rows = [(k, "uno dos tres", "es") if k % 2 else (k, "one two three", "en") for k in range(60)]
    docs = spark.createDataFrame(rows, schema)
    out = {r["doc_id"] for r in docs.where(held_out(docs["doc_id"])).select("doc_id").collect()}
    odd = spark.createDataFrame([(k, "kein Wort", "xx") if k in out else (k, t, g) for k, t, g in rows], schema)
    assert sorted(learn(odd).languages) == ["en", "es"]


def test_a_repeated_doc_id_does_not_swell_the_sample(spark):
    rows = [(1, f"uno dos {k}", "es") for k in range(500)] + [(k, f"one two {k}", "en") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert not docs.where("doc_id = 1").where(held_out(docs["doc_id"])).count()
    model = learn(docs, learn_rows=5)
    assert model.languages == ["en", "es"] and max(len(g.keys) for g in model.grams) < 200


def test_learning_starts_no_workers_of_another_kind(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"uno dos {k}", "es") for k in range(50)], "doc_id long, text string, lang string")

    def refuse(*_):
        raise AssertionError("rows of a list go through plain Python workers")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refuse)
    assert learn(docs).languages == ["es"] and learn(docs.where("lang = 'none'")).languages == []


def test_odd_tables(spark):
    schema = "doc_id long, text string, lang string, held_out string, score string"
    rows = [(1, "one two three " * 20, "en", "x", "y"), (2, None, "en", None, None), (3, "", None, None, None), (4, "12 34 !", "en", None, None), (None, "one two", None, None, None), (1, "one two three " * 20, "en", "x", "y"), (7, "é" * 300_000, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    got = identify(docs, learn(docs)).select("lang_pred", "score", "held_out").collect()
    assert [r["lang_pred"] for r in got] == ["en", "und", "und", "und", "en", "en", "en"]
    assert all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
    assert keep_identified(docs).columns == docs.columns
    assert keep_identified(docs).count() == 4
    none = docs.where("lang = 'none'")
    assert [r["lang_pred"] for r in identify(docs, learn(none)).collect()] == ["und"] * 7
    assert identify(none, learn(none)).count() == 0 and keep_identified(none).count() == 0
