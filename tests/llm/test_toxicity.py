"""Held-out rows, the corrected risk on planted words, and what may be learnt from."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from spanloom.llm import toxicity as tx


def test_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/check_s/documents.parquet")
    labels = spark.read.parquet("/root/testdata/check_s/labels.parquet")
    got = tx.score(docs, tx.learn(docs, labels))
    rows = got.join(labels, "doc_id").where("held_out").groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("predicted").alias("p")).collect()
    n, p = {r.toxic: r.n for r in rows}, {r.toxic: r.p for r in rows}
    assert n[1] > 500 and n[0] > 5000
    assert p[1] >= 0.95 * n[1] and p[0] <= 0.002 * n[0]


def table(spark, n=3000):
    """Texts of plain words; one in eight has a word that begins with 'vile'. A label tells of every third."""
    r, rows, labels = random.Random(9), [], []
    for k in range(n):
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(r.randrange(1, 60))]
        bad = r.random() < 0.125
        if bad:
            words.insert(r.randrange(len(words) + 1), "Vile" + r.choice("xyzuvw") + r.choice("abcdef"))
        rows.append((k, r.choice([" ", ", ", "\n"]).join(words), "x"))
        if k % 3 == 0:
            labels.append((k, int(bad)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_planted_words_and_labels_that_may_not_be_learnt(spark):
    rows, docs, labels = table(spark)
    model = tx.learn(docs, labels)
    assert model.trained and (model.weights > 0).all()
    got = {x.doc_id: x for x in tx.score(docs, model).collect()}
    assert len(got) == len(rows)
    for k, text, _ in rows:
        x = got[k]
        assert x.held_out == (zlib.crc32(str(k).encode()) % 3 == 1)
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7)
    assert sum(got[k].predicted == ("Vile" in t) for k, t, _ in rows) >= 0.99 * len(rows)
    turned = labels.withColumn("toxic", F.when(tx.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = tx.learn(docs, turned)
    assert np.array_equal(other.known, model.known) and np.allclose(other.weights, model.weights) and other.slope == model.slope


def test_features_are_words_and_runs_whatever_stands_between():
    def of(text):
        return set(tx.features([text.encode()])[0].tolist())

    assert of("Vilexa, b") == of("b vilexa!") and of("") == set()
    assert of("vilexa") & of("vilexb") and not of("vilexa") & of("alexvi")
    both, own = tx.features([b"one", b"", b"two three"])
    assert set(both[own == 0].tolist()) == of("one") and set(both[own == 2].tolist()) == of("two three") and not (own == 1).any()


def test_the_second_term_of_the_risk_stays_above_zero():
    """Every row of the sample toxic: without the correction the risk of clean rows would fall without end."""
    train = [np.array([1, 2], np.uint64)] * 20
    known, weights, bias = tx._non_negative(train, train, np.array([1, 2], np.uint64), 0.3)
    margin = bias + weights.sum()
    assert np.isfinite(margin) and abs(margin) < 20


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (2, ""), (3, "long " * 60_000)], "doc_id long, text string")
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    assert {(x.score, x.predicted) for x in tx.score(docs, tx.learn(docs, none)).collect()} == {(0.0, 0)}
    assert tx.score(docs.limit(0), tx.Model()).collect() == []
    ones = spark.createDataFrame([(2, 1), (3, 1), (0, 1)], "doc_id long, toxic int")
    assert tx.score(docs, tx.learn(docs, ones)).count() == 5
