"""Toxicity: a linear classifier trained from confirmed toxic rows and unlabelled text by non-negative positive-unlabelled learning (operator 12).

Features say which words and which runs of RUN bytes inside or at the edge of words a text has, with A-Z lower-cased and all else that is
neither letter nor digit taken as a gap; how often does not count, so a long text is not toxic by its length. Each is a 64-bit hash.

Training takes at most POSITIVES confirmed toxic rows and UNLABELLED rows of any kind, drawn by a hash of doc_id among texts of at most
LEARN_TEXT bytes; this bounded sample, some tens of MB of hashes, is all that the driver sees. The class prior is the share of toxic rows among
all labels that may be learnt from. Features that
SEEN confirmed rows or more have and that are more frequent there than chance allows (SCREEN standard deviations) are weighed by
proximal gradient steps on the corrected risk of Kiryo et al. (2017) with logistic loss,

    prior * mean_P l(g) + max(0, mean_U l(-g) - prior * mean_P l(-g)),

whose second term, when it falls below zero, is stepped back instead; an l1 penalty keeps few features. Weights are not negative: a toxic word is
not made good by what stands around it, such as a line that many clean texts share. Labels of 0 are not used for
weights; a line that makes the margin a probability is fitted on labelled rows of both kinds that took no part in training (Platt).

All texts are scored whole, in Arrow batches, in chunks of about half a megabyte, by the few features that have a weight.

Nulls: a null text is scored as an empty one, by the bias alone. Labels with a null toxic or doc_id are left out; of a doc_id's labels the highest counts.
Without confirmed rows nothing is known and every score is 0. Repeated rows are scored alike. An empty table gives an empty result. Extra columns
play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import runs_of_rows, text_bytes
from .common import small_arrow_batches
from .quality import _platt
from .shingles import CHUNK, EXACT, mix64, range_hashes

POSITIVES, UNLABELLED, CHECKED = 1500, 4500, 1500
LEARN_TEXT = 1 << 15
RUN = 5
SEEN, SCREEN = 3, 4.0
THRESHOLD = 0.7
#: A-Z as a-z, letters and digits and all bytes beyond ASCII as they are, all else a space.
_FOLD = np.array([x + 32 if 65 <= x <= 90 else x if x >= 128 or 97 <= x <= 122 or 48 <= x <= 57 else 32 for x in range(256)], np.uint8)
_RUN_KIND = np.uint64(0xD6E8FEB86659FD93)
_SIEVE = 20


def held_out(doc_id: Column) -> Column:
    """Whether a row's label may not be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All features of some texts, as hashes with repeats, and the text each belongs to."""
    raw = _FOLD[np.frombuffer(b" " + b"  ".join(texts) + b" " * RUN, np.uint8)]
    edges = np.cumsum([1] + [len(x) + 2 for x in texts])
    inside = raw != 32
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = change[::2], change[1::2]
    words = range_hashes(raw, starts, ends, EXACT)
    # A run of bytes may begin one before a word; none has a gap within.
    gaps = np.concatenate([[0], np.cumsum(~inside)])
    at = np.arange(len(raw) - RUN)
    at = at[(gaps[at + RUN] - gaps[at + 1] == 0) & inside[at + 1]]
    packed = np.zeros(len(at), np.uint64)
    for k in range(RUN):
        packed = (packed << np.uint64(8)) | raw[at + k].astype(np.uint64)
    own = np.concatenate([np.searchsorted(edges, starts, side="right"), np.searchsorted(edges, at + 1, side="right")]) - 1
    return np.concatenate([words, mix64(packed ^ _RUN_KIND)]), own


class Model:
    """Sorted hashes of the features that have a weight, their weights, and the line that makes the margin a probability."""

    def __init__(self) -> None:
        self.known, self.weights, self.sieve = np.zeros(0, np.uint64), np.zeros(0), np.zeros(1 << _SIEVE, bool)
        self.bias, self.slope, self.shift, self.trained, self.prior = 0.0, 1.0, 0.0, False, 0.0

    def margins(self, texts: list[bytes]) -> np.ndarray:
        found, own = features(texts)
        maybe = np.flatnonzero(self.sieve[(found >> np.uint64(64 - _SIEVE)).astype(np.int64)])
        found, own = found[maybe], own[maybe]
        at = np.minimum(np.searchsorted(self.known, found), max(len(self.known) - 1, 0))
        hit = self.known[at] == found if len(self.known) else np.zeros(len(found), bool)
        one = np.unique(own[hit] * max(len(self.known), 1) + at[hit])
        text, at = np.divmod(one, max(len(self.known), 1))
        return self.bias + np.bincount(text, self.weights[at] if len(at) else None, len(texts)).astype(np.float64)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -500, 500)))


def _chunks(column: pa.Array) -> Iterator[list[bytes]]:
    raw, offsets = text_bytes(column)
    data, at = raw.tobytes(), offsets.tolist()
    for a, b in runs_of_rows(offsets, CHUNK):
        yield [data[at[k] : at[k + 1]] for k in range(a, b)]


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row of the sample its distinct features."""
    for batch in batches:
        out = []
        for texts in _chunks(batch.column("text")):
            found, own = features(texts)
            out.extend(np.unique(found[own == k]).tobytes() for k in range(len(texts)))
        yield pa.record_batch([batch.column("kind"), batch.column("spread"), pa.array(out, pa.binary())], names=["kind", "spread", "features"])


def learn(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, checked: int = CHECKED) -> Model:
    """Train on confirmed rows of labels (doc_id, toxic > 0) that are not held out, and on unlabelled rows of docs."""
    model = Model()
    told = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    counts = told.agg(F.count(F.lit(1)).alias("rows"), F.count_if("toxic").alias("toxic")).first()
    if not counts["toxic"]:
        return model
    model.prior = min(max(counts["toxic"] / counts["rows"], 1e-4), 0.5) if counts["toxic"] < counts["rows"] else 0.1
    short = docs.where(F.octet_length(F.coalesce("text", F.lit(""))) <= LEARN_TEXT).select(F.col("doc_id"), "text", F.xxhash64("doc_id", F.lit(12)).alias("spread"))
    # Confirmed rows train; some more, and as many shares of labels of 0, check.
    spread = told.withColumn("spread", F.xxhash64("doc_id", F.lit(12)))
    drawn = spread.where("toxic").orderBy("spread", "doc_id").limit(positives + checked // 4)
    zeros = spread.where("NOT toxic").orderBy("spread", "doc_id").limit(checked)
    picked = drawn.unionByName(zeros).select("doc_id", "toxic")
    known = short.join(F.broadcast(picked), "doc_id").select(F.col("toxic").cast("int").alias("kind"), "spread", "text").orderBy("spread", F.xxhash64("text")).limit(2 * (positives + 2 * checked))
    # Of many rows only those with the lowest hashes, about twice as many as are wanted, are put in order.
    share = min(1.0, 2 * unlabelled / max(docs.count(), 1))
    low = F.col("spread") <= int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else F.lit(True)
    other = short.where(low).select(F.lit(2).alias("kind"), "spread", "text").orderBy("spread", F.xxhash64("text")).limit(unlabelled)
    rows = known.unionByName(other).mapInArrow(_sampled, "kind int, spread long, features binary").collect()
    rows.sort(key=lambda r: (r["spread"], r["features"]))
    of_kind = {k: [np.frombuffer(r["features"], np.uint64) for r in rows if r["kind"] == k] for k in (0, 1, 2)}
    toxic = of_kind[1]
    n_check = min(len(toxic) // 4, checked // 4) if of_kind[0] else 0
    check, train = toxic[:n_check], toxic[n_check:]
    if not train or not of_kind[2]:
        return model
    screened = _screen(train, of_kind[2])
    model.known, model.weights, model.bias = _non_negative(train, of_kind[2], screened, model.prior)
    model.sieve[(model.known >> np.uint64(64 - _SIEVE)).astype(np.int64)] = True
    model.trained = True
    if check:
        x = np.concatenate([_margins(check, model), _margins(of_kind[0], model)])
        y = np.concatenate([np.ones(len(check)), np.zeros(len(of_kind[0]))])
        model.slope, model.shift = _platt(x, y)
    return model


def _screen(train: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Sorted features of SEEN confirmed rows or more, whose share of confirmed rows exceeds that of unlabelled ones by more than chance."""
    seen, times = np.unique(np.concatenate(train), return_counts=True)
    seen, times = seen[times >= SEEN], times[times >= SEEN]
    if not len(seen):
        return seen
    counts = np.zeros(len(seen))
    for row in other:
        at = np.minimum(np.searchsorted(seen, row), len(seen) - 1)
        counts[at[seen[at] == row]] += 1
    p, u = times / len(train), counts / len(other)
    both = (times + counts) / (len(train) + len(other))
    off = (p - u) / np.sqrt(both * (1 - both) * (1 / len(train) + 1 / len(other)) + 1e-12)
    return seen[off > SCREEN]


def _rows(rows: list[np.ndarray], known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of all features of rows that are known."""
    own, place = [], []
    for k, row in enumerate(rows):
        at = np.minimum(np.searchsorted(known, row), len(known) - 1)
        at = at[known[at] == row]
        own.append(np.full(len(at), k))
        place.append(at)
    return np.concatenate(own), np.concatenate(place)


def _non_negative(train: list[np.ndarray], other: list[np.ndarray], known: np.ndarray, prior: float, steps: int = 300, penalty: float = 5e-5) -> tuple[np.ndarray, np.ndarray, float]:
    """Features that keep a weight, the weights and the bias, by proximal steps (Adagrad) on the non-negative risk."""
    n_p, n_u = len(train), len(other)
    bias, seen_bias = float(np.log(prior / (1 - prior))), 1e-12
    if not len(known):
        return known, np.zeros(0), bias
    (own_p, at_p), (own_u, at_u) = _rows(train, known), _rows(other, known)
    w, seen = np.zeros(len(known)), np.full(len(known), 1e-12)
    for _ in range(steps):
        g_p, g_u = np.bincount(own_p, w[at_p], n_p) + bias, np.bincount(own_u, w[at_u], n_u) + bias
        s_p, s_u = 1 / (1 + np.exp(-np.clip(g_p, -500, 500))), 1 / (1 + np.exp(-np.clip(g_u, -500, 500)))
        negative = np.logaddexp(0, g_u).mean() - prior * np.logaddexp(0, g_p).mean()
        if negative >= 0:
            d_p, d_u = prior * (s_p - 1) / n_p - prior * s_p / n_p, s_u / n_u
        else:  # too good to be true: step back
            d_p, d_u = prior * s_p / n_p, -s_u / n_u
        slope = np.bincount(at_p, d_p[own_p], len(known)) + np.bincount(at_u, d_u[own_u], len(known))
        seen += slope * slope
        rate = 0.5 / np.sqrt(seen)
        w -= rate * slope
        w = np.maximum(w - rate * penalty, 0)
        of_bias = d_p.sum() + d_u.sum()
        seen_bias += of_bias**2
        bias -= 0.1 * of_bias / np.sqrt(seen_bias)
    has = w > 1e-6
    return known[has], w[has], float(bias)


def _margins(rows: list[np.ndarray], model: Model) -> np.ndarray:
    if not len(model.known):
        return np.full(len(rows), model.bias)
    own, at = _rows(rows, model.known)
    return np.bincount(own, model.weights[at], len(rows)) + model.bias


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Each row of docs: doc_id, held_out, score and predicted."""
    small_arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.scores(texts) for texts in _chunks(batch.column("text"))]
            p = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(work, f"doc_id {kind}, held_out boolean, score double, predicted int")
