"""Quality rules: plain counts of each text, and a calibrated logistic regression on hashed n-grams (operator 6).

The counts give a base rule. Texts that pass it are judged by a logistic regression on hashed words, pairs of words and runs of four
bytes, each as its share of the text's words, pairs or runs, trained on a bounded sample of rows with a quality label. A second part of
the sample calibrates its margin to a probability (Platt's method); a text is kept when its probability is THRESHOLD or more. Texts are
counted and scored in Arrow batches, in chunks of about a megabyte; the model is of fixed size.

Words are [^\\x20\\x09-\\x0D]+, told apart by case. Counts compare words, windows and lines by 64-bit hashes.

Nulls: a null text has no words and fails the base rule. Labels with a null quality or doc_id are left out; of a doc_id's
labels the lowest counts. Without labels of both kinds every text that passes the base rule is kept, with probability 1. Repeated rows are judged alike. An
empty table gives an empty result. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import runs_of_rows, text_bytes
from .common import small_arrow_batches
from .shingles import CHUNK, EXACT, mix64, range_hashes, word_spans

LEARN_ROWS = 2000
BITS = 18
RUN = 4
THRESHOLD = 0.5
LEAST_WORDS = 50
#: Every fourth row of the sample calibrates; the others train.
CALIBRATE = 4
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_LINE = np.uint64(0x51ED270B)
_SIDE = np.uint64(0xA24BAED4963EE407)


class Chunk:
    """Some texts as one buffer, each followed by a line feed: words, their hashes, and what the counts and the model need."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        self.raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lengths = np.fromiter((len(x) + 1 for x in texts), np.int64, self.n)
        self.edges = np.concatenate([[0], np.cumsum(lengths)])
        self.starts, self.ends = word_spans(self.raw)
        self.words = range_hashes(self.raw, self.starts, self.ends, EXACT)
        self.word_edges = np.searchsorted(self.starts, self.edges)
        self.n_words = np.diff(self.word_edges)
        self.word_owner = np.repeat(np.arange(self.n), self.n_words)

    def _sum(self, flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[edges[1:]] - total[edges[:-1]]

    def counts(self) -> dict[str, np.ndarray]:
        points = np.concatenate([[0], np.cumsum((self.raw & 0xC0) != 0x80)])
        word_points = points[self.ends] - points[self.starts]
        return {
            "n_words": self.n_words,
            "word_chars": self._sum(word_points, self.word_edges),
            "n_symbols": self._sum(_SYMBOL[self.raw], self.edges),
            "n_dup_lines": self._dup_lines(),
            "n_repeat_words": self._sum(self._repeated(), self.word_edges),
        }

    def _own(self, hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Hashes made different for each text."""
        return mix64(hashes + owner.astype(np.uint64) * _SIDE)

    def _dup_lines(self) -> np.ndarray:
        ends = np.flatnonzero(self.raw == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        worded = np.searchsorted(self.starts, ends) > np.searchsorted(self.starts, starts)
        starts, ends = starts[worded], ends[worded]
        owner = np.searchsorted(self.edges, starts, side="right") - 1
        lines = self._own(range_hashes(self.raw, starts, ends, EXACT) + (ends - starts).astype(np.uint64) * _LINE, owner)
        _, first = np.unique(lines, return_index=True)
        return np.bincount(owner, minlength=self.n) - np.bincount(owner[first], minlength=self.n)

    def _repeated(self) -> np.ndarray:
        """Of each word, whether it lies in a window of three words that its text has twice or more."""
        n = len(self.words)
        out = np.zeros(n + 2, bool)
        if n >= 3:
            w = self.words
            windows = mix64(w[:-2] + mix64(w[1:-1] + mix64(w[2:])))
            inside = np.flatnonzero(self.word_owner[:-2] == self.word_owner[2:])
            own = self._own(windows[inside], self.word_owner[inside])
            _, place, times = np.unique(own, return_inverse=True, return_counts=True)
            twice = inside[times[place] > 1]
            for k in range(3):
                out[twice + k] = True
        return out[:n]

    def word_places(self) -> np.ndarray:
        return (self.words >> np.uint64(64 - BITS)).astype(np.int64)

    def pair_places(self) -> np.ndarray:
        """Places of the pairs of words that begin at each word; that of the last word of a text goes beyond it and is not used."""
        return (mix64(self.words + mix64(np.append(self.words[1:], np.zeros(min(1, len(self.words)), np.uint64)))) >> np.uint64(64 - BITS)).astype(np.int64)

    def run_places(self) -> np.ndarray:
        """Places of the runs of RUN bytes that begin at each byte; the last RUN - 1 of the buffer wrap to nothing."""
        padded = np.concatenate([self.raw, np.zeros(RUN - 1, np.uint8)]).astype(np.uint32)
        packed = padded[: len(self.raw)].copy()
        for k in range(1, RUN):
            packed |= padded[k : k + len(self.raw)] << np.uint32(8 * k)
        return ((packed * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)


def _chunks(column: pa.Array) -> Iterator[Chunk]:
    raw, offsets = text_bytes(column)
    data, at = raw.tobytes(), offsets.tolist()
    for a, b in runs_of_rows(offsets, CHUNK):
        yield Chunk([data[at[k] : at[k + 1]] for k in range(a, b)])


class Model:
    """Weights of words, runs and pairs of words, and the line that makes the margin a probability."""

    def __init__(self) -> None:
        self.words, self.runs, self.pairs = (np.zeros(1 << BITS, np.float32) for _ in range(3))
        self.bias, self.slope, self.shift, self.trained = 0.0, 1.0, 0.0, False

    def margins(self, chunk: Chunk) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.words[chunk.word_places()], dtype=np.float64)])
        by_words = (total[chunk.word_edges[1:]] - total[chunk.word_edges[:-1]]) / np.maximum(chunk.n_words, 1)
        total = np.concatenate([[0.0], np.cumsum(self.runs[chunk.run_places()], dtype=np.float64)])
        begins, ends = chunk.edges[:-1], np.maximum(chunk.edges[1:] - RUN, chunk.edges[:-1])
        pair_total = np.concatenate([[0.0], np.cumsum(self.pairs[chunk.pair_places()], dtype=np.float64)])
        first, last = chunk.word_edges[:-1], np.maximum(chunk.word_edges[1:] - 1, chunk.word_edges[:-1])
        return by_words + (pair_total[last] - pair_total[first]) / np.maximum(last - first, 1) + (total[ends] - total[begins]) / np.maximum(ends - begins, 1) + self.bias

    def probabilities(self, chunk: Chunk) -> np.ndarray:
        if not self.trained:
            return np.ones(chunk.n)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(chunk) + self.shift, -500, 500)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each sampled text its places (words, then runs, then pairs of words) and their shares."""
    for batch in batches:
        places, shares = [], []
        for chunk in _chunks(batch.column("text")):
            words, runs, pairs = chunk.word_places(), chunk.run_places(), chunk.pair_places()
            for k in range(chunk.n):
                own = words[chunk.word_edges[k] : chunk.word_edges[k + 1]]
                other = runs[chunk.edges[k] : max(chunk.edges[k + 1] - RUN, chunk.edges[k])]
                two = pairs[chunk.word_edges[k] : max(chunk.word_edges[k + 1] - 1, chunk.word_edges[k])]
                kinds = [(np.unique(x, return_counts=True), max(len(x), 1)) for x in (own, other, two)]
                places.append(np.concatenate([place + (j << BITS) for j, ((place, _), _) in enumerate(kinds)]).astype(np.int32).tobytes())
                shares.append(np.concatenate([times / n for (_, times), n in kinds]).astype(np.float32).tobytes())
        yield pa.record_batch([batch.column("order"), batch.column("quality"), pa.array(places, pa.binary()), pa.array(shares, pa.binary())], names=["order", "quality", "places", "shares"])


def learn(docs: DataFrame, labels: DataFrame, learn_rows: int = LEARN_ROWS, steps: int = 60) -> Model:
    """Train on at most learn_rows labelled rows, drawn by a hash of doc_id."""
    drawn = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    drawn = drawn.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(learn_rows)
    sample = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select(F.col("order").cast("long"), F.col("quality").cast("int").alias("quality"), "text")
    sample = sample.orderBy("order", F.xxhash64("text")).limit(learn_rows)  # doc_ids may be repeated
    rows = sorted(sample.mapInArrow(_features, "order long, quality int, places binary, shares binary").collect(), key=lambda r: (r["order"], r["places"]))
    model = Model()
    y = np.array([float(r["quality"] > 0) for r in rows])
    if len(set(y.tolist())) < 2:
        return model
    places = [np.frombuffer(r["places"], np.int32).astype(np.int64) for r in rows]
    shares = [np.frombuffer(r["shares"], np.float32) for r in rows]
    trains = np.arange(len(rows)) % CALIBRATE > 0
    if len(set(y[trains].tolist())) < 2 or len(set(y[~trains].tolist())) < 2:
        trains[:] = True
    weights, bias = _logistic(places, shares, y, trains, steps)
    margins = np.array([float(weights[p] @ s) for p, s in zip(places, shares, strict=True)]) + bias
    held = ~trains if (~trains).any() else trains
    model.words, model.runs, model.pairs = (x.astype(np.float32) for x in np.split(weights, 3))
    model.bias, model.trained = bias, True
    model.slope, model.shift = _platt(margins[held], y[held])
    return model


def _logistic(places: list[np.ndarray], shares: list[np.ndarray], y: np.ndarray, trains: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias by full gradient steps with a step size for each weight (Adagrad); both classes weigh alike."""
    rows = np.flatnonzero(trains)
    owner = np.repeat(np.arange(len(rows)), [len(places[k]) for k in rows])
    place, share = np.concatenate([places[k] for k in rows]), np.concatenate([shares[k] for k in rows]).astype(np.float64)
    y = y[rows]
    balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(rows)
    weights, seen, bias, seen_bias = np.zeros(3 << BITS), np.full(3 << BITS, 1e-12), 0.0, 1e-12
    for _ in range(steps):
        margin = np.bincount(owner, weights[place] * share, len(rows)) + bias
        off = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - y) * balance
        slope = np.bincount(place, share * off[owner], 3 << BITS) + 1e-7 * weights
        seen += slope * slope
        weights -= slope / np.sqrt(seen)
        seen_bias += off.sum() ** 2
        bias -= 0.1 * off.sum() / np.sqrt(seen_bias)
    return weights, float(bias)


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the margin's log odds, by Newton steps against softened labels."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(float(np.abs(margin).mean()), 1e-9)
    x = np.stack([margin / scale, np.ones(len(margin))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (p - t) + 1e-3 * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def judge(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Each row of docs: doc_id, the counts, base_failed, kept and probability."""
    small_arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(chunk.counts(), shared.value.probabilities(chunk)) for chunk in _chunks(batch.column("text"))]
            if not parts:
                continue
            counts = {k: np.concatenate([c[k] for c, _ in parts]).astype(np.int64) for k in parts[0][0]}
            p = np.concatenate([x for _, x in parts])
            failed = (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(x) for x in counts.values()), pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)], names=["doc_id", *counts, "base_failed", "kept", "probability"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double")
