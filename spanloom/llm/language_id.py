"""Language identification by prediction by partial matching (operator 1).

Each language has a tree of byte contexts of order 0 to ORDER with the counts of the bytes that followed, learnt once and then frozen. The code length
of a byte is that of the longest context in the tree that has seen it; each longer context in the tree that has not
costs its escape (method C: distinct bytes / (bytes + distinct bytes)), and below order 0 the 256 bytes are uniform. No bytes are excluded
after an escape. A text's language is the one that codes the whole text in the fewest bits, with -log2 of the language's
share of the learnt rows for its name; the score is that language's share of 2^-bits over all languages.

Because the statistics are frozen, the bits of a byte depend on it and the ORDER bytes before it only, so that they are
tabled: scoring finds, for every position of the text, the longest run of bytes that any tree has, and adds up.

Nulls and empties: text that is null or holds no letter gets `und` and score 0. Rows without a text or language are not learnt from. Without any
learnt row every text is `und`. Ties go to the language first in code point order. Repeated rows get the same answer. Texts of any length are
coded in pieces, each with the bytes before it. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow_text import WORK_BYTES, runs_of_rows, small_batches, text_bytes
from .common import small_arrow_batches

#: Longest context, in bytes.
ORDER = 4
#: Rows of each language to learn from, at most, drawn by a hash of doc_id and text.
LEARN_ROWS = 600
#: Bytes of a piece of a long text, and of short texts that are coded at once.
CHUNK, RUN = 1 << 18, 1 << 16
PAD = b" " * ORDER
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _grams(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ORDER + 1 bytes ending at each byte of the segments after their first ORDER, as numbers; starts and lengths of the segments in them."""
    s = np.frombuffer(b"".join(segments), np.uint8).astype(np.uint64)
    n = len(s) - ORDER
    g = np.zeros(max(n, 0), np.uint64)
    for k in range(ORDER + 1):
        g |= s[k : k + len(g)] << np.uint64(8 * (ORDER - k))
    lengths = np.fromiter((len(x) for x in segments), np.int64, len(segments))
    ends = np.cumsum(lengths)
    return g, ends - lengths, lengths - ORDER


def count_tree(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ORDER + 1 bytes in the texts and their counts: the counts of all shorter contexts follow from them."""
    parts: list[np.ndarray] = []
    for x in texts:
        if not x:
            continue
        g, _, n = _grams([PAD + x])
        parts.append(np.stack(np.unique(g[: n[0]].astype(np.int64), return_counts=True)))
        if len(parts) >= 64:
            parts = [_sum(parts)]
    both = _sum(parts)
    return both[0], both[1]


def _sum(parts: list[np.ndarray]) -> np.ndarray:
    if not parts:
        return np.zeros((2, 0), np.int64)
    values, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return np.stack([values, np.bincount(place, np.concatenate([p[1] for p in parts]), len(values)).astype(np.int64)])


class Places:
    """Finds the places of numbers in a set of them: they lie in the order of a hash, with the first of each hash's leading bits marked."""

    def __init__(self, keys: np.ndarray):
        keys = np.unique(keys.astype(np.uint64))
        bits = max(1, int(len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        slot = (keys * _SPREAD) >> self.shift
        order = np.argsort(slot, kind="stable")
        self.keys = keys[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(slot.astype(np.int64), minlength=1 << bits))]).astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places of the wanted, -1 for those that are not there."""
        slot = ((wanted * _SPREAD) >> self.shift).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        found = np.full(len(wanted), -1, np.int32)
        open_ = np.flatnonzero(at < end)
        at, end, left = at[open_], end[open_], wanted[open_]
        while len(open_):
            hit = self.keys[at] == left
            found[open_[hit]] = at[hit]
            at = at + 1
            go = ~hit & (at < end)
            open_, at, end, left = open_[go], at[go], end[go], left[go]
        return found


class Model:
    """Frozen code lengths of all languages."""

    def __init__(self, languages: list[str], prior_bits: np.ndarray, trees: list[tuple[np.ndarray, np.ndarray]]):
        self.languages, self.prior_bits = languages, prior_bits
        self.grams: list[Places] = []  # by order: runs of order + 1 bytes that a tree has
        self.codes: list[np.ndarray] = []  # bits of their last byte, by language
        self.contexts: list[Places] = []
        self.escapes: list[np.ndarray] = []
        n = len(languages)
        for order in range(ORDER + 1):
            size = 1 << (8 * (order + 1))
            short = [t[0] % size for t in trees]
            grams = Places(np.concatenate(short) if short else np.zeros(0, np.int64))
            contexts = Places(grams.keys >> np.uint64(8))
            escape = np.zeros((len(contexts.keys), n))
            seen = []
            for k, (own, (_, counts)) in enumerate(zip(short, trees, strict=True)):
                values, place = np.unique(own, return_inverse=True)
                times = np.bincount(place, counts, len(values))
                heads, at = np.unique(values >> 8, return_inverse=True)
                distinct, total = np.bincount(at, minlength=len(heads)), np.bincount(at, times, len(heads))
                escape[contexts.find(heads.astype(np.uint64)), k] = -np.log2(distinct / (total + distinct))
                seen.append((grams.find(values.astype(np.uint64)), -np.log2(times / (total + distinct)[at])))
            code = self._lower(grams.keys, order - 1) + escape[contexts.find(grams.keys >> np.uint64(8))]
            for k, (places, bits) in enumerate(seen):
                code[places, k] = bits
            self.grams.append(grams)
            self.codes.append(code.astype(np.float32))
            self.contexts.append(contexts)
            self.escapes.append(escape.astype(np.float32))

    def _lower(self, grams: np.ndarray, order: int) -> np.ndarray:
        """Bits of the last bytes of grams, by language, by the contexts of this order and below."""
        out = np.zeros((len(grams), len(self.languages)))
        open_ = np.arange(len(grams))
        for k in range(order, -1, -1):
            own = grams[open_] & np.uint64((1 << (8 * (k + 1))) - 1)
            place = self.grams[k].find(own)
            known = place >= 0
            out[open_[known]] += self.codes[k][place[known]]
            open_, own = open_[~known], own[~known]
            if not len(open_):
                return out
            context = self.contexts[k].find(own >> np.uint64(8))
            met = context >= 0
            out[open_[met]] += self.escapes[k][context[met]]
        out[open_] += 8.0
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each whole text under each language."""
        out = np.zeros((len(texts), len(self.languages)))
        segments, owner = [], []
        for i, x in enumerate(texts):
            for start in range(0, len(x), CHUNK):
                segments.append((x[start - ORDER : start] if start else PAD) + x[start : start + CHUNK])
                owner.append(i)
        sizes = np.cumsum([0] + [len(x) for x in segments])
        for a, b in runs_of_rows(sizes, RUN):
            g, starts, lengths = _grams(segments[a:b])
            total = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(self._lower(g, ORDER), axis=0)])
            np.add.at(out, owner[a:b], total[starts + lengths] - total[starts])
        return out

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: the language's number, its share of 2^-bits, and its bits a byte."""
        bits = self.bits(texts) + self.prior_bits
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(texts)), best]
        share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
        sizes = np.fromiter((len(x) for x in texts), np.float64, len(texts))
        return best, share, (least - self.prior_bits[best]) / np.maximum(sizes, 1)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, learn_rows: int = LEARN_ROWS) -> Model:
    """Learn from text and non-null lang of documents that are not held out: at most learn_rows of each language, drawn
    by a hash of doc_id and text; the languages' shares are counted over all such documents."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    shares = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark, order = docs.sparkSession, F.xxhash64("doc_id", "text")
    # a first draw of about twice the rows by their hashes, so that little is sorted; a language of few rows gives all
    # made of an Arrow table, as rows of a list take Python workers of another kind, which executors keep besides those of the texts
    most = [min(2**63 - 1, int((2 * learn_rows + 100) / n * 2**63)) for n in shares.values()]
    chance = spark.createDataFrame(pa.table({"lang": pa.array(list(shares), pa.string()), "most": pa.array(most, pa.int64())}))
    drawn = labelled.join(F.broadcast(chance), "lang").where(F.shiftrightunsigned(order, 1) <= F.col("most"))
    drawn = drawn.withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy(order, "doc_id")))
    sample = drawn.where(F.col("nth") <= learn_rows)

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        grams, counts = count_tree([x.encode() for x in rows["text"]])
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "grams": [grams.tobytes()], "counts": [counts.tobytes()]})

    rows = sample.select("lang", "text").groupBy("lang").applyInPandas(count, "lang string, grams binary, counts binary").collect()
    rows = sorted(rows, key=lambda r: r["lang"])
    n = sum(shares[r["lang"]] for r in rows)
    trees = [(np.frombuffer(r["grams"], np.int64), np.frombuffer(r["counts"], np.int64)) for r in rows]
    return Model([r["lang"] for r in rows], np.array([-np.log2(shares[r["lang"]] / n) for r in rows]), trees)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs' doc_id with held_out, lang_pred, score and bits_per_byte; only the text is looked at."""
    small_arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), letters.alias("letters"), "text")
    known = bool(model.languages)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, WORK_BYTES):
            raw, offsets = text_bytes(batch.column("text"))
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            data = raw.tobytes()
            texts = [data[a:b] if ok else b"" for a, b, ok in zip(offsets[:-1].tolist(), offsets[1:].tolist(), letters.tolist(), strict=True)]
            if known and texts:
                best, share, rate = shared.value.predict(texts)
                names = np.array([*shared.value.languages, "und"], dtype=object)[np.where(letters, best, len(shared.value.languages))]
                share, rate = np.where(letters, share, 0.0), np.where(letters, rate, 0.0)
            else:
                names, share, rate = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(list(names), pa.string()), pa.array(share), pa.array(rate)], names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, lang_pred string, score double, bits_per_byte double")


def keep_identified(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """docs without those whose language is not told: `und`, or a score under least_score; all their columns stay."""
    small_arrow_batches(docs.sparkSession)
    model = learn(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, WORK_BYTES):
            raw, offsets = text_bytes(batch.column("text"))
            data = raw.tobytes()
            texts = [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            if texts:
                _, share, _ = shared.value.predict(texts)
                yield batch.filter(pa.array(share >= least_score))

    lettered = docs.where(F.col("text").rlike(r"\p{L}"))
    return lettered.mapInArrow(keep, schema) if model.languages else docs.limit(0)
