"""Ranked lexical search: variable-block-max WAND over shards of documents (operator 13).

Every row's terms are counted in Arrow batches; of them the postings of terms that some item asks for are written, a row a document, and
the corpus's figures (documents, words, frequency of each term) are counted over all of them. Documents are dealt to shards of about
SHARD_POSTINGS postings by a hash of the row, and one task indexes and searches a shard:

* each posting list is cut into blocks by dynamic programming: of all cuts into blocks of at most LONGEST postings the one with the least
  sum of bound errors (a block's highest score less the term's own one, over all documents from its first to its last) plus a fixed price
  a block, exactly so within stretches of LANE postings of a list;
* the borders of the blocks of an item's terms part the documents into windows, and the sum of the highest scores of the blocks over a
  window bounds every score in it. Windows are taken by falling bound, some hundred documents at a time, and scored exactly; when the
  bound falls below the score of the last of the best, all other windows are skipped, unread. No document is lost by that.

The best of all shards are merged in two rounds of partial top-k. Items are searched in blocks of about ITEM_BYTES of text, which
are broadcast; the documents are read once a block.

Terms are the maximal runs of letters and digits of ASCII and of all characters beyond it, with A-Z lower-cased. Weights and scores follow
`search`; all but the logarithm is done in 64-bit integers.

Nulls: a null text has no terms; such rows count nowhere and are never found. A null doc_id can be found, comes after all others among
equal scores, and is given back as null. Items without terms find nothing; items with equal or null item_id are items of their own.
Repeated rows are documents of their own; ties go by doc_id, then by a hash of the row. Empty tables give an empty result. Extra columns
play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField

from .arrow_text import small_batches, text_bytes
from .common import small_arrow_batches, stored
from .shingles import mix64

BEST = 50
ITEM_BYTES = 8 << 20
SHARD_POSTINGS = 1 << 20
#: Postings of a block at most, and of a stretch that is cut as a whole.
LONGEST, LANE = 64, 1024
#: What a block costs, in documents that are off their bound by the mean score of their list.
PRICE = 8
#: Documents under the windows that are scored first; each further round takes twice as many.
FIRST_ROUND = 256
_TABLE = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 97 <= x <= 122 or 48 <= x <= 57 else 32 for x in range(256))


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts (null: none), one after the other, and the offsets of the texts in them."""
    raw, offsets = text_bytes(texts)
    folded = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(raw.tobytes().translate(_TABLE)))
    lists = pc.ascii_split_whitespace(folded)
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[full], minlength=len(counts))
    return flat.filter(pa.array(full)), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


@dataclass
class Items:
    """A block of items: their ids, and the numbers of their terms in the vocabulary."""

    ids: list
    terms: list[np.ndarray]
    vocabulary: pa.Array


def _items(rows: list) -> Items:
    flat, offsets = terms_of(pa.array([r["text"] for r in rows], pa.string()))
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, np.int64)
    return Items([r["item_id"] for r in rows], [np.unique(codes[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], coded.dictionary)


def postings(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """Of each row of docs that has a term: doc_id, a hash that spreads rows, its number of terms, and the terms of the vocabulary it holds with their counts."""
    small_arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.to_pylist())
    kind = dict(docs.dtypes)["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.large_string())
        for batch in small_batches(batches):
            flat, offsets = terms_of(batch.column("text"))
            n = np.diff(offsets)
            codes = pc.fill_null(pc.index_in(flat, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(n)), n)
            key = owner[codes >= 0] * max(len(known), 1) + codes[codes >= 0]
            key, tf = np.unique(key, return_counts=True)
            text, term = np.divmod(key, max(len(known), 1))
            at = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(n)))]).astype(np.int32)
            has = pa.array(n > 0)
            out = [
                batch.column("doc_id"),
                batch.column("spread"),
                pa.array(n),
                pa.ListArray.from_arrays(pa.array(at), pa.array(term.astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(at), pa.array(tf.astype(np.int64))),
            ]
            yield pa.record_batch(out, names=["doc_id", "spread", "n", "terms", "tfs"]).filter(has)

    rows = docs.select("doc_id", F.xxhash64("doc_id", "text", F.monotonically_increasing_id()).alias("spread"), "text")
    return rows.mapInArrow(work, f"doc_id {kind}, spread long, n long, terms array<int>, tfs array<long>")


def cut_blocks(docs: np.ndarray, scores: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """First postings of the blocks that the dynamic programme chooses for posting lists with the given offsets; documents rise in each."""
    sizes = np.diff(lists)
    lanes_of = -(-sizes // LANE)
    which = np.repeat(np.arange(len(sizes)), lanes_of)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(lanes_of) - lanes_of, lanes_of)
    base = lists[which] + nth * LANE
    length = np.minimum(sizes[which] - nth * LANE, LANE)
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    price = (PRICE * (total[lists[1:]] - total[lists[:-1]]) / np.maximum(sizes, 1))[which] + 1
    by_length = np.argsort(-length, kind="stable")
    base, length, price = base[by_length], length[by_length], price[by_length]
    if not len(base):
        return np.zeros(0, np.int64)
    choice = np.zeros(len(scores), np.int32)
    # A column a start of the last block: its highest score, and the cost up to it. The sum of own scores is the same for all cuts.
    highest = np.zeros((len(base), LONGEST))
    before = np.full((len(base), LONGEST), np.inf)
    from_doc = np.zeros((len(base), LONGEST))
    begin = np.zeros(LONGEST, np.int64)
    cost = np.zeros(len(base))
    for j in range(int(length[0])):
        active = int(np.searchsorted(-length, -j, side="left"))
        c = j % LONGEST
        begin[c] = j
        highest[:active, c] = 0
        before[:active, c] = cost[:active]
        from_doc[:active, c] = here = docs[base[:active] + j]
        np.maximum(highest[:active], scores[base[:active] + j][:, None], out=highest[:active])
        all_costs = highest[:active] * (here[:, None] - from_doc[:active] + 1) + before[:active]
        at = all_costs.argmin(axis=1)
        cost[:active] = all_costs[np.arange(active), at] + price[:active]
        choice[base[:active] + j] = begin[at]
    first = np.zeros(len(scores), bool)
    end = length.copy()
    while len(base):
        start = choice[base + end - 1]
        first[base + start] = True
        left = start > 0
        base, end = base[left], start[left].astype(np.int64)
    return np.flatnonzero(first)


class Shard:
    """The index of some documents. Documents are numbered by doc_id; postings lie by term and document."""

    def __init__(self, n_docs: int, doc: np.ndarray, term: np.ndarray, score: np.ndarray, n_terms: int):
        order = np.lexsort((doc, term))
        self.doc, self.score, self.n_docs = doc[order], score[order], n_docs
        self.key = term[order].astype(np.int64) * n_docs + self.doc
        self.lists = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.first = cut_blocks(self.doc, self.score, self.lists)
        self.after = np.append(self.first[1:], len(self.doc))
        self.high = np.maximum.reduceat(self.score, self.first) if len(self.first) else self.first
        self.blocks = np.searchsorted(self.first, self.lists)
        self.scored = 0

    def best(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents for the terms and their scores, highest first, equal ones by number."""
        blocks = np.concatenate([np.arange(self.blocks[t], self.blocks[t + 1]) for t in terms]) if len(terms) else terms
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(blocks):
            return found, scores
        starts, ends = self.doc[self.first[blocks]], self.doc[self.after[blocks] - 1] + 1
        borders, place = np.unique(np.concatenate([starts, ends]), return_inverse=True)
        change = np.zeros(len(borders), np.int64)
        np.add.at(change, place, np.concatenate([self.high[blocks], -self.high[blocks]]))
        bound = np.cumsum(change)[:-1]
        low, high = borders[:-1], borders[1:]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        covered = np.cumsum((high - low)[order])
        at, aim, least = 0, FIRST_ROUND, 1
        while at < len(order) and bound[order[at]] >= least:
            to = min(int(np.searchsorted(covered, (covered[at - 1] if at else 0) + aim)) + 1, int(np.searchsorted(-bound[order], -least, side="right")))
            part = np.sort(order[at:to])
            docs, own = self._score(terms, low[part], high[part])
            found, scores = np.concatenate([found, docs]), np.concatenate([scores, own])
            top = np.lexsort((found, -scores))[:k]
            found, scores = found[top], scores[top]
            if len(found) == k:
                least = max(1, int(scores[-1]))
            at, aim = to, 2 * aim
        return found, scores

    def _score(self, terms: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact scores above 0 of all documents in windows."""
        shift = terms.astype(np.int64)[:, None] * self.n_docs
        a = np.searchsorted(self.key, (shift + low).ravel())
        n = np.searchsorted(self.key, (shift + high).ravel()) - a
        a, n = a[n > 0], n[n > 0]
        if not len(a):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(int(n.sum())) + np.repeat(a - (np.cumsum(n) - n), n)
        self.scored += len(at)
        docs, scores = self.doc[at], self.score[at]
        order = np.argsort(docs, kind="stable")
        docs, scores = docs[order], scores[order]
        new = np.ones(len(docs), bool)
        new[1:] = docs[1:] != docs[:-1]
        sums = np.add.reduceat(scores, np.flatnonzero(new))
        docs = docs[new].astype(np.int64)
        return docs[sums > 0], sums[sums > 0]


def weight(n_docs: int, df: int) -> int:
    """What a term that df of n_docs documents hold weighs."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def gains(weights: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """What a term that occurs tf times adds to the score of a document of n terms."""
    m = 100 - 50 + (50 * n * n_docs) // n_words
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def _search_block(docs: DataFrame, items: Items, best: int, shard_postings: int, item_field: StructField) -> DataFrame:
    spark = docs.sparkSession
    table = stored(postings(docs, items.vocabulary), "postings")
    sums = table.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("words"), F.sum(F.size("terms")).alias("postings")).first()
    frequency = {r["term"]: r["df"] for r in table.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    n_docs, n_words, n_terms = sums["docs"], sums["words"] or 1, len(items.vocabulary)
    weights = np.array([weight(n_docs, frequency.get(t, 0)) for t in range(n_terms)], np.int64)
    n_shards = max(1, -(-(sums["postings"] or 0) // shard_postings))
    id_type = to_arrow_type(item_field.dataType)
    shared = spark.sparkContext.broadcast((items.ids, items.terms, weights))
    kind = dict(docs.dtypes)["doc_id"]

    def work(rows: pa.Table) -> pa.Table:
        ids, wanted, w = shared.value
        order = pc.sort_indices(rows.select(["doc_id", "spread"]), sort_keys=[("doc_id", "ascending"), ("spread", "ascending")], null_placement="at_end")
        rows = rows.take(order).combine_chunks()
        terms, tfs = (rows.column(c).combine_chunks() for c in ("terms", "tfs"))
        counts = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
        term, tf = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (terms, tfs))
        doc = np.repeat(np.arange(len(counts)), counts)
        score = gains(w[term], tf, rows.column("n").to_numpy()[doc], n_docs, n_words)
        shard = Shard(rows.num_rows, doc, term, score, len(w))
        out_item, out_doc, out_score = [], [], []
        for k, own in enumerate(wanted):
            found, scores = shard.best(own, best)
            out_item.append(np.full(len(found), k))
            out_doc.append(found)
            out_score.append(scores)
        item, at = np.concatenate(out_item), pa.array(np.concatenate(out_doc))
        return pa.table([pa.array(item), pa.array(ids, id_type).take(pa.array(item)), rows.column("doc_id").take(at), rows.column("spread").take(at), pa.array(np.concatenate(out_score))], names=["item", "item_id", "doc_id", "spread", "score"])

    shards = table.where(F.size("terms") > 0).withColumn("shard", F.pmod("spread", F.lit(n_shards)))
    columns = f"item long, item_id {item_field.dataType.simpleString()}, doc_id {kind}, spread long, score long"
    return shards.groupBy("shard").applyInArrow(lambda key, rows: work(rows), columns)


def search(docs: DataFrame, items: DataFrame, best: int = BEST, item_bytes: int = ITEM_BYTES, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """The `best` rows of docs (doc_id, text) for each row of items (item_id, text), as item_id, rank, doc_id, score.

    A document of n terms scores for each term of the item, once, w * ((10^9 tf) div (1000 tf + 20 m)): w is floor(1000 ln((2N + 2) / (2df + 1))),
    m is 50 + (50 n N) div L, N and L are the number of documents with a term and of all their terms."""
    spark = docs.sparkSession
    held = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    size = held.agg(F.sum(F.octet_length("text") + 16).alias("bytes")).first()["bytes"] or 0
    n_blocks = max(1, -(-size // item_bytes))
    found = None
    for block in range(n_blocks):
        rows = held.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).collect()
        if not rows:
            continue
        part = _search_block(docs, _items(rows), best, shard_postings, items.schema["item_id"]).withColumn("block", F.lit(block))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"item_id {dict(items.dtypes)['item_id']}, rank int, doc_id {dict(docs.dtypes)['doc_id']}, score long")
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("spread"))
    few = W.partitionBy("block", "item", F.pmod("spread", F.lit(64))).orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(few)).where(F.col("rank") <= best)
    whole = W.partitionBy("block", "item").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")


def search_sql(best: int = BEST) -> str:
    """DuckDB SQL for `search` on documents and benchmark, where item_id is unique."""
    folded = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {folded} AS terms FROM documents),
s AS (SELECT count(*) AS nn, CAST(sum(len(terms)) AS BIGINT) AS l FROM d WHERE len(terms) > 0),
i AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({folded}) AS term FROM benchmark)),
p AS (
  SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY k, term
),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
m AS (SELECT k, doc_id, 50 + (50 * len(terms) * nn) // l AS m FROM d, s WHERE len(terms) > 0),
r AS (
  SELECT item_id, k, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM i JOIN p USING (term) JOIN w USING (term) JOIN m USING (k) GROUP BY item_id, k, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= {best}
"""
