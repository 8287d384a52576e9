"""Jaccard join on word shingles by token-combination prefixes (operator 2).

1. One pass makes each text's set of hashed shingles and gives its size, a 128-bit digest and the shingles frequent in a
   part of the input. Texts with equal sets are one class; only its smallest document goes on. Shingles frequent over all batches form
   the class "frequent", held as a bitmap of fixed size: a rare shingle may be taken for frequent, which costs work but no link.
2. All sets are ordered alike, rare shingles before frequent ones and each by hash. A set of n may lose n // 4 shingles to a
   partner, so its prefix is extended until that many losses leave a common signature: each rare shingle is a signature
   alone; frequent ones are dealt to subclasses, in which any two make a signature, so that a subclass of x survives x - 2 losses. The
   number of subclasses depends on the set's size; partners' sizes are within 3 : 4, so each set is indexed at its own
   level of size and the next.
3. Documents with a common signature are candidates; see similar_groups for how they are verified. Sketches of the sets rule out most pairs that cannot link before a text moves.

Hash collisions (64 bits a shingle within a pair, 128 a class) are the only inexactness.

Nulls: a null or wordless text has an empty set and links with nothing. Rows with a repeated or null doc_id are told apart by
position; each is a document. Ties: the component is named by its smallest doc_id. Empty tables give empty results. Extra columns play no part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import WORK_BYTES, small_batches, text_bytes
from .common import bitmap, in_bitmap, is_small, keyed, scratch_scope, small_arrow_batches, stored
from .shingles import mix64, parities, sets_of
from .similar_groups import PERCENT, members_of, similar_components

#: A shingle is frequent if parts of about SEEN shingles that have it at least LOCAL times have it FREQUENT times in all.
LOCAL, FREQUENT = 4, 32
SEEN = 4 << 20
CELL_BITS = 24


def _levels() -> np.ndarray:
    """Least sizes of the levels: sets whose sizes are within 3 : 4 are on the same level or on neighbours."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, 4 * (edges[-1] - 1) // 3 + 1))
    return np.array(edges)


LEVELS = _levels()


def subclasses(level: int) -> int:
    return max(1, int(LEVELS[level]) // 8)


def combinations(frequent: np.ndarray, need: int, level: int) -> np.ndarray:
    """Signatures of the frequent shingles (sorted) of a set whose rare ones leave `need` losses to survive."""
    classes = (mix64(frequent) % np.uint64(subclasses(level))).astype(np.int64)
    order = np.argsort(classes, kind="stable")
    again = np.zeros(len(frequent), np.int64)
    again[order[1:]] = classes[order[1:]] == classes[order[:-1]]
    end = int(np.searchsorted(np.cumsum(again), need)) + 1
    order = order[order < end]
    out, sorted_classes = [], classes[order]
    for step in range(1, len(order)):
        same = sorted_classes[step:] == sorted_classes[:-step]
        if not same.any():
            break
        a, b = frequent[order[:-step][same]], frequent[order[step:][same]]
        out.append(mix64(a * np.uint64(3) + mix64(b + np.uint64(level))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def signatures(values: np.ndarray, offsets: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of sets, the row of each, and the size of its set.

    Linked sets have signatures in common for all but their losses, since a subclass with x common shingles gives x - 1 of them or more."""
    n = np.diff(offsets)
    owner = np.repeat(np.arange(len(n)), n)
    spare = n - (PERCENT * n + 99) // 100 + 1
    rare = ~frequent
    rank = np.concatenate([[0], np.cumsum(rare)])
    rare_of = rank[offsets[1:]] - rank[offsets[:-1]]
    alone = rare & (rank[:-1] - rank[offsets[:-1]][owner] < spare[owner])
    sigs, rows = [values[alone]], [owner[alone]]
    for k in np.flatnonzero((rare_of < spare) & (n > 1)).tolist():
        own = values[offsets[k] : offsets[k + 1]][frequent[offsets[k] : offsets[k + 1]]]
        level = int(np.searchsorted(LEVELS, n[k], side="right")) - 1
        for at in (level, level + 1):
            made = combinations(own, int(spare[k] - rare_of[k]), at)
            sigs.append(made)
            rows.append(np.full(len(made), k))
    rows = np.concatenate(rows)
    return np.concatenate(sigs), rows, n[rows]


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each node its set's size, digest and sketch; and rows without a node: shingles frequent among SEEN of them, with their counts in n."""
    seen, held = np.empty(SEEN, np.uint64), 0
    for batch in small_batches(batches, WORK_BYTES):
        values, offsets = sets_of(*text_bytes(batch.column("text")))
        yield _described(batch.column("node"), values, offsets)
        while len(values):
            part = values[: SEEN - held]
            seen[held : held + len(part)] = part
            held, values = held + len(part), values[len(part) :]
            if held == SEEN:
                yield from _often(seen)
                held = 0
    yield from _often(seen[:held])


def _described(nodes: pa.Array, values: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """Size, digest and sketch of each node's set."""
    n = np.diff(offsets)
    digests = []
    for seed in (1, 2):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(values + np.uint64(seed)), dtype=np.uint64)])
        digests.append(_as_long(mix64(total[offsets[1:]] - total[offsets[:-1]] + n.astype(np.uint64))))
    words, ends = parities(values, offsets)
    sketches = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _as_long(words))
    return pa.record_batch([nodes, pa.array(n), *digests, sketches], names=["node", "n", "d1", "d2", "sketch"])


def _often(values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Shingles that are there LOCAL times or more. The values are sorted in place."""
    values.sort()
    first, last = values[: 1 - LOCAL], values[LOCAL - 1 :]
    tokens = np.unique(first[first == last])
    if len(tokens):
        counts = np.searchsorted(values, tokens, side="right") - np.searchsorted(values, tokens)
        none = pa.nulls(len(tokens), pa.int64())
        yield pa.record_batch([none, pa.array(counts), _as_long(tokens), none, pa.nulls(len(tokens), pa.list_(pa.int64()))], names=["node", "n", "d1", "d2", "sketch"])


def _frequent_bitmap(profile: DataFrame) -> np.ndarray:
    """One bit for each cell of the frequent shingles' bitmap."""
    tokens = profile.where("node IS NULL").groupBy("d1").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    return bitmap(tokens, "d1", CELL_BITS)


def _signature_rows(reps: DataFrame, frequent: np.ndarray) -> DataFrame:
    """sig, node, n of all signatures."""
    shared = reps.sparkSession.sparkContext.broadcast(frequent)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in small_batches(batches, WORK_BYTES):
            values, offsets = sets_of(*text_bytes(batch.column("text")))
            sigs, rows, sizes = signatures(values, offsets, in_bitmap(bits, CELL_BITS, values))
            nodes = batch.column("node").to_numpy(zero_copy_only=False)
            for start in range(0, len(sigs), 1 << 17):
                part = slice(start, start + (1 << 17))
                yield pa.record_batch([_as_long(sigs[part]), pa.array(nodes[rows[part]]), pa.array(sizes[part])], names=["sig", "node", "n"])

    return reps.select("node", "text").mapInArrow(emit, "sig long, node long, n long")


def link(docs: DataFrame) -> DataFrame:
    """Of each row of docs: doc_id, n_shingles, component_id."""
    small_arrow_batches(docs.sparkSession)
    with scratch_scope(docs.sparkSession):
        return _link(docs)


def _link(docs: DataFrame) -> DataFrame:
    nodes, plain = keyed(docs)
    nodes = nodes.withColumnRenamed("key", "node")
    profile = stored(nodes.select("node", "text").mapInArrow(_profile, "node long, n long, d1 long, d2 long, sketch array<bigint>"), "profile")
    sets = profile.where("node IS NOT NULL")
    first = sets.where("n > 0").groupBy("d1", "d2").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("times")).where("times > 1")
    classes = stored(sets.join(first, ["d1", "d2"]).where("node <> rep").select("node", "rep"), "classes")
    n_copies = classes.count()
    copies = classes.select("node")
    reps = nodes.join(F.broadcast(copies) if is_small(n_copies, 32) else copies, "node", "left_anti")
    members = stored(members_of(_signature_rows(reps, _frequent_bitmap(profile))), "members")

    def texts(rows: DataFrame, n: int) -> DataFrame:
        return reps.join(F.broadcast(rows) if is_small(n, 48) else rows, "node")

    labels = similar_components(members, sets.select("node", "n"), texts, sets.select("node", "n", "sketch"))

    out = sets.join(classes.withColumnRenamed("rep", "_rep"), "node", "left").withColumn("_rep", F.coalesce("_rep", "node"))
    out = out.join(labels.select(F.col("node").alias("_rep"), "label"), "_rep", "left").select("node", F.col("n").alias("n_shingles"), F.coalesce("label", "_rep").alias("component_id"))
    if plain:
        return stored(out.select(F.col("node").alias("doc_id"), "n_shingles", "component_id"), "linked", keep=True)
    out = stored(out, "linked-rows").join(nodes.select("node", "doc_id"), "node")
    named = out.groupBy("component_id").agg(F.min("doc_id").alias("least"))
    return stored(out.join(named, "component_id").select("doc_id", "n_shingles", F.col("least").alias("component_id")), "linked", keep=True)


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of linked ones: that of the smallest doc_id. All their columns stay."""
    spark, me = docs.sparkSession, f"_{uuid.uuid4().hex}"
    counts = docs.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if counts["rows"] == counts["ids"]:
        with scratch_scope(spark):
            gone = stored(link(docs).where("doc_id <> component_id").select(F.col("doc_id").alias(me)), "gone", keep=True)
        n_gone = gone.count()
        return docs.join(F.broadcast(gone) if is_small(n_gone, 32) else gone, docs["doc_id"].cast("long") == gone[me], "left_anti")
    rows = stored(docs.withColumn(me, F.monotonically_increasing_id()), "rows")
    groups = link(rows.select(F.col(me).alias("doc_id"), "text")).select(F.col("doc_id").alias(me), "component_id")
    kept = rows.select(me, "doc_id").join(groups, me).groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", me)).alias("k")).select(F.col(f"k.{me}").alias(me))
    return rows.join(kept, me, "left_semi").drop(me)
