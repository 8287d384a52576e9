"""Components of similar texts, from buckets of candidates (operators 2 and 10).

Two texts link when their sets of word shingles have a Jaccard similarity of PERCENT / 100 or more. A bucket holds texts that share a signature.
Small buckets give pairs, of which those are kept whose sizes, and whose numbers of common signatures, a linked pair can have. Large
buckets are kept as they are. Components of both are candidate groups, verified by exact intersection of the whole sets:

- The texts of a group up to SOLVE (members x shingles) and HOLD (shingles) come together once, and one search from each member finds its links
  to those not reached yet.
- In larger groups all pairs of small buckets are verified. Then some members of each large bucket (its pivots) are compared with those
  of other components, in rounds: what links is joined, and buckets that lie in one component are done. A pivot has then met its whole bucket
  and leaves it. So every candidate pair is verified or already joined, and no large bucket is expanded into all its pairs at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow_text import WORK_BYTES, small_batches, text_bytes
from .common import is_small, scratch_scope, stored
from .components import components
from .shingles import sets_of

PERCENT = 75
#: Members of a bucket whose pairs are all looked at.
SMALL = 64
#: Pairs of a large bucket that the third round may verify, beyond its share for a few pivots; each later round may GROW times as many as the one before.
ROUND_PAIRS, GROW = 20_000, 8
#: A candidate group with members x shingles up to SOLVE (some twenty seconds' work) and shingles up to HOLD (some 200 MB) is solved by one task.
SOLVE, HOLD = 2 * 10**10, 4 * 10**6
#: Members that one task compares with a pivot.
SALT_ROWS = 2000

#: Gives (rows with a column node, their number) the columns of the rows with the texts of the nodes.
Texts = Callable[[DataFrame, int], DataFrame]


def members_of(signatures: DataFrame) -> DataFrame:
    """bucket, size, node, n, weight from signatures (sig, node, n): buckets of the same members count once, with their number as weight.

    n is the size of the node's set, or its negative where the number of common signatures tells nothing."""
    w = W.partitionBy("sig")
    rows = signatures.withColumn("size", F.count(F.lit(1)).over(w)).withColumn("bucket", F.bit_xor(F.xxhash64("node", "n")).over(w)).where("size > 1")
    return rows.groupBy("bucket", "size", "node", "n").agg(F.count(F.lit(1)).alias("weight"))


def likely_pairs(members: DataFrame) -> DataFrame:
    """Pairs (pivot, node) of small buckets that may link.

    Of sets of a and b shingles that link, 3 (a + b) / 7 or more are common, and all but 3/4 of the larger set lies in its prefix."""
    small = members.where(F.col("size") <= SMALL)
    a = small.select("bucket", F.col("node").alias("pivot"), F.col("n").alias("pivot_n"), "weight")
    b = small.select("bucket", "node", "n")
    low, high = F.least(F.abs("pivot_n"), F.abs("n")), F.greatest(F.abs("pivot_n"), F.abs("n"))
    found = a.join(b, "bucket").where((F.col("pivot") < F.col("node")) & (4 * low >= 3 * high))
    found = found.groupBy("pivot", "node").agg(F.sum("weight").alias("common"), F.min(F.least("pivot_n", "n")).alias("least"), F.max(low).alias("low"), F.max(high).alias("high"))
    needed = F.ceil(3 * (F.col("low") + F.col("high")) / 7) - F.ceil(3 * F.col("high") / 4) + 1
    return found.where((F.col("least") < 0) | (F.col("common") >= needed)).select("pivot", "node")


def not_ruled_out(pairs: DataFrame, sketches: DataFrame | None) -> DataFrame:
    """pairs (pivot, node), whose sizes are within 3 : 4, without those that cannot link by their sketches (node, n, sketch; see shingles.parities).

    Of sets of a and b shingles that link, (a + b) / 7 at most are not common, and as many cells at most of their sketches, of which a longer one is folded, are unlike."""
    if sketches is None:
        return pairs
    a = sketches.select(F.col("node").alias("pivot"), F.col("n").alias("_a"), F.col("sketch").alias("_x"))
    b = sketches.select("node", F.col("n").alias("_b"), F.col("sketch").alias("_y"))
    fold = lambda x, y: F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, 1, F.size(y)), F.slice(x, F.size(y) + 1, F.size(y)), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(x))
    unlike = F.aggregate(F.zip_with(fold("_x", "_y"), fold("_y", "_x"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, x: n + x)
    return pairs.join(a, "pivot").join(b, "node").where(7 * unlike <= F.col("_a") + F.col("_b")).select("pivot", "node")


def _of(nodes: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """The rows of n nodes."""
    return rows.join(F.broadcast(nodes) if is_small(n, 32) else nodes, "node", "left_semi")


def _verify(pairs: DataFrame, texts: Texts, n_pairs: int) -> DataFrame:
    """pairs (pivot, node) with linked. Each pivot's text is sent once for every SALT_ROWS nodes, each node's once a pair."""
    salted = pairs.withColumn("salt", F.floor((F.row_number().over(W.partitionBy("pivot").orderBy("node")) - 1) / SALT_ROWS)) if n_pairs > SALT_ROWS else pairs.withColumn("salt", F.lit(0).cast("long"))
    wanted = salted.select("pivot", "salt", "node", F.lit(False).alias("first"))
    wanted = wanted.unionByName(salted.select("pivot", "salt", F.col("pivot").alias("node"), F.lit(True).alias("first")).distinct())
    rows = texts(wanted, 2 * n_pairs).select("pivot", "salt", "first", "node", "text")
    dealt = rows.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", F.desc("first"), "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.uint64)
        for batch in small_batches(batches, WORK_BYTES):
            values, offsets = sets_of(*text_bytes(batch.column("text")))
            first = batch.column("first").to_numpy(zero_copy_only=False)
            linked = np.zeros(len(first), bool)
            for k, (is_first, a, b) in enumerate(zip(first.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                own = values[a:b]
                if is_first:
                    held = own.copy()
                elif len(held) and len(own):
                    both = int((held[np.minimum(np.searchsorted(held, own), len(held) - 1)] == own).sum())
                    linked[k] = 100 * both >= PERCENT * (len(held) + len(own) - both)
            keep = ~first
            yield pa.record_batch([batch.column("pivot"), batch.column("node"), pa.array(linked)], names=["pivot", "node", "linked"]).filter(pa.array(keep))

    return dealt.mapInArrow(compare, "pivot long, node long, linked boolean")


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after the links (pivot, node) between them."""
    a, b = labels.select(F.col("node").alias("pivot"), F.col("label").alias("u")), labels.select("node", F.col("label").alias("v"))
    joined = components(links.join(a, "pivot").join(b, "node").select("u", "v"))
    moved = joined.select(F.col("node").alias("old"), F.col("label").alias("new"))
    return labels.join(moved, labels["label"] == moved["old"], "left").select("node", F.coalesce("new", "label").alias("label"))


def _pairs(buckets: DataFrame, labels: DataFrame, round_: int) -> tuple[DataFrame, DataFrame]:
    """The next pairs to verify, and the buckets that stay open, without the pivots of these pairs."""
    w = W.partitionBy("bucket")
    marked = buckets.join(labels, "node").withColumn("size", F.count(F.lit(1)).over(w)).withColumn("low", F.min("label").over(w)).withColumn("high", F.max("label").over(w)).where("low <> high")
    marked = marked.withColumn("like", F.count(F.lit(1)).over(W.partitionBy("bucket", "label")))
    most = F.lit(1) if round_ == 0 else F.greatest(F.lit(4), F.ceil(F.lit(float(ROUND_PAIRS * GROW ** min(round_ - 2, 12))) / F.col("size"))) if round_ > 1 else F.lit(4)
    order = ["node"] if round_ == 0 else ["like", "label", "node"]
    marked = marked.withColumn("nth", F.row_number().over(w.orderBy(*order))).withColumn("is_pivot", F.col("nth") <= most)
    open_ = stored(marked.select("bucket", "node", "n", "label", "nth", "is_pivot"), "buckets")
    pivots = open_.where("is_pivot").select("bucket", F.col("node").alias("pivot"), F.abs("n").alias("pivot_n"), F.col("label").alias("pivot_label"), F.col("nth").alias("pivot_nth"))
    pairs = open_.join(pivots, "bucket").where("label <> pivot_label AND (NOT is_pivot OR nth > pivot_nth)")
    pairs = pairs.where(4 * F.least(F.abs("n"), "pivot_n") >= 3 * F.greatest(F.abs("n"), "pivot_n"))
    pairs = pairs.select(F.least("pivot", "node").alias("pivot"), F.greatest("pivot", "node").alias("node")).distinct()
    return pairs, open_.where("NOT is_pivot").select("bucket", "node", "n")


def search(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each set of a group, the first member of its component."""
    n, m = np.diff(offsets), len(offsets) - 1
    root = np.full(m, -1)
    if m == 2:
        both = len(np.intersect1d(values[: offsets[1]], values[offsets[1] :], assume_unique=True))
        return np.array([0, 0 if 100 * both >= PERCENT * (n[0] + n[1] - both) else 1])
    tokens, place = np.unique(values, return_inverse=True)
    mark = np.zeros(len(tokens), np.int64)
    for seed in range(m):
        if root[seed] >= 0:
            continue
        root[seed], waiting = seed, [seed]
        while waiting:
            k = waiting.pop()
            own = place[offsets[k] : offsets[k + 1]]
            mark[own] = 1
            both = np.add.reduceat(mark[place], offsets[:-1])
            mark[own] = 0
            near = np.flatnonzero((root < 0) & (100 * both >= PERCENT * (n + n[k] - both)))
            root[near] = seed
            waiting += near.tolist()
    return root


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, node, text) in the order of label, node; gives node and the smallest node of its component."""
    held_label, held_nodes, held_values, held_sizes = None, [], [], []

    def done() -> pa.RecordBatch:
        nodes = np.concatenate(held_nodes)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(held_sizes))])
        root = search(np.concatenate(held_values), offsets)
        return pa.record_batch([pa.array(nodes), pa.array(nodes[root])], names=["node", "label"])

    for batch in small_batches(batches, WORK_BYTES):
        values, offsets = sets_of(*text_bytes(batch.column("text")))
        labels, nodes, sizes = batch.column("label").to_numpy(), batch.column("node").to_numpy(), np.diff(offsets)
        edges = np.concatenate([[0], np.flatnonzero(labels[1:] != labels[:-1]) + 1, [len(labels)]]).tolist() if len(labels) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held_nodes and labels[a] != held_label:
                yield done()
                held_nodes, held_values, held_sizes = [], [], []
            held_label = labels[a]
            held_nodes.append(nodes[a:b])
            held_values.append(values[offsets[a] : offsets[b]])
            held_sizes.append(sizes[a:b])
    if held_nodes:
        yield done()


def _rounds(pairs: DataFrame, buckets: DataFrame, texts: Texts, sketches: DataFrame | None) -> DataFrame:
    """node and label of all nodes of the pairs and buckets."""
    nodes = pairs.select("node").unionByName(pairs.select(F.col("pivot").alias("node"))).unionByName(buckets.select("node")).distinct()
    labels, tested, rest = stored(nodes.withColumn("label", F.col("node")), "labels"), None, buckets
    round_ = 0
    while True:
        pairs = stored(pairs if tested is None else pairs.join(tested, ["pivot", "node"], "left_anti"), "pairs")
        n_pairs = pairs.count()
        if n_pairs:
            verdicts = stored(_verify(pairs, texts, n_pairs), "verdicts")
            labels = stored(_relabel(labels, verdicts.where("linked")), "labels")
            unlinked = verdicts.where("NOT linked").select("pivot", "node")
            tested = unlinked if tested is None else tested.unionByName(unlinked)
        if not rest.limit(1).count():
            return labels
        pairs, rest = _pairs(rest, labels, round_)
        pairs = not_ruled_out(pairs, sketches)
        round_ += 1


def similar_components(members: DataFrame, sizes: DataFrame, texts: Texts, sketches: DataFrame | None = None) -> DataFrame:
    """node and label, the smallest node of its component, of every node that may link with another.

    members: as from members_of. sizes: node and n of all nodes. texts: gives whole texts. sketches: node, n and sketch of all nodes, if there are any."""
    with scratch_scope(members.sparkSession):
        return stored(_similar(members, sizes, texts, sketches), "labels", keep=True)


def _similar(members: DataFrame, sizes: DataFrame, texts: Texts, sketches: DataFrame | None) -> DataFrame:
    pairs = stored(likely_pairs(members), "likely")
    large = members.where(F.col("size") > SMALL).select("bucket", "node", "n")
    if sketches is not None:
        nodes = stored(pairs.select("node").unionByName(pairs.select(F.col("pivot").alias("node"))).unionByName(large.select("node")).distinct(), "candidates")
        sketches = stored(_of(nodes, sketches, nodes.count()), "sketches")
        pairs = stored(not_ruled_out(pairs, sketches), "left")
    hubs = large.groupBy("bucket").agg(F.min("node").alias("u"))
    edges = pairs.select(F.col("pivot").alias("u"), F.col("node").alias("v")).unionByName(large.join(hubs, "bucket").select("u", F.col("node").alias("v")))
    groups = components(edges).join(sizes, "node")
    work = groups.groupBy("label").agg((F.count(F.lit(1)) * F.sum("n")).alias("work"), F.sum("n").alias("held"))
    groups = stored(groups.join(work, "label").select("node", "label", ((F.col("work") <= SOLVE) & (F.col("held") <= HOLD)).alias("small")), "groups")
    counts = groups.agg(F.count(F.lit(1)).alias("all"), F.count_if("small").alias("small")).first()
    rows = texts(groups.where("small").select("node", "label"), counts["small"]).select("label", "node", "text")
    labels = rows.repartition("label").sortWithinPartitions("label", "node").mapInArrow(_solve, "node long, label long")
    n_open = counts["all"] - counts["small"]
    if n_open:
        open_ = groups.where("NOT small").select("node")
        own = stored(texts(open_, n_open).select("node", "text"), "texts")  # read in every round
        sketches = None if sketches is None else stored(_of(open_, sketches, n_open), "open-sketches")

        def open_texts(wanted: DataFrame, n: int) -> DataFrame:
            return own.join(F.broadcast(wanted) if is_small(n, 48) else wanted, "node")

        labels = labels.unionByName(_rounds(pairs.join(open_, "node", "left_semi"), large.join(open_, "node", "left_semi"), open_texts, sketches))
    return labels
