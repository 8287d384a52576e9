"""Repeated passages by MinHash banding of paragraphs (operator 10).

A paragraph is a line of LEAST_WORDS words or more, or, from each shorter line on, the fewest following short lines that
have as many words together; so a passage of whole lines is found however its document is cut. Each paragraph gets ROWS x BANDS minima of its hashed five-word
shingles; paragraphs with an equal band are candidates. The bands are tuned for recall: at a Jaccard similarity of 0.75 a pair misses all of
them with a chance of (1 - 0.75**ROWS)**BANDS, one in 2000. Candidates are verified by exact Jaccard (see similar_groups) and
clustered by components. Paragraphs of the same words are one class from the start, and only one of them is banded. Of each cluster that spans
documents, the document of the smallest doc_id keeps its paragraphs, the others lose theirs.

A passage may also lie inside longer lines, where no paragraph begins or ends with it. For these a text has more paragraphs, cut by
content: each WINDOW words from an anchor on, a place whose five-word shingle has the least hash of some SPACING shingles in a row. Of SPACING
places in a row at least one is an anchor, whatever stands around, so a passage of LEAST_WORDS words that two texts share holds a whole
window that both have. Such windows count as repeated where another row has the same words, and are then found wherever they stand; overlapping ones of a row join to a run, and runs with a window
in common are clustered by components. Each window has a keeper of its own: the row of the smallest doc_id among those where no lost paragraph touches it, or
where there is none, each row keeps it. A row loses the windows that others keep, but for the words of those that it keeps itself; so every window stays whole in its keeper, and
words of a passage that windows kept around it overlap may stay in several rows. Windows that lie in paragraphs of one and the same cluster in all their rows are left out, as they tell nothing new. So every
passage of LEAST_WORDS words or more is found, and none under WINDOW words is reported.

Nulls: a null text has no paragraphs. A null doc_id ranks first among the keepers of a cluster; rows with a repeated or null doc_id are
told apart by position. Copies of whole documents are repeated passages. An empty table gives an empty result. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow_text import runs_of_rows, text_bytes
from .common import bitmap, in_bitmap, is_small, keyed, scratch_scope, small_arrow_batches, stored
from .components import components
from .shingles import CHUNK, FOLDED, WIDTH, powers, mix64, range_hashes, shingle_hashes, word_spans
from .similar_groups import members_of, similar_components

LEAST_WORDS = 50
ROWS, BANDS = 3, 14
#: Shingles in a row of which one is an anchor, and words of the window from an anchor on.
SPACING = 8
WINDOW = LEAST_WORDS - SPACING + 1
_MULTIPLIERS = [np.uint64(int(x) | 1) for x in np.random.default_rng(20240302).integers(1, 1 << 63, ROWS * BANDS)]
_STEP = np.uint64(0xD1B54A32D192ED03)


def paragraphs(line_words: np.ndarray, line_text: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """First line of each paragraph, and the line after its last. line_words: words of each line, line_text: its text's number."""
    n = len(line_words)
    total = np.concatenate([[0], np.cumsum(line_words)])
    lines = np.arange(n)
    long = line_words >= least
    stops = np.concatenate([np.flatnonzero(long | np.append(line_text[1:] != line_text[:-1], True)[: n])]) if n else np.zeros(0, np.int64)
    # a run of short lines ends before the next long line, or with its text
    nth = np.searchsorted(stops, lines)
    stop = stops[nth] + ~long[stops[nth]] if n else lines
    end = np.where(long, lines + 1, np.searchsorted(total, total[:-1] + least))
    ok = (line_words > 0) & (long | (end <= stop))
    return lines[ok], end[ok]


def _paragraph_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each paragraph: key of its row, start and end in code points, words, distinct shingles, digests and bands."""
    for batch in batches:
        raw, offsets = text_bytes(batch.column("text"))
        data, at = raw.tobytes(), offsets.tolist()
        keys, ids = batch.column("key"), batch.column("doc_id")
        for first, last in runs_of_rows(offsets, CHUNK):
            buffer = np.frombuffer(b"\n".join(data[at[k] : at[k + 1]] for k in range(first, last)) + b"\n", np.uint8)
            edges = np.concatenate([[0], np.cumsum(np.diff(offsets[first : last + 1]) + 1)])
            starts, ends = word_spans(buffer)
            line_ends = np.flatnonzero(buffer == 10)
            line_starts = np.concatenate([[0], line_ends[:-1] + 1])
            line_edges = np.concatenate([np.searchsorted(starts, line_starts), [len(starts)]])
            line_text = np.searchsorted(edges, line_starts, side="right") - 1
            a, b = paragraphs(np.diff(line_edges), line_text)
            if not len(a):
                continue
            text, w0, w1 = line_text[a], line_edges[a], line_edges[b]
            grams = shingle_hashes(range_hashes(buffer, starts, ends, FOLDED), WIDTH)
            n = w1 - w0 - WIDTH + 1
            begins = np.cumsum(n) - n
            place = np.arange(int(n.sum())) - np.repeat(begins, n)
            own = grams[place + np.repeat(w0, n)]
            digests = [np.add.reduceat(mix64(own + (place.astype(np.uint64) + np.uint64(seed)) * _STEP), begins) for seed in (1, 1 << 32)]
            owner = np.repeat(np.arange(len(n)), n)
            _, distinct = np.unique(mix64(own + owner.astype(np.uint64) * _STEP), return_index=True)
            bands = np.zeros((len(n), BANDS), np.uint64)
            for k, m in enumerate(_MULTIPLIERS):
                bands[:, k // ROWS] = mix64(bands[:, k // ROWS] + np.minimum.reduceat(own * m, begins) + np.uint64(k))
            points = np.concatenate([[0], np.cumsum((buffer & 0xC0) != 0x80)])
            rows = pa.array(text + first)
            yield pa.record_batch(
                [
                    keys.take(rows), ids.take(rows), pa.array(points[starts[w0]] - points[edges[text]]), pa.array(points[ends[w1 - 1]] - points[edges[text]]), pa.array(w1 - w0),
                    pa.array(np.bincount(owner[distinct], minlength=len(n))), pa.array(digests[0].view(np.int64)), pa.array(digests[1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array((np.arange(len(n) + 1) * BANDS).astype(np.int32)), pa.array(bands.reshape(-1).view(np.int64))),
                ],
                names=["key", "doc_id", "start", "end", "words", "n", "d1", "d2", "bands"],
            )


def anchors(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """First words of the windows. words: hashes of all words, text: the number of each one's text."""
    grams = shingle_hashes(words, WIDTH)
    n = len(grams) - SPACING + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = np.lib.stride_tricks.sliding_window_view(grams, SPACING).argmin(axis=1) + np.arange(n)
    chosen = np.unique(least[text[:n] == text[len(words) - n :]])
    chosen = chosen[chosen + WINDOW <= len(words)]
    return chosen[text[chosen] == text[chosen + WINDOW - 1]]


def _windows(rows: DataFrame, among: tuple[int, np.ndarray] | None = None) -> DataFrame:
    """key and d1 of all windows of rows from anchors on; or, from any word on, of those whose d1 may be among the digests of a bitmap (its bits, cells), also doc_id, at (the first word's number), start and end in code points, d2."""
    shared = None if among is None else rows.sparkSession.sparkContext.broadcast(among)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            data, at = raw.tobytes(), offsets.tolist()
            keys, ids = batch.column("key"), batch.column("doc_id")
            for first, last in runs_of_rows(offsets, CHUNK):
                buffer = np.frombuffer(b"\n".join(data[at[k] : at[k + 1]] for k in range(first, last)) + b"\n", np.uint8)
                edges = np.concatenate([[0], np.cumsum(np.diff(offsets[first : last + 1]) + 1)])
                starts, ends = word_spans(buffer)
                words, text = range_hashes(buffer, starts, ends, FOLDED), np.searchsorted(edges, starts, side="right") - 1
                if shared is None:
                    a = anchors(words, text)
                else:  # whether a place near the left end of a passage is an anchor depends on what stands before it
                    a = np.flatnonzero(text[: max(0, len(text) - WINDOW + 1)] == text[WINDOW - 1 :])
                d1 = _digests(words, a)
                if shared is None:
                    yield pa.record_batch([keys.take(pa.array(text[a] + first)), pa.array(d1.view(np.int64))], names=["key", "d1"])
                    continue
                may = in_bitmap(shared.value[1], shared.value[0], d1)
                a, d1 = a[may], d1[may]
                points = np.concatenate([[0], np.cumsum((buffer & 0xC0) != 0x80)])
                base, place, d2 = points[edges[text[a]]], pa.array(text[a] + first), _digests(mix64(words + np.uint64(1)), a)
                yield pa.record_batch(
                    [keys.take(place), pa.array(d1.view(np.int64)), ids.take(place), pa.array(a - np.searchsorted(text, text[a])), pa.array(points[starts[a]] - base), pa.array(points[ends[a + WINDOW - 1]] - base), pa.array(d2.view(np.int64))],
                    names=["key", "d1", "doc_id", "at", "start", "end", "d2"],
                )

    return rows.mapInArrow(emit, "key long, d1 long" + ("" if among is None else ", doc_id long, at long, start long, end long, d2 long"))


def _digests(words: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Hashes of the windows that begin at the words a."""
    up, down = powers(len(words) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)])
    return mix64((total[a + WINDOW] - total[a]) * down[a])


def _with_keepers(placed: DataFrame) -> DataFrame:
    """placed (key, doc_id, start, end, words, cluster) of clusters that span rows, with kept."""
    keepers = placed.groupBy("cluster").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.min(F.struct("doc_id", "key", "start")).alias("kept")).where("least <> most").select("cluster", "kept")
    return placed.join(keepers, "cluster")


def _runs(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """Stretches of repeated windows of rows: key, doc_id, start, end, words, cluster (negative), kept. placed: clustered paragraphs (key, start, end, cluster, kept)."""
    shared = _windows(rows).groupBy("d1").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least <> most").select("d1")
    shared = stored(shared, "shared")
    # up to 2**29 cells (64 MB) about one in a hundred other windows is taken along; the join is exact
    bits = min(29, max(20, int(shared.count()).bit_length() + 6))
    found = _windows(rows, (bits, bitmap(shared, "d1", bits))).join(shared, "d1")
    # the cluster of a paragraph of the row that covers a window: the one of the farthest end of those that begin before it;
    # and whether a paragraph that the row loses touches it: the farthest end of those that begin before its end
    spans = placed.select("key", "start", "end", F.col("end").alias("span"), "cluster", (F.col("key") != F.col("kept.key")).alias("lost"))
    by_key, is_span = W.partitionBy("key"), F.col("span").isNotNull()
    begun = by_key.orderBy("start", ~is_span).rowsBetween(W.unboundedPreceding, 0)
    met = by_key.orderBy(F.when(is_span, F.col("start")).otherwise(F.col("end")), is_span).rowsBetween(W.unboundedPreceding, 0)
    swept = found.unionByName(spans, allowMissingColumns=True).withColumn("reach", F.max(F.when(is_span, F.struct("span", "cluster"))).over(begun)).withColumn("cut", F.max(F.when(F.col("lost"), F.col("span"))).over(met)).where("span IS NULL")
    swept = swept.withColumn("cover", F.when(F.col("reach.span") >= F.col("end"), F.col("reach.cluster"))).withColumn("cut", F.coalesce(F.col("cut") > F.col("start"), F.lit(False)))
    found = stored(swept.drop("span", "cluster", "lost", "reach").withColumn("id", F.monotonically_increasing_id()), "repeated")
    known = F.coalesce((F.count("cover") == F.count(F.lit(1))) & (F.min("cover") == F.max("cover")), F.lit(False))
    least = found.groupBy("d1", "d2").agg(F.min("key").alias("least"), F.max("key").alias("most"), known.alias("known"), F.min(F.struct("cut", "doc_id", "key", "start")).alias("kept"))
    least = least.where("least <> most AND NOT known").select("d1", "d2", F.when(~F.col("kept.cut"), F.struct("kept.doc_id", "kept.key", "kept.start")).alias("kept"))
    # node: a run, part: its windows in a row that one row keeps; both are named by their first window
    w = by_key.orderBy("at")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    marked = found.drop("cover", "cut").join(least, ["d1", "d2"]).withColumn("kept", F.coalesce("kept", F.struct("doc_id", "key", "start"))).withColumn("new", F.coalesce(F.col("at") - F.lag("at").over(w) >= WINDOW, F.lit(True)))
    marked = marked.withColumn("turn", F.col("new") | (F.col("kept.key") != F.lag("kept.key").over(w)))
    marked = marked.withColumn("node", F.last(F.when(F.col("new"), F.col("id")), True).over(so_far)).withColumn("part", F.last(F.when(F.col("turn"), F.col("id")), True).over(so_far))
    marked = stored(marked.drop("id", "new", "turn"), "marked")
    hubs = marked.groupBy("d1", "d2").agg(F.min("node").alias("u"))
    labels = components(marked.join(hubs, ["d1", "d2"]).select("u", F.col("node").alias("v")))
    parts = marked.groupBy("key", "part").agg(
        F.min("doc_id").alias("doc_id"), F.min("node").alias("node"), F.min("at").alias("first"), (F.max("at") + WINDOW).alias("last"), F.min("start").alias("start"), F.max("end").alias("end"),
        F.min("kept.doc_id").alias("keep_doc"), F.min("kept.key").alias("keep_key"), F.min("kept.start").alias("keep_start"),
    )
    # kept parts before and after a lost one; windows are of one length, so that the order of their ends is that of their starts
    own = F.col("key") == F.col("keep_key")
    before, after = by_key.orderBy("first").rowsBetween(W.unboundedPreceding, -1), by_key.orderBy(F.desc("first")).rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("left", F.max(F.when(own, F.struct("last", "end"))).over(before)).withColumn("right", F.min(F.when(own, F.struct("first", "start"))).over(after))
    from_left, to_right = ~own & F.coalesce(F.col("left.last") > F.col("first"), F.lit(False)), ~own & F.coalesce(F.col("right.first") < F.col("last"), F.lit(False))
    words = F.when(to_right, F.col("right.first")).otherwise(F.col("last")) - F.when(from_left, F.col("left.last")).otherwise(F.col("first"))
    # one separator after kept words stays
    parts = parts.select("node", "key", "doc_id", F.when(from_left, F.col("left.end") + 1).otherwise(F.col("start")).alias("start"), F.when(to_right, F.col("right.start")).otherwise(F.col("end")).alias("end"), words.alias("words"), F.struct(F.col("keep_doc").alias("doc_id"), F.col("keep_key").alias("key"), F.col("keep_start").alias("start")).alias("kept"))
    return parts.where("words > 0").join(labels, "node").select("key", "doc_id", "start", "end", "words", (-F.col("label") - 1).alias("cluster"), "kept")


def _clusters(rows: DataFrame) -> DataFrame:
    """rows (key, doc_id, text): all paragraphs and stretches of runs of clusters that span rows, with cluster and keeper."""
    schema = "key long, doc_id long, start long, end long, words long, n long, d1 long, d2 long, bands array<long>"
    found = rows.mapInArrow(_paragraph_rows, schema).withColumn("node", F.monotonically_increasing_id())
    units = stored(found, "paragraphs")
    first = units.groupBy("d1", "d2").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("times"))
    reps = stored(first.join(units.select("node", "n", "bands"), "node"), "classes")
    bands = reps.select(F.explode("bands").alias("sig"), "node", (-F.col("n")).alias("n"))
    members = stored(members_of(bands), "members")

    def texts(wanted: DataFrame, n: int) -> DataFrame:
        spots = units.select("node", "key", "start", "end").join(F.broadcast(wanted) if is_small(n, 48) else wanted, "node")
        whole = rows
        if is_small(n, 64):
            spots = F.broadcast(spots)
        elif is_small(n, 32):  # texts of other rows stay where they are
            whole = rows.join(F.broadcast(spots.select("key").distinct()), "key", "left_semi")
        return whole.select("key", F.col("text").alias("whole")).join(spots, "key").withColumn("text", F.substring("whole", F.col("start") + 1, F.col("end") - F.col("start"))).drop("whole")

    labels = similar_components(members, reps.select("node", "n"), texts)
    named = reps.join(labels, "node", "left").where("times > 1 OR label IS NOT NULL").select("d1", "d2", F.coalesce("label", "node").alias("cluster"))
    placed = stored(_with_keepers(units.join(named, ["d1", "d2"]).select("key", "doc_id", "start", "end", "words", "cluster")), "placed")
    return placed.unionByName(_runs(rows, placed))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """All paragraphs, and passages inside lines, that other documents repeat: doc_id, start_char, end_char (code points), n_words, cluster_id, keep_doc_id, keep_start, removed.

    Of a passage inside lines there is a row for each stretch that one document keeps; keep_start is where its first whole window begins there."""
    small_arrow_batches(docs.sparkSession)
    with scratch_scope(docs.sparkSession):
        found = stored(_clusters(keyed(docs)[0]), "passages", keep=True)
    return found.select("doc_id", F.col("start").alias("start_char"), F.col("end").alias("end_char"), F.col("words").alias("n_words"), F.col("cluster").alias("cluster_id"), F.col("kept.doc_id").alias("keep_doc_id"), F.col("kept.start").alias("keep_start"), (F.col("key") != F.col("kept.key")).alias("removed"))


def _without(text: Column, spans: Column) -> Column:
    """text without the sorted spans (s, e), which may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        piece = F.when(x["s"] > acc["at"], F.substring(text, acc["at"].cast("int") + 1, (x["s"] - acc["at"]).cast("int"))).otherwise("")
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.length(text))))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text of every row, without the paragraphs that it loses."""
    small_arrow_batches(docs.sparkSession)
    rows, _ = keyed(docs)
    with scratch_scope(docs.sparkSession):
        lost = _clusters(rows).where(F.col("key") != F.col("kept.key"))
        spans = lost.groupBy("key").agg(F.array_sort(F.collect_set(F.struct(F.col("start").alias("s"), F.col("end").alias("e")))).alias("spans"))
        spans = stored(spans, "lost", keep=True)
    return rows.join(spans, "key", "left").select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("spans"))).alias("text"))
