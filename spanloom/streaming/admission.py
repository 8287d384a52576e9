"""Untrusted rows as streams: tail of a folder, fan-out by kind to several stores, exact admission with state, output on change.

Lines are envelopes {peer, day, seq, row} of JSON, whose row is the JSON text of a feedback row or of an endorsement batch. Two forms
of admission give the outcomes of `operators.admission.admit`:

* `fan_out` works a micro-batch at a time and keeps no state but the stores themselves: what earlier batches registered is read from
  the stores, new rows are tried by the batch operator, and every store gets a folder of the run and batch, written with overwrite. A batch that failed half-way and is replayed
  writes the same folders again. A run whose checkpoint is lost starts as a new run and finds what is stored.
* `admission` is one stateful processor for low latency; its state is bounded by the caps. Rows that are stored already can be its initial state.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import admission as M
from ..session import files_of

ENVELOPE = "peer string, day int, seq bigint, row string"
#: Of a store of admitted rows.
STORED = "seq long, peer string, day int, digest string, category string, decision string, known boolean, bytes long, stored string"
ENDORSEMENT_BYTES = 4 << 20
ENTRIES = 50


def tail(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """New lines of a growing folder of text files; the query's checkpoint remembers what was read."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder).select(F.col("value").alias("line"))


def opened(lines: DataFrame) -> DataFrame:
    """Lines of envelopes as seq, peer, day, line and kind: endorsements, feedback, or envelope where a line is none."""
    rows = lines.select(F.from_json("line", ENVELOPE).alias("e"), F.col("line").alias("sent")).select("e.seq", "e.peer", "e.day", F.col("e.row").alias("line"), "sent")
    kind = F.when(F.col("peer").isNull() | F.col("day").isNull() | F.col("seq").isNull() | F.col("line").isNull(), "envelope").when(F.col("line").contains('"kind":"endorsements"'), "endorsements").otherwise("feedback")
    return rows.withColumn("kind", kind)


class _Gate(StatefulProcessor):
    """Digests, counts of a peer's day, samples of proposed categories, and bytes and categories of both stores. A row that is refused leaves all of them as they are."""

    def __init__(self, limits: M.Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.digests = handle.getMapState("digests", "digest string", "at long")
        self.counts = handle.getMapState("counts", "peer string, day int", "n int")
        self.samples = handle.getMapState("samples", "category string", "n int")
        self.totals = handle.getValueState("totals", "bytes long, proposed_bytes long, categories int")

    def _held(self) -> list[int]:
        return list(self.totals.get()) if self.totals.exists() else [0, 0, 0]

    def _register(self, r: Any, held: list[int]) -> None:
        self.digests.updateValue((r.digest,), (int(r.seq),))
        if r.known:
            slot = (r.peer, int(r.day))
            self.counts.updateValue(slot, ((self.counts.getValue(slot)[0] if self.counts.containsKey(slot) else 0) + 1,))
            held[0] += int(r.bytes)
        else:
            had = self.samples.getValue((r.category,))[0] if self.samples.containsKey((r.category,)) else 0
            self.samples.updateValue((r.category,), (had + 1,))
            held[1] += int(r.bytes)
            held[2] += not had

    def _outcome(self, r: Any, held: list[int]) -> str:
        slot, size, limits = (r.peer, int(r.day)), int(r.bytes), self.limits
        if self.digests.containsKey((r.digest,)):
            return "deduped"
        if self.counts.containsKey(slot) and self.counts.getValue(slot)[0] >= limits.peer_day_rows:
            return "rate_limited"
        if r.known:
            return "over_cap" if held[0] + size > limits.total_bytes else "accepted"
        had = self.samples.getValue((r.category,))[0] if self.samples.containsKey((r.category,)) else 0
        if had >= limits.category_samples or (not had and held[2] >= limits.proposed_categories) or held[1] + size > limits.proposed_bytes:
            return "proposed_dropped"
        return "proposed"

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        held = self._held()
        for r in initialState.itertuples():
            self._register(r, held)
        self.totals.update(tuple(held))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held, outcomes = self._held(), []
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for r in batch.itertuples():
            outcome = self._outcome(r, held) if r.verdict == "ok" else "bad_format"
            if outcome in ("accepted", "proposed"):
                self._register(r, held)
            outcomes.append(outcome)
        self.totals.update(tuple(held))
        yield pd.DataFrame({"seq": batch["seq"].to_numpy(), "peer": batch["peer"].to_numpy(), "day": batch["day"].to_numpy(), "outcome": outcomes})

    def close(self) -> None:
        pass


def admission(rows: DataFrame, limits: M.Limits = M.Limits(), stored: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """Outcome of each judged row, in order of seq within a batch and of batches, after the stored rows. Needs the RocksDB state store.

    One key: every cap but the digests' is over all rows, and the digests held are as bounded as the stores. The rows carry neither texts nor vectors."""
    slim = ["seq", "peer", "day", "digest", "category", "known", "bytes"]
    keyed = rows.select(*slim, "verdict").withColumn("gate", F.lit(0))
    first = None if stored is None else stored.select(*slim).withColumn("gate", F.lit(0)).groupBy("gate")
    return keyed.groupBy("gate").transformWithStateInPandas(_Gate(limits), "seq long, peer string, day int, outcome string", "append", "None", first)


def _exists(spark: SparkSession, path: str) -> bool:
    target, files = files_of(spark, path)
    return files.exists(target)


def stored_rows(spark: SparkSession, folder: str, run: str | None = None, before: int = 0) -> DataFrame:
    """What a fan-out has stored, of all runs; of the run that is named only what batches before `before` wrote. Rows of a folder that hold no row of the store are left out."""
    parts = [spark.createDataFrame([], STORED + ", run string, batch int")]
    parts += [spark.read.option("basePath", f"{folder}/{store}").schema(STORED + ", run string, batch int").parquet(f"{folder}/{store}") for store in ("accepted", "proposed") if _exists(spark, f"{folder}/{store}")]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    if run is not None:
        rows = rows.where((F.col("run") != run) | (F.col("batch") < before))
    return rows.where("digest IS NOT NULL")


def fan_out_batch(batch: DataFrame, number: int, folder: str, run: str, accepted: DataFrame, limits: M.Limits = M.Limits(), after: Callable[[str], None] = lambda store: None) -> None:  # noqa: B008
    """Judge and admit one micro-batch of lines and write its rows to the stores accepted, proposed, refused, endorsements and envelopes; after(store) is called after each."""
    spark = batch.sparkSession
    rows = opened(batch).persist()
    try:
        judged = M.judged(rows.where("kind = 'feedback'").select("seq", "peer", "day", "line"), accepted)
        outcomes = M.admit(judged, limits, stored_rows(spark, folder, run, number)).select("seq", "outcome")
        told = judged.join(outcomes, "seq")
        columns = [c.split()[0] for c in STORED.split(", ")]
        stores = {
            "accepted": told.where("outcome = 'accepted'").select(*columns),
            "proposed": told.where("outcome = 'proposed'").select(*columns),
            "refused": told.where("outcome NOT IN ('accepted', 'proposed')").select("seq", "peer", "day", "outcome", "verdict"),
            "endorsements": rows.where("kind = 'endorsements'").select("seq", "peer", "day", "line", M.endorsement_error("line").alias("verdict")),
            "envelopes": rows.where("kind = 'envelope'").select("sent"),
        }
        for store, part in stores.items():
            part.write.mode("overwrite").parquet(f"{folder}/{store}/run={run}/batch={number}")
            after(store)
    finally:
        rows.unpersist()


def fan_out(stream: DataFrame, folder: str, checkpoint: str, accepted: DataFrame, limits: M.Limits = M.Limits(), after: Callable[[str], None] = lambda store: None) -> None:  # noqa: B008
    """Admit all lines that the input now holds, a micro-batch at a time, and stop. The run is named by the query's id, which its checkpoint keeps."""

    def work(batch: DataFrame, number: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        fan_out_batch(batch, number, folder, run, accepted, limits, after)

    stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Write all outcomes that the input now allows to Parquet, and stop."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class _LatestBatches(StatefulProcessor):
    """Bytes of the stored batch of each peer and day, and of all; a batch that would make them exceed the cap is refused and what is stored stays."""

    def __init__(self, most_bytes: int):
        self.most_bytes = most_bytes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sizes = handle.getMapState("sizes", "peer string, day int", "bytes long, arrival long")
        self.total = handle.getValueState("total", "bytes long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        total = self.total.get()[0] if self.total.exists() else 0
        batch, outcomes = pd.concat(list(rows)).sort_values("arrival", kind="stable"), []
        for r in batch.itertuples():
            slot, size = (r.peer, int(r.day)), len(r.line.encode()) + 1
            old, at = self.sizes.getValue(slot) if self.sizes.containsKey(slot) else (0, -1)
            if at > r.arrival:
                outcomes.append("late")
            elif total - old + size > self.most_bytes:
                outcomes.append("over_cap")
            else:
                self.sizes.updateValue(slot, (size, int(r.arrival)))
                total += size - old
                outcomes.append("stored")
        self.total.update((total,))
        yield batch[["peer", "day", "arrival", "line"]].assign(outcome=outcomes, bytes=total)

    def close(self) -> None:
        pass


def latest_batches(batches: DataFrame, most_bytes: int = ENDORSEMENT_BYTES) -> DataFrame:
    """Batches (peer, day, arrival, line) with their outcome: stored, which replaces the one of the same peer and day, over_cap, or late (one of its day that arrived later is stored).

    The state holds a size a peer and day and is bounded by the cap of bytes; it does not grow with the batches."""
    keyed = batches.where("line IS NOT NULL AND peer IS NOT NULL AND day IS NOT NULL AND arrival IS NOT NULL").withColumn("gate", F.lit(0))
    return keyed.groupBy("gate").transformWithStateInPandas(_LatestBatches(most_bytes), "peer string, day int, arrival long, line string, outcome string, bytes long", "append", "None")


def newest_stored(outcomes: DataFrame) -> DataFrame:
    """The stored batch of each peer and day, of what latest_batches gave."""
    return outcomes.where("outcome = 'stored'").groupBy("peer", "day").agg(F.max_by(F.struct("arrival", "line"), "arrival").alias("b")).select("peer", "day", "b.arrival", "b.line")


class _OnChange(StatefulProcessor):
    """Digest of what was sent last, and the content that waits for its timer."""

    def __init__(self, wait_ms: int, most: int):
        self.wait_ms, self.most = wait_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sent = handle.getValueState("sent", "digest string")
        self.waiting = handle.getValueState("waiting", "content string, arrival long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        newest = batch.iloc[-1]
        self.waiting.update((newest["content"], int(newest["arrival"])))
        if not list(self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        content, arrival = self.waiting.get()
        digest = hashlib.sha256(content.encode()).hexdigest()
        if self.sent.exists() and self.sent.get()[0] == digest:
            return
        self.sent.update((digest,))
        entries = []
        for line in content.splitlines():
            try:
                v = json.loads(line)
            except ValueError:
                continue
            target, score = (v.get("target"), v.get("score")) if isinstance(v, dict) else (None, None)
            if isinstance(target, str) and target:
                entries.append((target, float(score) if isinstance(score, (int, float)) and not isinstance(score, bool) else 0.0))
            if len(entries) >= self.most:
                break
        if entries:
            yield pd.DataFrame({"file": [key[0]], "arrival": [arrival], "entries": [[{"target": t, "score": s} for t, s in entries]]})

    def close(self) -> None:
        pass


def on_change(contents: DataFrame, wait_ms: int = 60_000, most: int = ENTRIES) -> DataFrame:
    """Whole contents of files (file, arrival, content) as batches of endorsements: at most one a file and wait, and none where the content is what was sent last or has no entry.

    Lines that are no JSON object with a target are left out; an entry without a number as its score has 0; a batch holds the first `most` entries."""
    keyed = contents.where("content IS NOT NULL AND file IS NOT NULL AND arrival IS NOT NULL")
    return keyed.groupBy("file").transformWithStateInPandas(_OnChange(wait_ms, most), "file string, arrival long, entries array<struct<target:string,score:double>>", "append", "processingTime")
