"""Exact deduplication by a streaming query with keyed state (operator 7).

Every row gives a key (digest of the normalised text), a stable identifier and a content locator. A streaming
aggregation keeps, per digest, the best row seen so far and how many rows came; its state lives in RocksDB on the
executors' disks, is checkpointed to the shared folder, and never expires. The stream runs until its input is used up
(availableNow). With a folder of its own (state_dir) the keys, the state and its updates outlive the call: a later call with that folder adds
its rows to the keys, and the stream goes on where it stopped. Rows whose digest was hit more than
once are compared byte by byte with the row that stays; digests that hold different texts are split by the text.

The comparison sends each kept text once to its digest's rows: by a broadcast where the counted bytes allow, else by a
join on the digest and a number that deals the rows of large groups to several tasks.

Nulls: a null text counts as empty; a null doc_id is a row like others, and ranks last. Repeated rows are copies:
exactly one row of each group has kept = true. An empty table gives an empty result. Extra columns play no part.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, LEAN, drop_scratch, is_small, scratch_path, scratch_scope, settings, stored, without_white_space

#: State in RocksDB, which does not reserve disk ahead of its use and leaves memory with its task: there may be thousands of small stores.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: Rows of one group that are compared with its kept text in one task, about.
SALT_ROWS = 2000
UPDATES = "digest binary, best struct<n_code_points:long,minus_id:long,rank_row:string,doc_id:long,row_id:string,locator:string>, group_size long, batch long"


def _body() -> Column:
    return without_white_space(F.col("text"))


def _keys(docs: DataFrame, digest_chars: int, run: str) -> DataFrame:
    sha = F.sha2(_body(), 256)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(sha).alias("sha"),
        F.unhex(F.substring(sha, 1, digest_chars)).alias("digest"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_code_points"),
        F.input_file_name().alias("locator"),
    ).withColumn("row_id", F.concat(F.lit(run), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0")))


def _better() -> Column:
    """Rank of a row in its group, the highest stays: more code points, smaller doc_id; of rows repeated whole any one, always the same."""
    return F.struct(F.col("n_code_points"), (-F.col("doc_id")).alias("minus_id"), F.col("row_id").alias("rank_row"), F.col("doc_id"), F.col("row_id"), F.col("locator"))


def _stream_groups(spark: SparkSession, keys_path: str, keys: DataFrame, files_per_batch: int, out: str, state: str) -> None:
    """Run the stateful stream over new keys; it writes its updates to out, one row per batch and touched digest."""
    groups = (
        spark.readStream.schema(keys.schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(keys_path)
        .groupBy("digest")
        .agg(F.max(_better()).alias("best"), F.count(F.lit(1)).alias("group_size"))
    )

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/n={number}")

    with settings(spark, {**STATE, **LEAN}):
        groups.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(save).start().awaitTermination()


def exact_groups(docs: DataFrame, digest_chars: int = 64, files_per_batch: int = 4096, state_dir: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, keep_locator.

    Texts are equal when identical without white space; of equal ones the row with the most code points, then the smallest
    doc_id, stays. digest_chars: even number of hex digits of the digest that keys the state (fewer only to test
    collisions). files_per_batch: files of keys in a micro-batch. state_dir: a shared folder in which keys and state stay; the result then tells of the rows of
    earlier calls as well, whose digests are trusted, while full bytes are compared among docs."""
    spark = docs.sparkSession
    keys_path = f"{state_dir}/keys" if state_dir else scratch_path(spark, "dedup-keys")
    out, state = (f"{state_dir}/updates", f"{state_dir}/state") if state_dir else (scratch_path(spark, "dedup-updates"), scratch_path(spark, "dedup-state"))
    made = _keys(docs, digest_chars, uuid.uuid4().hex[:8] if state_dir else "")
    made.write.mode("append").parquet(keys_path)
    keys = spark.read.schema(made.schema).parquet(keys_path)
    empty = not keys.limit(1).count()
    if not empty:  # an empty input makes no batch and so no folder
        _stream_groups(spark, keys_path, keys, files_per_batch, out, state)
    if not state_dir:
        drop_scratch(spark, state)
    written = spark.createDataFrame([], UPDATES) if empty else spark.read.schema(UPDATES).parquet(f"{out}/n=*")
    groups = written.groupBy("digest").agg(F.max_by(F.struct("best", "group_size"), "batch").alias("g")).select("digest", F.col("g.best").alias("best"), F.col("g.group_size").alias("group_size"))
    groups = stored(groups, "dedup-groups")  # read twice, and a join with a table splits large groups where one with an aggregate can't
    clashes = _clashes(docs, groups, digest_chars)

    columns = ["doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "keep_locator"]
    chosen = [F.col("best.doc_id").alias("keep_id"), F.col("best.row_id").alias("keep_row"), F.col("best.locator").alias("keep_locator"), "group_size"]
    best = groups.select("digest", *chosen)
    if clashes is None:
        return keys.join(best, "digest").select(*columns)
    plain = keys.join(best, "digest").join(clashes, "digest", "left_anti").select(*columns)
    # different texts under one digest: their full digests part them, as the digest that keys the state is a prefix
    mixed = keys.join(clashes, "digest", "left_semi")
    parts = mixed.groupBy("digest", "sha").agg(F.max(_better()).alias("best"), F.count(F.lit(1)).alias("group_size")).select("digest", "sha", *chosen)
    return plain.unionByName(mixed.join(parts, ["digest", "sha"]).select(*columns))


def _clashes(docs: DataFrame, groups: DataFrame, digest_chars: int) -> DataFrame | None:
    """Digests under which the full bytes differ from those of the row that stays; None if there are none."""
    hits = groups.where("group_size > 1").select("digest", F.col("best.doc_id").alias("keep_id"), F.ceil(F.col("group_size") / SALT_ROWS).cast("int").alias("salts"), F.col("best.n_code_points").alias("points"))
    counts = hits.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("points"), F.lit(0)).alias("points")).first()
    if not counts["n"]:
        return None
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _body().alias("body")).withColumn("digest", F.unhex(F.substring(F.sha2("body", 256), 1, digest_chars)))
    texts = texts.join(F.broadcast(hits) if is_small(counts["n"], 64) else hits, "digest")
    kept = texts.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "salts").agg(F.max("body").alias("kept_body"))
    if 4 * counts["points"] <= BROADCAST_BYTES:
        both = texts.select("digest", "body").join(F.broadcast(kept.select("digest", "kept_body")), "digest")
    else:
        kept = kept.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        salted = texts.select("digest", "body", F.pmod(F.monotonically_increasing_id(), F.col("salts")).cast("int").alias("salt"))
        both = salted.join(kept.select("digest", "salt", "kept_body"), ["digest", "salt"])
    clashes = stored(both.where(F.col("body") != F.col("kept_body")).select("digest").distinct(), "clashes")
    return clashes if clashes.limit(1).count() else None


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows with equal doc_id and text, one."""
    spark = docs.sparkSession
    me, digest, again = (f"_{uuid.uuid4().hex}" for _ in range(3))
    with scratch_scope(spark):
        gone = exact_groups(docs).where(~F.col("kept"))
        gone = stored(gone.select(F.col("doc_id").alias(me), F.col("text_sha256").alias(digest), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias(again)), "dedup-dropped", keep=True)
    counts = gone.agg(F.count(F.lit(1)), F.count_if(again)).first()
    sha = F.sha2(_body(), 256)
    others = gone.where(~F.col(again)).select(me, digest).distinct()
    out = docs.join(F.broadcast(others) if is_small(counts[0], 100) else others, docs["doc_id"].cast("long").eqNullSafe(others[me]) & (sha == others[digest]), "left_anti")
    if counts[1]:
        out = out.withColumn(digest, sha).dropDuplicates(["doc_id", digest]).drop(digest)
    return out
