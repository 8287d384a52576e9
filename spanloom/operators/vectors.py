"""Vector similarity: prompts, feedback neighbours, score factors, content digests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_arrow_batches

#: A block of vectors has at most so many rows and bytes; a part of the searched side has about PART_ROWS rows.
BLOCK_ROWS, BLOCK_BYTES, PART_ROWS = 2048, 1 << 20, 8192
#: Rows of a block that are multiplied at once.
STRIP = 256


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, summed in element order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / norm)


def blocks(rows: DataFrame) -> DataFrame:
    """Rows as blocks, one row each: width, the columns but vec as arrays, m (their vectors as one matrix of doubles). A block's vectors are of one width; rows whose vector is null or holds a null are left out."""
    kept = [c for c in rows.columns if c != "vec"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.asarray(pc.list_value_length(batch.column("vec")))
            for width in np.unique(widths):
                places, step = np.flatnonzero(widths == width), max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, int(width)))))
                for k in range(0, len(places), step):
                    some = batch.take(pa.array(places[k : k + step]))
                    matrix = np.asarray(some.column("vec").flatten()).astype("<f8")
                    edges = pa.array([0, some.num_rows], pa.int32())
                    yield pa.record_batch([pa.array([width], pa.int32()), *(pa.ListArray.from_arrays(edges, some.column(c)) for c in kept), pa.array([matrix.tobytes()], pa.binary())], names=["width", *kept, "m"])

    types = dict(rows.dtypes)
    small_arrow_batches(rows.sparkSession)
    return rows.where("vec IS NOT NULL AND forall(vec, x -> x IS NOT NULL)").mapInArrow(pack, ", ".join(["width int", *(f"{c} array<{types[c]}>" for c in kept), "m binary"]))


def block_pairs(queries: DataFrame, searched: DataFrame, work: Callable[[pa.StructScalar, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """work(arrays, query vectors, searched vectors) of each block of queries with each block of searched that has vectors of its width.

    The searched side is dealt in parts; a query block goes to each part once. Where parts are few, shares of the query blocks go to tasks of their own, each with a copy of the part. So no side is broadcast and no task holds one whole."""
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = 1 + searched.count() // PART_ROWS
    shares = max(1, 2 * tasks // parts)
    left = blocks(queries).withColumnRenamed("m", "qm").withColumn("share", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shares)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = blocks(searched.repartition(parts)).withColumn("part", F.spark_partition_id()).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    pairs = left.join(right.hint("shuffle_hash"), ["part", "share", "width"]).drop("part", "share")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_struct_array():
                width = row["width"].as_py()
                yield from work(row, np.frombuffer(row["qm"].as_py()).reshape(-1, width), np.frombuffer(row["m"].as_py()).reshape(-1, width))

    return pairs.mapInArrow(run, schema)


def nearest(frames: DataFrame, decided: DataFrame) -> DataFrame:
    """Of each frame and kind of decision the most similar feedback row; ties go to the smallest row_id. Only vectors of equal length are compared."""

    def search(row: pa.StructScalar, vectors: np.ndarray, against: np.ndarray) -> Iterator[pa.RecordBatch]:
        t, ids, flags = row["t"].values, np.asarray(row["row_id"].values), np.array(row["accepted"].values.to_pylist(), object)
        order = np.argsort(ids)
        for side in (True, False, None):
            of_side = order[flags[order] == side]
            if not len(of_side):
                continue
            other = against[of_side].T
            for k in range(0, len(vectors), STRIP):
                sims = np.round(vectors[k : k + STRIP] @ other, 6) + 0.0
                first = sims.argmax(axis=1)
                yield pa.record_batch([t[k : k + STRIP], pa.array([side] * len(first), pa.bool_()), pa.array(ids[of_side[first]]), pa.array(sims[np.arange(len(first)), first])], names=["t", "accepted", "row_id", "sim"])

    types = dict(frames.dtypes) | dict(decided.dtypes)
    best = block_pairs(frames.select("t", "vec"), decided.select("row_id", "accepted", "vec"), search, f"t {types['t']}, accepted boolean, row_id {types['row_id']}, sim double")
    best = best.groupBy("t", "accepted").agg(F.max(F.struct("sim", (-F.col("row_id")).alias("m"))).alias("b"))
    return best.select("t", "accepted", (-F.col("b.m")).alias("row_id"), F.col("b.sim").alias("sim"))


def factors(best: DataFrame, trigger: float, weight: float = 1.0, reject: float = 0.5, accept: float = 1.15) -> DataFrame:
    """The factor of each frame: 1 + w (target - 1) for each side whose best row is at or over the trigger; w is that row's weight where best has one, else `weight`, between 0 and 1."""
    w = F.least(F.greatest(F.col("weight") if "weight" in best.columns else F.lit(weight), F.lit(0.0)), F.lit(1.0))
    one = F.when(F.col("sim") >= trigger, 1 + w * (F.when(F.col("accepted"), accept).otherwise(reject) - 1)).otherwise(1.0)
    sides = best.withColumn("f", one).groupBy("t").agg(F.max(F.when(F.col("accepted"), F.col("f"))).alias("a"), F.max(F.when(~F.col("accepted"), F.col("f"))).alias("r"))
    return sides.select("t", F.round(F.coalesce("a", F.lit(1.0)) * F.coalesce("r", F.lit(1.0)), 6).alias("factor"))


def weighted_scores(scores: DataFrame, frames: DataFrame, decided: DataFrame, weights: DataFrame, trigger: float) -> DataFrame:
    """Scores (t, prompt, score) times their frame's factor, between 0 and 1. A side's factor is moved by the weight (row_id, weight) of the one row that is most similar; rows without a weight play no part."""
    best = nearest(frames, decided.join(weights.select("row_id"), "row_id", "left_semi")).join(weights.select("row_id", "weight"), "row_id")
    by_frame = factors(best, trigger)
    return scores.join(by_frame, "t", "left").select("t", "prompt", F.round(F.least(F.greatest(F.col("score") * F.coalesce("factor", F.lit(1.0)), F.lit(0.0)), F.lit(1.0)), 6).alias("score"))


def prompt_scores(frames: DataFrame, prompts: DataFrame) -> DataFrame:
    """Similarity of every frame and prompt as a score: (cosine - 0.15) / 0.2, between 0 and 1. Only vectors of equal length are compared."""

    def score(row: pa.StructScalar, vectors: np.ndarray, against: np.ndarray) -> Iterator[pa.RecordBatch]:
        t, names = row["t"].values, row["prompt"].values
        for k in range(0, len(vectors), STRIP):
            scores = np.round(np.clip((vectors[k : k + STRIP] @ against.T - 0.15) / 0.2, 0.0, 1.0), 6) + 0.0
            n, m = scores.shape
            yield pa.record_batch([t.take(pa.array(np.repeat(np.arange(k, k + n), m))), names.take(pa.array(np.tile(np.arange(m), n))), pa.array(scores.reshape(-1))], names=["t", "prompt", "score"])

    return block_pairs(frames.select("t", "vec"), prompts.select("prompt", "vec"), score, f"t {dict(frames.dtypes)['t']}, prompt string, score double")


def quantised_digest(vec: Column) -> Column:
    """SHA-256, as hex, of the vector's values times 10,000, rounded and written as 32-bit integers, least byte first: equal for vectors that differ by less than the rounding."""

    def four_bytes(x: Column) -> Column:
        q = F.round(x.cast("float") * F.lit(10000.0).cast("float")).cast("long")
        turned = F.shiftleft(q.bitwiseAND(0xFF), 24) + F.shiftleft(F.shiftright(q, 8).bitwiseAND(0xFF), 16) + F.shiftleft(F.shiftright(q, 16).bitwiseAND(0xFF), 8) + F.shiftright(q, 24).bitwiseAND(0xFF)
        return F.lpad(F.hex(turned), 8, "0")

    return F.sha2(F.unhex(F.array_join(F.transform(vec, four_bytes), "")), 256)


def shape_error(score: Column, vec: Column, category: Column, dims: tuple[int, ...] = (64, 512, 768, 1024)) -> Column:
    """The first rule that a feedback row breaks, or `ok`."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.coalesce(
        F.when(~F.coalesce(F.length(category).between(1, 64) & category.rlike("^[A-Za-z0-9 /.-]+$"), F.lit(False)), "category"),
        F.when(~F.coalesce(score.between(0, 1), F.lit(False)), "score"),
        F.when(~F.coalesce(F.size(vec).isin(*dims), F.lit(False)), "dimension"),
        F.when(~F.forall(vec, lambda x: F.coalesce(F.abs(x) <= 1.5, F.lit(False))), "value"),
        F.when(F.abs(norm - 1) > 0.05, "norm"),
        F.lit("ok"),
    )
