"""Mixing sources to target weights by balanced sampling with the cube method (operator 3).

A source's target over its size is the number of times that it is read on average: its whole part is taken of every
document, its fraction is the inclusion probability of one more reading. The cube method decides these: the flight phase
moves the probabilities of three documents at a time along the null space of the two balancing equations (tokens and documents) until each but
two is 0 or 1, by steps whose mean is nought; so the expected number of documents and tokens holds exactly at every step.
Flights run in blocks of a source, dealt by a hash; what the blocks leave (two documents each) flies again in fewer blocks,
until one is left of each source. The last two and ten that waited land together: of their 4096 outcomes the one nearest to the
mean words and documents is taken. So no task has more than about a block of documents, however large a source is.

Sizes are numbers of words, null text 0. Sources in code point order, null last, have the weights 1, 2, 3, repeating. No
target is above 3 times its source's size; what is cut off is shared anew by weight. Draws come from hashes of the source and block, so reruns
agree. Repeated rows are documents of their own. A source without words has target 0, an empty table gives an empty result. Extra columns play no
part.
"""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, is_small, scratch_scope, stored

WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3
BLOCK = 20_000
SURE = 1e-9
#: Documents of each source that wait for the landing, so that its outcomes can come near the target.
WAITING = 10


def word_count(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def targets(sizes: DataFrame, most: float = MOST) -> DataFrame:
    """Of each source: source, source_size, documents, target. sizes: source, size."""
    stats = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    every = W.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), ((F.row_number().over(every) - 1) % len(WEIGHTS) + 1).cast("int"))
    stats = stats.withColumn("weight", weight)
    # Sources reach their limits in the order of limit / weight; the level at which the rest share what is left by weight.
    by_limit = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_limit.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    open_ = level * F.col("weight") < most * F.col("source_size")
    limit = F.col("source_size") / F.col("weight")
    stats = stats.withColumn("level", level).withColumn("rank", F.struct(limit, F.col("source").isNull(), "source"))
    open_ = F.col("level") * F.col("weight") < most * F.col("source_size")
    final = F.min_by(F.when(open_, F.col("level")), F.when(open_, F.col("rank"))).over(whole)
    share = F.least(final * F.col("weight"), (most * F.col("source_size")).cast("double"))
    return stats.withColumn("target", F.coalesce(share, F.lit(0.0))).select("source", "source_size", "documents", "target")


def flight(p: np.ndarray, size: np.ndarray, draws: np.random.Generator) -> np.ndarray:
    """Move the probabilities p until at most two are neither 0 nor 1; sums of p and of p * size stay."""
    p = p.copy()
    u = draws.random(len(p) + 3)
    held: list[int] = []
    step = 0
    values, sizes = p.tolist(), size.tolist()
    for i in range(len(values)):
        if not SURE < values[i] < 1 - SURE:
            continue
        held.append(i)
        while len(held) == 3:
            a, b, c = held
            x, y, z = sizes[a], sizes[b], sizes[c]
            v = (y - z, z - x, x - y)  # sums to nought, as does its product with the sizes
            if not any(v):
                v = (1.0, -1.0, 0.0)
            up = down = float("inf")
            for k, d in zip(held, v, strict=True):
                if d > 0:
                    up, down = min(up, (1 - values[k]) / d), min(down, values[k] / d)
                elif d < 0:
                    up, down = min(up, values[k] / -d), min(down, (1 - values[k]) / -d)
            move = up if u[step] * (up + down) < down else -down
            step += 1
            for k, d in zip(held, v, strict=True):
                values[k] += move * d
                if values[k] <= SURE:
                    values[k] = 0.0
                elif values[k] >= 1 - SURE:
                    values[k] = 1.0
            held = [k for k in held if 0 < values[k] < 1]
            if step >= len(u):
                u, step = draws.random(len(p) + 3), 0
    return np.array(values)


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Settle the few documents that are still open: of all outcomes, the one whose words and documents come nearest to their means."""
    p = p.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    if len(left):
        options = (np.arange(2 ** len(left))[:, None] >> np.arange(len(left))) & 1
        off = np.abs(options @ size[left] - p[left] @ size[left]) + np.abs(options.sum(axis=1) - p[left].sum())
        p[left] = options[int(off.argmin())]
    return p


def _fly(level: int, last: bool = False):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "key"], kind="stable")
        draws = np.random.default_rng(zlib.crc32(repr((key[0], int(key[1]), level)).encode()))
        size, p, held = rows["size"].to_numpy(np.float64), rows["p"].to_numpy(np.float64).copy(), rows["held"].to_numpy(bool).copy()
        if level == 0 and key[1] == 0:  # a few of the first block wait for the landing
            held[np.flatnonzero((p > SURE) & (p < 1 - SURE))[:WAITING]] = True
        p[~held] = flight(p[~held], size[~held], draws)
        return rows.assign(p=landing(p, size) if last else p, held=held)

    return run


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each row of docs as doc_id, size, source_size, target, taken, copies."""
    return _mixed(docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "source", "text"), block).drop("key")


def _mixed(rows: DataFrame, block: int) -> DataFrame:
    """key, doc_id, size, source_size, target, taken, copies of rows (key, doc_id, source, text)."""
    with scratch_scope(rows.sparkSession):
        return stored(_decided(rows, block), "mixed", keep=True)


def _decided(rows: DataFrame, block: int) -> DataFrame:
    # equal rows are alike, so that the order of draws is the same in every run
    sizes = stored(rows.select("key", F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("order")), "sizes")
    goals = stored(targets(sizes), "targets")
    rows = sizes.join(F.broadcast(goals), sizes["source"].eqNullSafe(goals["source"])).drop(goals["source"]) if is_small(goals.count(), 200) else sizes.join(goals, sizes["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(ratio + SURE)).withColumn("p", F.greatest(ratio - F.col("whole"), F.lit(0.0)))
    rows = rows.withColumn("block", F.pmod("order", F.ceil(F.col("documents") / block)))
    kept = "key long, doc_id long, source string, size long, source_size long, target double, whole long, p double, order long, block long, held boolean"
    rows = rows.select("key", "doc_id", "source", "size", "source_size", "target", "whole", "p", "order", "block", F.lit(False).alias("held"))
    flown = stored(rows.groupBy("source", "block").applyInPandas(_fly(0), kept), "flown")
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    done, flying, level = flown.where(~open_), flown.where(open_), 1
    most = goals.agg(F.max("documents")).first()[0] or 0
    while (most := 2 * math.ceil(most / block)) > block:  # documents that a source's blocks leave, at most
        flown = flying.withColumn("block", F.pmod("order", F.lit(math.ceil(most / block)))).groupBy("source", "block").applyInPandas(_fly(level), kept)
        flown, level = stored(flown, "flown"), level + 1
        done, flying = done.unionByName(flown.where(~open_)), flown.where(open_)
    done = done.unionByName(flying.withColumn("block", F.lit(-1).cast("long")).groupBy("source", "block").applyInPandas(_fly(level, last=True), kept))
    copies = F.col("whole") + F.col("p").cast("long")
    return done.select("key", "doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def mixed_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs as the mix reads them: rows as often as they are taken, with all their columns."""
    me, times = (f"_{uuid.uuid4().hex}" for _ in range(2))
    counts = docs.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if counts["rows"] == counts["ids"]:
        rows = docs.withColumn(me, F.col("doc_id").cast("long"))
    else:
        rows = stored(docs.withColumn(me, F.monotonically_increasing_id()), "rows")
    taken = _mixed(rows.select(F.col(me).alias("key"), "doc_id", "source", "text"), block).where("copies > 0").select(F.col("key").alias(me), F.col("copies").alias(times))
    out = rows.join(F.broadcast(taken) if is_small(counts["rows"], 48) else taken, me)
    return out.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*[f"`{c}`" for c in docs.columns])
