"""Interval algebra on half-open ranges [start_ms, end_ms) per film."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def contains(start: str, end: str, t: str) -> Column:
    return (F.col(t) >= F.col(start)) & (F.col(t) < F.col(end))


def overlaps(a_start: str, a_end: str, b_start: str, b_end: str) -> Column:
    return (F.col(a_start) < F.col(b_end)) & (F.col(b_start) < F.col(a_end))


def confirmed(markers: DataFrame) -> DataFrame:
    """Markers that are confirmed and not empty."""
    return markers.where("status = 'confirmed' AND end_ms > start_ms")


def union(ranges: DataFrame, duration: int) -> DataFrame:
    """The ranges of each film, clamped to [0, duration), as disjoint ranges; those that touch become one."""
    clamped = ranges.select("film_id", F.greatest("start_ms", F.lit(0)).alias("start_ms"), F.least("end_ms", F.lit(duration)).alias("end_ms")).where("end_ms > start_ms")
    w = W.partitionBy("film_id").orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = clamped.withColumn("new", F.when(reach.isNull() | (F.col("start_ms") > reach), 1).otherwise(0)).withColumn("part", F.sum("new").over(w))
    return rows.groupBy("film_id", "part").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("part")


def complement(cuts: DataFrame, duration: int) -> DataFrame:
    """What disjoint cuts leave of [0, duration), per film that has cuts."""
    w = W.partitionBy("film_id").orderBy("start_ms")
    before = cuts.select("film_id", F.lag("end_ms", 1, 0).over(w).alias("start_ms"), F.col("start_ms").alias("end_ms"))
    after = cuts.groupBy("film_id").agg(F.max("end_ms").alias("start_ms")).withColumn("end_ms", F.lit(duration).cast("long"))
    return before.unionByName(after).where("end_ms > start_ms")


def bucketed(ranges: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """The ranges once for each bucket of the time axis that they touch, as column bucket.

    Joins with them are merge joins: Spark takes an exploded side for as small as its lists and would broadcast it."""
    return ranges.withColumn("bucket", F.explode(F.sequence(F.expr(f"{start} div {width}"), F.expr(f"greatest({start}, {end} - 1) div {width}")))).hint("merge")


def overlap_join(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """Pairs of overlapping ranges of a film, each once: columns of a, and b_start_ms, b_end_ms and b's others.

    An equal join on buckets; of the buckets that two ranges share, the first reports the pair."""
    right = b.withColumnRenamed("start_ms", "b_start_ms").withColumnRenamed("end_ms", "b_end_ms")
    left, right = bucketed(a, "start_ms", "end_ms", width), bucketed(right, "b_start_ms", "b_end_ms", width)
    first = F.greatest(F.expr(f"start_ms div {width}"), F.expr(f"b_start_ms div {width}"))
    return left.join(right, ["film_id", "bucket"]).where(overlaps("start_ms", "end_ms", "b_start_ms", "b_end_ms") & (F.col("bucket") == first)).drop("bucket")


def point_join(points: DataFrame, ranges: DataFrame, t: str, width: int) -> DataFrame:
    """Pairs of a point and a range of its film that holds it."""
    right = bucketed(ranges, "start_ms", "end_ms", width)
    return points.withColumn("bucket", F.expr(f"{t} div {width}")).join(right, ["film_id", "bucket"]).where(contains("start_ms", "end_ms", t)).drop("bucket")


def attribution(merged: DataFrame, markers: DataFrame, width: int) -> DataFrame:
    """Each merged cut with the one category of the confirmed markers that overlap it, or blank."""
    pairs = overlap_join(merged, confirmed(markers).select("film_id", "start_ms", "end_ms", "category"), width)
    named = pairs.groupBy("film_id", "start_ms", "end_ms").agg(F.count_distinct("category").alias("n"), F.min("category").alias("only"))
    return merged.join(named, ["film_id", "start_ms", "end_ms"], "left").select("film_id", "start_ms", "end_ms", F.when(F.col("n") == 1, F.col("only")).otherwise("").alias("category"))


def kept_before(keeps: DataFrame) -> DataFrame:
    """Keep segments with the kept time before each."""
    w = W.partitionBy("film_id").orderBy("start_ms")
    return keeps.withColumn("before_ms", F.sum(F.col("end_ms") - F.col("start_ms")).over(w.rowsBetween(W.unboundedPreceding, 0)) - (F.col("end_ms") - F.col("start_ms")))


def retime(subtitles: DataFrame, keeps: DataFrame, width: int) -> DataFrame:
    """Subtitles clipped to the keep segments and moved to the time of the cut film; an entry may be split."""
    pairs = overlap_join(subtitles, kept_before(keeps), width)
    start, end = F.greatest("start_ms", "b_start_ms"), F.least("end_ms", "b_end_ms")
    shift = F.col("before_ms") - F.col("b_start_ms")
    return pairs.select("film_id", "ord", (start + shift).alias("start_ms"), (end + shift).alias("end_ms"), "text")


def lead_in(cuts: DataFrame, lead_ms: int) -> DataFrame:
    """Cuts that begin lead_ms earlier, in ticks of 100 ns."""
    start = F.greatest(F.col("start_ms") - lead_ms, F.lit(0))
    return cuts.select("film_id", "start_ms", "end_ms", start.alias("lead_start_ms"), (start * 10_000).alias("start_ticks"), (F.col("end_ms") * 10_000).alias("end_ticks"))


def boundary_plan(keeps: DataFrame, keyframes: DataFrame, width: int) -> DataFrame:
    """Each keep segment as a rendered part up to its first keyframe and the original from there; without one it is all rendered."""
    hits = point_join(keyframes, keeps, "t_ms", width).groupBy("film_id", "start_ms", "end_ms").agg(F.min("t_ms").alias("k"))
    rows = keeps.join(hits, ["film_id", "start_ms", "end_ms"], "left").withColumn("k", F.coalesce("k", "end_ms"))
    parts = F.array(F.struct(F.lit("rendered").alias("kind"), F.col("start_ms").alias("s"), F.col("k").alias("e")), F.struct(F.lit("original").alias("kind"), F.col("k").alias("s"), F.col("end_ms").alias("e")))
    return rows.select("film_id", F.explode(F.filter(parts, lambda x: x["e"] > x["s"])).alias("p")).select("film_id", "p.kind", F.col("p.s").alias("start_ms"), F.col("p.e").alias("end_ms"))


def cut_at(positions: DataFrame, cuts: DataFrame, lead_ms: int, width: int) -> DataFrame:
    """The first cut that a position lies in, its lead-in included."""
    wide = cuts.select("film_id", F.greatest(F.col("start_ms") - lead_ms, F.lit(0)).alias("start_ms"), "end_ms", F.col("start_ms").alias("cut_start_ms"))
    pairs = point_join(positions, wide, "position_ms", width)
    return pairs.groupBy("film_id", "position_ms").agg(F.min(F.struct("cut_start_ms", "end_ms")).alias("c")).select("film_id", "position_ms", F.col("c.cut_start_ms").alias("cut_start_ms"), F.col("c.end_ms").alias("cut_end_ms"))


def skip_replay(cuts: DataFrame, lead_ms: int, guard_ms: int, step_ms: int, duration: int) -> DataFrame:
    """Jumps of a player that polls every step_ms and leaps to the end of a cut it is in, but not within guard_ms of the last leap.

    Each film's sorted cuts are folded once: the player meets a cut at the first poll in it that the guard allows."""
    lists = cuts.groupBy("film_id").agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms"))).alias("cuts"))
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit(-guard_ms).cast("long").alias("ready"), F.array().cast("array<struct<from_ms:bigint,to_ms:bigint>>").alias("jumps"))

    def fold(acc: Column, cut: Column) -> Column:
        meets = F.greatest(acc["at"], cut["start_ms"] - lead_ms, acc["ready"], F.lit(0))
        poll = acc["at"] + F.ceil((meets - acc["at"]) / step_ms) * step_ms
        jumped = F.struct(cut["end_ms"].alias("at"), (cut["end_ms"] + guard_ms).alias("ready"), F.array_append(acc["jumps"], F.struct(poll.alias("from_ms"), cut["end_ms"].alias("to_ms"))).alias("jumps"))
        return F.when((poll < cut["end_ms"]) & (poll < duration), jumped).otherwise(acc)

    jumps = F.aggregate("cuts", state, fold, lambda acc: acc["jumps"])
    return lists.select("film_id", F.explode(jumps).alias("j")).select("film_id", F.col("j.from_ms").alias("from_ms"), F.col("j.to_ms").alias("to_ms"))
