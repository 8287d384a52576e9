"""Trust: clamped folds over decisions, damped walks over endorsements, effective weights."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written

START, REWARD, PENALTY, TOP = 0.1, 0.05, 0.08, 2.0
PUBLISH, CEILING, DAMPING, DEPTH = 0.8, 0.4, 0.5, 4


def fold(decisions: DataFrame, bootstrap: DataFrame | None = None) -> DataFrame:
    """author, score, n: decisions in order of seq, each clamped to [0, 2]; the first starts from 0.1, or what the graph gives, at most 0.4."""
    lists = decisions.groupBy("author").agg(F.array_sort(F.collect_list(F.struct("seq", "accepted"))).alias("d"))
    if bootstrap is not None:
        lists = lists.join(bootstrap, "author", "left")
    first = F.least(F.lit(CEILING), START + (F.coalesce("bootstrap", F.lit(0.0)) if bootstrap is not None else F.lit(0.0)))

    def step(acc: Column, x: Column) -> Column:
        return F.least(F.greatest(acc + F.when(x["accepted"], REWARD).otherwise(-PENALTY), F.lit(0.0)), F.lit(TOP))

    return lists.select("author", F.round(F.aggregate("d", first, step), 6).alias("score"), F.size("d").cast("long").alias("n"))


def paths(direct: DataFrame, edges: DataFrame) -> DataFrame:
    """All simple paths of at most DEPTH edges from a trusted author, the last edge of which may end anywhere: author (the end), via (the endorsing authors on the way, the first being the trusted one), part (0.5 ** depth x its score x the edges' scores).

    Paths grow one edge a step, so that each step is a join on the endorsed author."""
    seeds = direct.where((F.col("n") > 0) & (F.col("score") >= PUBLISH)).select(F.col("author").alias("at"), F.col("score").alias("value"), F.array("author").alias("via"))
    now, total = seeds, None
    for depth in range(1, DEPTH + 1):
        step = now.join(edges.withColumnRenamed("author", "at").withColumnRenamed("score", "edge"), "at")
        step = step.withColumn("value", F.col("value") * F.col("edge"))
        given = step.select(F.col("target").alias("author"), "via", (F.col("value") * DAMPING**depth).cast("decimal(28,15)").alias("part"))
        total = given if total is None else total.unionByName(given)
        now = step.where(~F.array_contains("via", F.col("target"))).select(F.col("target").alias("at"), "value", F.concat("via", F.array("target")).alias("via"))
    return total


def bootstrap(direct: DataFrame, edges: DataFrame) -> DataFrame:
    """author, bootstrap: what all paths to an author give it."""
    return paths(direct, edges).groupBy("author").agg(F.sum("part").cast("double").alias("bootstrap"))


def effective(authors: DataFrame, direct: DataFrame, boot: DataFrame) -> DataFrame:
    """The weight of each author: its own score once it has decisions, else 0.1 + what the graph gives, in [0.1, 0.4]."""
    rows = authors.join(direct, "author", "left").join(boot, "author", "left")
    given = F.least(F.greatest(START + F.coalesce("bootstrap", F.lit(0.0)), F.lit(START)), F.lit(CEILING))
    return rows.select("author", F.round(F.when(F.col("n") > 0, F.col("score")).otherwise(given), 6).alias("weight"))


def outbound(direct: DataFrame, most: int = 50) -> DataFrame:
    """The best `most` authors at or over the publishing cutoff."""
    ranked = direct.where((F.col("n") > 0) & (F.col("score") >= PUBLISH)).orderBy(F.desc("score"), "author").limit(most)
    return ranked.select(F.col("author").alias("target"), "score")


def latest(batches: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the last row by order."""
    w = W.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return batches.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def running_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """df with the sum of value up to each row in an order of unique keys. Rows are dealt in ranges; each range is summed by itself, from what the ranges before it hold. Nulls come first."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = {r["_range"]: r["s"] or 0 for r in dealt.groupBy("_range").agg(F.sum(value).alias("s")).collect()}  # a row a range
    before, total = [], 0
    for k in sorted(sums):
        before.append((k, total))
        total += sums[k]
    starts = df.sparkSession.createDataFrame(before, "_range int, _before long")
    w = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return dealt.join(F.broadcast(starts), "_range").withColumn(name, F.col("_before") + F.sum(value).over(w)).drop("_range", "_before")


def evict(edges: DataFrame, direct: DataFrame, most: int, small: int = 200_000) -> DataFrame:
    """Endorsements (author, target, score) that stay when, until `most` are left, the author of the lowest weight goes, whole, the smallest author of equals; weights are taken anew after each, as those endorsed by way of it lose what it gave.

    All paths are found once; an author that goes takes those paths with it that lead through it, so weights only fall. Up to `small` authors and steps of paths, as counted, one task does that in order with a heap. Beyond,
    it is done in rounds: some authors of the lowest weights are tried together, and of them those go at once that are no higher than what any weight would fall to with all of them gone; an author alone can
    always go. A round is a few joins; no task sorts all authors.

    Nulls: rows with a null author or target are left out; a null score gives nothing."""
    edges = edges.where("author IS NOT NULL AND target IS NOT NULL")
    scores = direct.where("n > 0").select("author", F.col("score").alias("fixed"))
    left = written(edges.groupBy("author").agg(F.count(F.lit(1)).alias("n")).join(scores, "author", "left"), "endorsers")
    ways = paths(direct, edges.withColumn("score", F.coalesce("score", F.lit(0.0)))).join(left.where("fixed IS NULL").select("author"), "author", "left_semi")
    ways = written(ways.withColumn("way", F.monotonically_increasing_id()), "ways")
    sizes = left.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("authors")).first()
    steps = ways.agg(F.sum(F.size("via")).alias("n")).first()["n"] or 0
    over = (sizes["n"] or 0) - most
    if sizes["authors"] + steps <= small:
        kind = dict(edges.dtypes)["author"]
        rows = left.select("author", "n", "fixed", F.lit(None).cast(f"array<{kind}>").alias("via"), F.lit(None).cast("decimal(28,15)").alias("part"))
        rows = rows.unionByName(ways.select("author", F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("fixed"), "via", "part"))
        gone = rows.repartition(1).mapInArrow(_in_order(over), f"author {kind}")
        return edges.join(written(gone, "gone"), "author", "left_anti")

    def weighed(rows: DataFrame, ways: DataFrame, name: str = "weight") -> DataFrame:
        given = ways.groupBy("author").agg(F.sum("part").cast("double").alias("given"))
        boot = F.least(F.greatest(START + F.coalesce("given", F.lit(0.0)), F.lit(START)), F.lit(CEILING))
        return rows.join(given, "author", "left").withColumn(name, F.round(F.coalesce("fixed", boot), 9)).drop("given")

    def without(ways: DataFrame, gone: DataFrame) -> DataFrame:
        lost = ways.select("way", F.explode("via").alias("author")).join(gone.select("author"), "author", "left_semi").select("way").distinct()
        return ways.join(lost, "way", "left_anti")

    while over > 0:
        ranked = written(running_sum(weighed(left, ways), ["weight", "author"], "n", "upto"), "ranked")
        tried = ranked.where(F.col("upto") <= over)
        fallen = weighed(ranked, without(ways, tried), "then").where("then < weight").agg(F.min(F.struct("then", "author")).alias("m")).first()["m"]
        gone = tried if fallen is None else tried.where((F.col("weight") < fallen["then"]) | ((F.col("weight") == fallen["then"]) & (F.col("author") <= F.lit(fallen["author"]))))
        gone = written(gone.select("author", "n"), "gone")
        n = gone.agg(F.sum("n").alias("n")).first()["n"]
        if not n:
            gone = written(ranked.orderBy("weight", "author").limit(1).select("author", "n"), "gone")
            n = gone.first()["n"]
        over -= n
        left, ways = written(left.join(gone.select("author"), "author", "left_anti"), "endorsers"), written(without(ways, gone), "ways")
    return edges.join(left.select("author"), "author", "left_semi")


def _in_order(over: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of authors (author, n, fixed) and paths (author, via, part), those authors that go, one after the other, until `over` endorsements are gone."""
    unit = 10**15

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, fixed, given, leads, ways, kind, left = {}, {}, {}, {}, [], None, over
        for batch in batches:
            kind = batch.schema.field("author").type
            for r in batch.to_pylist():
                if r["via"] is None:
                    sizes[r["author"]], fixed[r["author"]] = r["n"], r["fixed"]
                else:
                    part = int(r["part"] * unit)
                    for node in r["via"]:
                        leads.setdefault(node, []).append(len(ways))
                    ways.append((r["author"], part))
                    given[r["author"]] = given.get(r["author"], 0) + part
        if kind is None:
            return

        def weight(author):
            return round(fixed[author] if fixed[author] is not None else min(max(START + given.get(author, 0) / unit, START), CEILING), 9)

        heap = [(weight(a), a) for a in sizes]
        heapq.heapify(heap)
        alive, out = [True] * len(ways), []
        while left > 0 and heap:
            w, author = heapq.heappop(heap)
            if author not in sizes or w != weight(author):
                continue
            left -= sizes.pop(author)
            out.append(author)
            for k in leads.get(author, ()):
                target, part = ways[k]
                if alive[k]:
                    alive[k] = False
                    given[target] -= part
                    if target in sizes:
                        heapq.heappush(heap, (weight(target), target))
        yield pa.record_batch([pa.array(out, kind)], names=["author"])

    return run
