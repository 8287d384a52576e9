"""Score series: detectors to series, fusion, threshold runs, suggestions.

Series are long tables (film_id, series_key, idx, value); a tick without a row is 0, so that sparse series stay sparse. Recipes are small and come
as rows (category, enabled, threshold, pads, det_ord, det_id, weight, label); Spark broadcasts them by their size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def detector_series(recipes: DataFrame, series: DataFrame) -> DataFrame:
    """Rows of the series that each detector of an enabled category reads: by its own key if the film has it, else by its labels."""
    enabled = recipes.where("enabled").select("category", "det_ord", "det_id", "weight", "label")
    direct = enabled.withColumn("key", F.col("det_id")).withColumn("kind", F.lit(0)).drop("label").distinct().withColumn("label", F.lit(None).cast("string"))
    labelled = enabled.where("label IS NOT NULL").withColumn("key", F.concat_ws(".", "det_id", "label")).withColumn("kind", F.lit(1))
    keys = direct.unionByName(labelled)
    found = series.join(F.broadcast(keys), series["series_key"] == keys["key"])
    first = F.min("kind").over(W.partitionBy("film_id", "category", "det_ord"))
    return found.withColumn("first", first).where("kind = first").select("film_id", "category", "det_ord", "weight", "label", "idx", "value")


def label_or(rows: DataFrame) -> DataFrame:
    """The largest value over the labels of a detector, per tick."""
    return rows.groupBy("film_id", "category", "det_ord", "weight", "idx").agg(F.max("value").alias("value"))


def fuse(rows: DataFrame) -> DataFrame:
    """Weighted sum over the detectors of a category, at most 1. Sums are exact in decimals, whatever the order."""
    term = (F.col("weight") * F.col("value")).cast("decimal(20,12)")
    return label_or(rows).groupBy("film_id", "category", "idx").agg(F.least(F.lit(1.0), F.sum(term).cast("double")).alias("fused"))


def resample(series: DataFrame, src_ms: int, dst_ms: int, ticks: int) -> DataFrame:
    """The series on another grid: tick i reads the source's tick floor(i * dst / src), the last one beyond its end.

    Each row gives the ticks from its own to the next row's, the first also those before it and the last those after it, so that what is shuffled is the series and not the grid."""
    w = W.partitionBy("film_id", "series_key").orderBy("idx")
    rows = series.select("film_id", "series_key", F.col("idx").alias("src"), "value", (F.row_number().over(w) == 1).alias("first"), F.lead("idx").over(w).alias("next"))
    from_ = lambda c: F.expr(f"greatest(0L, ({c} * {src_ms} + {dst_ms - 1}) div {dst_ms})")
    begin = F.when(F.col("first"), F.lit(0).cast("long")).otherwise(from_("src"))
    end = F.least(F.when(F.col("next").isNotNull(), from_("next")), F.lit(ticks).cast("long"))
    each = rows.withColumn("end", end).withColumn("begin", begin).where("begin < end").withColumn("idx", F.explode(F.sequence(F.col("begin"), F.col("end") - 1)))
    at = F.expr(f"(idx * {dst_ms}) div {src_ms}")
    held = (at == F.col("src")) | (F.col("next").isNull() & (at > F.col("src")))
    return each.select("film_id", "series_key", "idx", F.when(held & F.col("film_id").isNotNull() & F.col("series_key").isNotNull(), F.coalesce("value", F.lit(0.0))).otherwise(0.0).alias("value"))


def runs(fused: DataFrame, recipes: DataFrame, period_ms: int, ticks: int) -> DataFrame:
    """Padded runs of consecutive ticks at or above the category's threshold; runs longer than its maximum are dropped."""
    rules = recipes.where("enabled").select("category", "threshold", "pad_before_ms", "pad_after_ms", "max_duration_ms").distinct()
    above = fused.join(F.broadcast(rules), "category").where("fused >= threshold")
    island = F.col("idx") - F.row_number().over(W.partitionBy("film_id", "category").orderBy("idx"))
    rows = above.withColumn("island", island).groupBy("film_id", "category", "island").agg(
        F.min("idx").alias("i"), (F.max("idx") + 1).alias("j"), F.round(F.max("fused"), 3).alias("score"), *(F.first(c).alias(c) for c in ("pad_before_ms", "pad_after_ms", "max_duration_ms"))
    )
    rows = rows.where(f"max_duration_ms <= 0 OR (j - i) * {period_ms} <= max_duration_ms")
    start = F.greatest(F.lit(0).cast("long"), F.expr(f"i - pad_before_ms div {period_ms}")) * period_ms
    end = F.least(F.lit(ticks).cast("long"), F.expr(f"j + pad_after_ms div {period_ms}")) * period_ms
    return rows.select("film_id", "category", start.alias("start_ms"), end.alias("end_ms"), "score")


def merge_runs(found: DataFrame, gap_ms: int) -> DataFrame:
    """Runs of one category of a film that overlap or lie at most gap_ms apart become one, with the best score."""
    w = W.partitionBy("film_id", "category").orderBy("start_ms", "end_ms", "score")
    reach = F.max("end_ms").over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start_ms") - reach > gap_ms), 1).otherwise(0)
    rows = found.withColumn("new", new).withColumn("part", F.sum("new").over(w))
    return rows.groupBy("film_id", "category", "part").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.max("score").alias("score"), F.count(F.lit(1)).alias("n_runs")).drop("part")


def diagnostics(fused: DataFrame, recipes: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Peak, ticks at or above the threshold and suggestions of every film and enabled category, zeros included."""
    rules = recipes.where("enabled").select("category", "threshold").distinct()
    films = fused.select("film_id").distinct().join(F.broadcast(rules))
    peaks = fused.join(F.broadcast(rules), "category").groupBy("film_id", "category").agg(F.max("fused").alias("peak"), F.count_if(F.col("fused") >= F.col("threshold")).alias("above_count"))
    counts = suggestions.groupBy("film_id", "category").agg(F.count(F.lit(1)).alias("suggestions"))
    rows = films.join(peaks, ["film_id", "category"], "left").join(counts, ["film_id", "category"], "left")
    zero = F.lit(0).cast("long")
    return rows.select("film_id", "category", F.round(F.coalesce("peak", F.lit(0.0)), 3).alias("peak"), F.round("threshold", 3).alias("threshold"), F.coalesce("above_count", zero).alias("above_count"), F.coalesce("suggestions", zero).alias("suggestions"))


def closest(diagnosed: DataFrame, n: int = 3) -> DataFrame:
    """Of films without any suggestion, the n categories that came nearest to their threshold."""
    w = W.partitionBy("film_id")
    quiet = diagnosed.withColumn("total", F.sum("suggestions").over(w)).where("total = 0")
    ranked = quiet.withColumn("nth", F.row_number().over(w.orderBy(F.desc(F.round(F.col("peak") - F.col("threshold"), 6)), "category")))
    return ranked.where(F.col("nth") <= n).select("film_id", F.col("nth").cast("long").alias("nth"), "category", F.round(F.col("peak") - F.col("threshold"), 6).alias("margin"))


def jump_scores(loudness: DataFrame, rise: float = 12.0, quiet: float = -30.0, cooldown: int = 20) -> DataFrame:
    """Sudden rises after quiet: candidates by window functions, then a fold that lets `cooldown` samples pass after each trigger.

    Gives film_id, idx, score for the painted samples [trigger - 20, trigger + 15)."""
    w = W.partitionBy("film_id").orderBy("idx")
    rows = loudness.withColumn("before", F.lag("momentary", 10).over(w)).withColumn("calm", F.round(F.avg("momentary").over(w.rowsBetween(-20, -11)), 9)).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("film_id")))
    jump = F.round(F.col("momentary") - F.col("before"), 9)
    hits = rows.where((F.col("idx") >= 20) & (jump >= rise) & (F.col("calm") <= quiet)).select("film_id", "idx", "n", F.least(F.lit(1.0), jump / (2 * rise)).alias("score"))
    lists = hits.groupBy("film_id").agg(F.array_sort(F.collect_list(F.struct("idx", "score"))).alias("hits"), F.max("n").alias("n"))
    kept = F.aggregate(
        "hits",
        F.array().cast("array<struct<idx:bigint,score:double>>"),
        lambda acc, x: F.when((F.size(acc) == 0) | (x["idx"] - F.coalesce(F.element_at(acc, -1)["idx"], F.lit(-cooldown)) >= cooldown), F.array_append(acc, x)).otherwise(acc),
    )
    fired = lists.select("film_id", "n", F.explode(kept).alias("h")).select("film_id", "n", F.col("h.idx").alias("at"), F.col("h.score").alias("score"))
    painted = fired.withColumn("idx", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("at") - 20), F.least(F.col("n"), F.col("at") + 15) - 1)))
    return painted.groupBy("film_id", "idx").agg(F.max("score").alias("score"))


def label_columns(matrix: DataFrame, classes: DataFrame, wanted: DataFrame, prefix: str) -> DataFrame:
    """Series of the wanted names from rows of class scores (film_id, idx, scores): film_id, series_key, idx, value.

    A name is looked up in classes (idx, name) whatever its case; of classes of one name the last counts, names without a class and classes beyond a row's scores give nothing. The columns that are wanted are few by nature (there are
    no more than classes); each row of scores is read once and gives just those."""
    by_name = classes.groupBy(F.lower("name").alias("key")).agg(F.max("idx").alias("at"))
    picked = wanted.select("name").distinct().join(by_name, F.lower("name") == F.col("key")).agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("picked"))
    rows = matrix.join(F.broadcast(picked))  # one row
    return rows.select("film_id", "idx", "scores", F.explode("picked").alias("p")).where("p.at < size(scores)").select("film_id", F.concat(F.lit(prefix), F.col("p.name")).alias("series_key"), "idx", F.get("scores", F.col("p.at").cast("int")).cast("double").alias("value"))
