"""The bench tables as the engine's own abstractions, in Spark and, for the oracles, as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

HOUR_MS = 3_600_000
FILM_TICKS = 720
DAYS = 2600

#: category, enabled, threshold, pad_before_ms, pad_after_ms, max_duration_ms, det_ord, det_id, weight, label
RECIPES = [
    ("Spending", True, 0.5, 3_600_000, 7_200_000, 0, 0, "event.purchase", 0.7, None),
    ("Spending", True, 0.5, 3_600_000, 7_200_000, 0, 1, "event.click", 0.5, None),
    ("Trouble", True, 0.6, 0, 3_600_000, 7_200_000, 0, "event", 1.0, "error"),
    ("Trouble", True, 0.6, 0, 3_600_000, 7_200_000, 0, "event", 1.0, "crash"),
    ("Visits", True, 0.4, 7_200_000, 0, 0, 0, "event", 0.8, "signup"),
    ("Visits", True, 0.4, 7_200_000, 0, 0, 0, "event", 0.8, "view"),
    ("Idle", False, 0.1, 0, 0, 0, 0, "event.view", 1.0, None),
]
RECIPE_SCHEMA = "category string, enabled boolean, threshold double, pad_before_ms long, pad_after_ms long, max_duration_ms long, det_ord int, det_id string, weight double, label string"


def recipes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RECIPES, RECIPE_SCHEMA)


def score_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """film_id, series_key, idx, value: the largest event value of each hour, over 100, at most 1."""
    idx = F.expr("(unix_micros(cast(ts as timestamp)) - unix_micros(timestamp'2024-01-01')) div 3600000000")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("film_id"), F.concat(F.lit("event."), "event_type").alias("series_key"), idx.alias("idx"), "value")
    return rows.groupBy("film_id", "series_key", "idx").agg(F.least(F.lit(1.0), F.max("value") / 100).alias("value"))


def loudness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """film_id, idx, momentary: events of a user in order, as loudness in LUFS."""
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("film_id"), (F.row_number().over(w) - 1).cast("long").alias("idx"), (F.lit(-60.0) + F.col("value") / 10).alias("momentary"))


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """film_id, id, start_ms, end_ms, category, status, confidence: orders as intervals in days."""
    start = F.expr("datediff(o_orderdate, date'1995-01-01')").cast("long")
    status = F.expr("CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'pending' ELSE 'rejected' END")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("film_id"), F.col("o_orderkey").alias("id"), start.alias("start_ms"), (start + 1 + F.col("o_orderkey") % 40).alias("end_ms"),
        F.col("o_orderpriority").alias("category"), status.alias("status"), F.least(F.lit(1.0), F.col("o_totalprice") / 500000).alias("confidence"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t, vec, author: even vectors as frames."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("t"), F.col("embedding").alias("vec"), F.col("label").alias("author"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, vec, accepted, author: odd vectors as decisions."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 2 = 1").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"), (F.col("label") % 2 == 1).alias("accepted"), F.col("label").alias("author"))


def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """film_id, t_ms: distinct event times, in ms from the film's first."""
    from pyspark.sql import Window as W

    t = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("film_id"), t.alias("t")).distinct()
    return rows.select("film_id", (F.col("t") - F.min("t").over(W.partitionBy("film_id"))).alias("t_ms"))


def subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """film_id, ord, start_ms, end_ms, text: turns of conversations."""
    start = F.col("turn").cast("long") * 5000
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("film_id"), F.col("turn").cast("long").alias("ord"), start.alias("start_ms"), (start + F.least(F.lit(7000), 40 * F.length("text"))).cast("long").alias("end_ms"), "text")


def endorsements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """author, target, score: three best targets of each supplier, by mean discount."""
    from pyspark.sql import Window as W

    n = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf_dir, "lineitem").crossJoin(F.broadcast(n)).select(F.col("l_suppkey").alias("author"), (F.col("l_partkey") % F.col("n")).alias("target"), F.col("l_discount").cast("decimal(10,2)").alias("d")).where("author <> target")
    means = rows.groupBy("author", "target").agg(F.round(F.sum("d").cast("double") / F.count(F.lit(1)) * 10, 6).alias("score"))
    w = W.partitionBy("author").orderBy(F.desc("score"), "target")
    return means.withColumn("nth", F.row_number().over(w)).where("nth <= 3").drop("nth")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """author, seq, accepted: purchases accept, errors reject."""
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'error')")
    return rows.select(F.col("user_id").alias("author"), F.row_number().over(w).cast("long").alias("seq"), (F.col("event_type") == "purchase").alias("accepted"))


def _values(rows: list[tuple]) -> str:
    def one(x) -> str:
        return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else f"'{x}'" if isinstance(x, str) else f"CAST({x} AS DOUBLE)" if isinstance(x, float) else str(x)

    return ",\n".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


#: The same adapters for DuckDB.
DUCK = {
    "recipes": f"recipes({', '.join(c.split()[0] for c in RECIPE_SCHEMA.split(', '))}) AS (VALUES {_values(RECIPES)})",
    "series": "series AS (SELECT user_id AS film_id, 'event.' || event_type AS series_key, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 3600000000 AS idx, least(1.0, max(value) / 100) AS value FROM events GROUP BY ALL)",
    "loudness": "loudness AS (SELECT user_id AS film_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, -60.0 + value / 10 AS momentary FROM events)",
    "markers": "markers AS (SELECT o_custkey AS film_id, o_orderkey AS id, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS start_ms, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) + 1 + o_orderkey % 40 AS end_ms, o_orderpriority AS category, CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS status, least(1.0, o_totalprice / 500000) AS confidence FROM orders)",
    "frames": "frames AS (SELECT vec_id AS t, embedding AS vec, label AS author FROM embeddings WHERE vec_id % 2 = 0)",
    "feedback": "feedback AS (SELECT vec_id AS row_id, embedding AS vec, label % 2 = 1 AS accepted, label AS author FROM embeddings WHERE vec_id % 2 = 1)",
    "keyframes": "times AS (SELECT DISTINCT user_id AS film_id, epoch_us(ts) // 1000 AS t FROM events), keyframes AS (SELECT film_id, t - min(t) OVER (PARTITION BY film_id) AS t_ms FROM times)",
    "subtitles": "subtitles AS (SELECT CAST(conv_id AS BIGINT) AS film_id, CAST(turn AS BIGINT) AS ord, CAST(turn AS BIGINT) * 5000 AS start_ms, CAST(turn AS BIGINT) * 5000 + least(7000, 40 * length(text)) AS end_ms, text FROM conversations)",
    "endorsements": "means AS (SELECT l_suppkey AS author, l_partkey % (SELECT count(*) FROM supplier) AS target, round(CAST(sum(CAST(l_discount AS DECIMAL(10,2))) AS DOUBLE) / count(*) * 10, 6) AS score FROM lineitem WHERE l_suppkey <> l_partkey % (SELECT count(*) FROM supplier) GROUP BY ALL), endorsements AS (SELECT author, target, score FROM means QUALIFY row_number() OVER (PARTITION BY author ORDER BY score DESC, target) <= 3)",
    "decisions": "decisions AS (SELECT user_id AS author, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type = 'purchase' AS accepted FROM events WHERE event_type IN ('purchase', 'error'))",
}


def with_(*names: str, recursive: bool = False) -> str:
    """The WITH clause of some adapters, open for more."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(DUCK[n] for n in names)
