"""Registered queries on score series, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as S
from ..sources import adapters as A
from ..sources.adapters import FILM_TICKS, HOUR_MS, with_

_R3_MAX = "CAST(round(CAST(round(max(fused), 9) AS DECIMAL(20,9)), 3) AS DOUBLE)"
_R3_PEAK = "CAST(round(CAST(round(coalesce(peak, 0.0), 9) AS DECIMAL(20,9)), 3) AS DOUBLE)"

_RUNS = f"""
, found AS (
  SELECT s.film_id, r.category, r.det_ord, r.weight, r.label, s.idx, s.value, CASE WHEN s.series_key = r.det_id THEN 0 ELSE 1 END AS kind
  FROM series s JOIN (SELECT DISTINCT category, det_ord, det_id, weight, CAST(NULL AS VARCHAR) AS label, det_id AS key FROM recipes WHERE enabled
        UNION ALL SELECT category, det_ord, det_id, weight, label, det_id || '.' || label FROM recipes WHERE enabled AND label IS NOT NULL) r ON s.series_key = r.key),
det AS (SELECT film_id, category, det_ord, weight, label, idx, value FROM found QUALIFY kind = min(kind) OVER (PARTITION BY film_id, category, det_ord)),
ored AS (SELECT film_id, category, det_ord, weight, idx, max(value) AS value FROM det GROUP BY ALL),
fused AS (SELECT film_id, category, idx, least(1.0, CAST(sum(CAST(weight * value AS DECIMAL(20,12))) AS DOUBLE)) AS fused FROM ored GROUP BY ALL),
rules AS (SELECT DISTINCT category, threshold, pad_before_ms, pad_after_ms, max_duration_ms FROM recipes WHERE enabled),
above AS (SELECT f.*, u.* EXCLUDE (category), idx - row_number() OVER (PARTITION BY film_id, f.category ORDER BY idx) AS island FROM fused f JOIN rules u USING (category) WHERE fused >= threshold),
raw AS (SELECT film_id, category, island, min(idx) AS i, max(idx) + 1 AS j, {_R3_MAX} AS score, any_value(pad_before_ms) AS pb, any_value(pad_after_ms) AS pa, any_value(max_duration_ms) AS md FROM above GROUP BY film_id, category, island),
runs AS (SELECT film_id, category, CAST(greatest(0, i - pb // {HOUR_MS}) * {HOUR_MS} AS BIGINT) AS start_ms, CAST(least({FILM_TICKS}, j + pa // {HOUR_MS}) * {HOUR_MS} AS BIGINT) AS end_ms, score FROM raw WHERE md <= 0 OR (j - i) * {HOUR_MS} <= md),
flagged AS (SELECT *, CASE WHEN max(end_ms) OVER w IS NULL OR start_ms - max(end_ms) OVER w > {2 * HOUR_MS} THEN 1 ELSE 0 END AS new
            FROM runs WINDOW w AS (PARTITION BY film_id, category ORDER BY start_ms, end_ms, score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
parts AS (SELECT *, sum(new) OVER (PARTITION BY film_id, category ORDER BY start_ms, end_ms, score ROWS UNBOUNDED PRECEDING) AS part FROM flagged),
merged AS (SELECT film_id, category, min(start_ms) AS start_ms, max(end_ms) AS end_ms, max(score) AS score, count(*) AS n_runs FROM parts GROUP BY film_id, category, part),
diag AS (SELECT films.film_id, rules.category, {_R3_PEAK} AS peak, round(threshold, 3) AS threshold, coalesce(above_count, 0) AS above_count, coalesce(n, 0) AS suggestions
  FROM (SELECT DISTINCT film_id FROM fused) films CROSS JOIN rules
  LEFT JOIN (SELECT film_id, f.category, max(fused) AS peak, count(*) FILTER (fused >= threshold) AS above_count FROM fused f JOIN rules USING (category) GROUP BY ALL) p ON p.film_id = films.film_id AND p.category = rules.category
  LEFT JOIN (SELECT film_id, category, count(*) AS n FROM merged GROUP BY ALL) m ON m.film_id = films.film_id AND m.category = rules.category)
"""
#: Rounds a double to three decimals, halves up, as on its decimal rendering.
_ROUND3 = "CAST(round(CAST(round({}, 9) AS DECIMAL(20,9)), 3) AS DOUBLE)"
_HEAD = with_("recipes", "series") + _RUNS


def _detected(spark, d):
    return S.detector_series(A.recipes(spark), A.score_series(spark, d))


def _fused(spark, d):
    return S.fuse(_detected(spark, d))


def _runs(spark, d):
    return S.runs(_fused(spark, d), A.recipes(spark), HOUR_MS, FILM_TICKS)


def _merged(spark, d):
    return S.merge_runs(_runs(spark, d), 2 * HOUR_MS)


def _diagnosed(spark, d):
    return S.diagnostics(_fused(spark, d), A.recipes(spark), _merged(spark, d))


def needed_series(spark, d):
    """Which series some enabled detector reads, and how many rows pruning saves."""
    keys = A.recipes(spark).where("enabled").select(F.explode(F.array("det_id", F.concat_ws(".", "det_id", "label"))).alias("series_key")).distinct().withColumn("needed", F.lit(True))
    rows = A.score_series(spark, d).groupBy("series_key").agg(F.count(F.lit(1)).alias("n_ticks"))
    return rows.join(F.broadcast(keys), "series_key", "left").select("series_key", "n_ticks", F.coalesce("needed", F.lit(False)).alias("needed"))


def rounded_series(spark, d):
    """The fused series as a result file holds it, with three decimals."""
    return _fused(spark, d).select("film_id", "category", "idx", F.round("fused", 3).alias("value"))


def packed_series(spark, d):
    """Each film's series as one array in tick order, packed to text, with length and checks."""
    rows = A.score_series(spark, d).groupBy("film_id", "series_key").agg(F.array_sort(F.collect_list(F.struct("idx", F.round(F.round("value", 9), 3).alias("value")))).alias("a"))
    text = F.array_join(F.transform("a", lambda x: F.concat_ws(":", x["idx"], F.round(x["value"] * 1000).cast("long"))), ",")
    return rows.select("film_id", "series_key", F.size("a").cast("long").alias("n"), text.alias("packed"))


def coverage(spark, d):
    """Plain sum of suggested lengths over the film's, overlaps counted twice, in percent."""
    return _merged(spark, d).groupBy("film_id").agg(F.round(F.sum(F.col("end_ms") - F.col("start_ms")) * 100.0 / (FILM_TICKS * HOUR_MS), 6).alias("coverage_pct"))


def queries():
    return {
        "j1_detector_series": _detected,
        "a1_label_or": lambda s, d: S.label_or(_detected(s, d)).drop("weight"),
        "a2_fused_scores": lambda s, d: _fused(s, d).withColumn("fused", F.round("fused", 6)),
        "w13_resampled_series": lambda s, d: S.resample(A.score_series(s, d), HOUR_MS, HOUR_MS // 2, 2 * FILM_TICKS),
        "w3_threshold_runs": _runs,
        "w2_merged_suggestions": _merged,
        "a3_category_diagnostics": _diagnosed,
        "o3_closest_categories": lambda s, d: S.closest(_diagnosed(s, d)),
        "a5_suggestion_coverage": coverage,
        "p5_needed_series": needed_series,
        "s2_rounded_series": rounded_series,
        "s2_packed_series": packed_series,
        "w4_jump_scores": lambda s, d: S.jump_scores(A.loudness(s, d)).withColumn("score", F.round("score", 6)),
    }


def oracle_sql():
    return {
        "j1_detector_series": _HEAD + " SELECT film_id, category, CAST(det_ord AS INTEGER) AS det_ord, weight, label, idx, value FROM det",
        "a1_label_or": _HEAD + " SELECT film_id, category, CAST(det_ord AS INTEGER) AS det_ord, idx, value FROM ored",
        "a2_fused_scores": _HEAD + " SELECT film_id, category, idx, round(fused, 6) AS fused FROM fused",
        "w13_resampled_series": with_("series") + f"""
            , lasts AS (SELECT film_id, series_key, max(idx) AS last FROM series GROUP BY ALL), grid AS (SELECT *, unnest(range({2 * FILM_TICKS})) AS idx FROM lasts)
            SELECT g.film_id, g.series_key, CAST(g.idx AS BIGINT) AS idx, coalesce(s.value, 0.0) AS value FROM grid g LEFT JOIN series s ON s.film_id = g.film_id AND s.series_key = g.series_key AND s.idx = least((g.idx * {HOUR_MS // 2}) // {HOUR_MS}, g.last)""",
        "w3_threshold_runs": _HEAD + " SELECT * FROM runs",
        "w2_merged_suggestions": _HEAD + " SELECT * FROM merged",
        "a3_category_diagnostics": _HEAD + " SELECT * FROM diag",
        "o3_closest_categories": _HEAD + ", quiet AS (SELECT * FROM diag QUALIFY sum(suggestions) OVER (PARTITION BY film_id) = 0) SELECT film_id, row_number() OVER (PARTITION BY film_id ORDER BY round(peak - threshold, 6) DESC, category) AS nth, category, round(peak - threshold, 6) AS margin FROM quiet QUALIFY nth <= 3",
        "a5_suggestion_coverage": _HEAD + f" SELECT film_id, round(CAST(sum(end_ms - start_ms) AS BIGINT) * 100.0 / {FILM_TICKS * HOUR_MS}, 6) AS coverage_pct FROM merged GROUP BY film_id",
        "p5_needed_series": with_("recipes", "series") + ", keys AS (SELECT det_id AS k FROM recipes WHERE enabled UNION SELECT det_id || coalesce('.' || label, '') FROM recipes WHERE enabled) SELECT series_key, count(*) AS n_ticks, series_key IN (SELECT k FROM keys) AS needed FROM series GROUP BY series_key",
        "s2_rounded_series": _HEAD + " SELECT film_id, category, idx, " + _ROUND3.format("fused") + " AS value FROM fused",
        "s2_packed_series": with_("series") + " SELECT film_id, series_key, count(*) AS n, string_agg(idx || ':' || CAST(round(CAST(round(CAST(round(value, 9) AS DECIMAL(20,9)), 3) AS DOUBLE) * 1000) AS BIGINT), ',' ORDER BY idx) AS packed FROM series GROUP BY ALL",
        "w4_jump_scores": with_("loudness", recursive=True) + """
            , calm AS (SELECT film_id, idx, momentary, lag(momentary, 10) OVER w AS before, round(avg(momentary) OVER (PARTITION BY film_id ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 11 PRECEDING), 9) AS calm, count(*) OVER (PARTITION BY film_id) AS n FROM loudness WINDOW w AS (PARTITION BY film_id ORDER BY idx)),
            hits AS (SELECT film_id, idx, n, least(1.0, round(momentary - before, 9) / 24) AS score, row_number() OVER (PARTITION BY film_id ORDER BY idx) AS k FROM calm WHERE idx >= 20 AND round(momentary - before, 9) >= 12 AND calm <= -30),
            fold AS (SELECT film_id, k, idx, score, n, idx AS last, TRUE AS fired FROM hits WHERE k = 1
              UNION ALL SELECT h.film_id, h.k, h.idx, h.score, h.n, CASE WHEN h.idx - f.last >= 20 THEN h.idx ELSE f.last END, h.idx - f.last >= 20 FROM fold f JOIN hits h ON h.film_id = f.film_id AND h.k = f.k + 1),
            painted AS (SELECT film_id, score, unnest(range(greatest(0, idx - 20), least(n, idx + 15))) AS idx FROM fold WHERE fired)
            SELECT film_id, CAST(idx AS BIGINT) AS idx, round(max(score), 6) AS score FROM painted GROUP BY film_id, idx""",
    }
