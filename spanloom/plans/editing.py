"""Registered queries on markers, cuts, subtitles and profiles, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import intervals as I
from ..sources import adapters as A
from ..sources.adapters import DAYS, with_

WIDTH = 64
SUB_DURATION = 60_000

#: The profiles of each film: those of the ages that its orders name, with the shares that they scale thresholds by.
_PROFILES = "profiles AS (SELECT DISTINCT film_id, 'age-' || (id % 17) AS id, id % 17 AS min_age, 0.5 + (id % 17) / 20 AS mul FROM markers)"

_MERGED = f"""
, conf AS (SELECT * FROM markers WHERE status = 'confirmed' AND end_ms > start_ms),
clamped AS (SELECT film_id, greatest(start_ms, 0) AS start_ms, least(end_ms, {DAYS}) AS end_ms FROM conf WHERE least(end_ms, {DAYS}) > greatest(start_ms, 0)),
flags AS (SELECT *, CASE WHEN max(end_ms) OVER w IS NULL OR start_ms > max(end_ms) OVER w THEN 1 ELSE 0 END AS new FROM clamped WINDOW w AS (PARTITION BY film_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
parts AS (SELECT *, sum(new) OVER (PARTITION BY film_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS part FROM flags),
cuts AS (SELECT film_id, CAST(min(start_ms) AS BIGINT) AS start_ms, CAST(max(end_ms) AS BIGINT) AS end_ms FROM parts GROUP BY film_id, part),
keeps AS (SELECT * FROM (SELECT film_id, lag(end_ms, 1, 0) OVER (PARTITION BY film_id ORDER BY start_ms) AS start_ms, start_ms AS end_ms FROM cuts UNION ALL SELECT film_id, max(end_ms), {DAYS} FROM cuts GROUP BY film_id) WHERE end_ms > start_ms)
"""
_HEAD = with_("markers") + _MERGED


def _cuts(s, d):
    return I.union(I.confirmed(A.markers(s, d)), DAYS)


def _keeps(s, d):
    return I.complement(_cuts(s, d), DAYS)


def _profiles(s, d):
    """film_id, id, min_age, mul."""
    return A.markers(s, d).select("film_id", (F.col("id") % 17).alias("min_age")).distinct().select("film_id", F.concat(F.lit("age-"), F.col("min_age").cast("string")).alias("id"), "min_age", (0.5 + F.col("min_age") / 20).alias("mul"))


def _sub_keeps(s, d):
    """Keeps for subtitles: what cuts of [2, 9) and [20, 23) seconds leave of the first minute."""
    films = A.subtitles(s, d).select("film_id").distinct()
    cuts = films.withColumn("c", F.explode(F.expr("array(named_struct('a', 2000L, 'b', 9000L), named_struct('a', 20000L, 'b', 23000L))"))).select("film_id", F.col("c.a").alias("start_ms"), F.col("c.b").alias("end_ms"))
    return I.complement(cuts, SUB_DURATION)


_SUB_KEEPS = "sub_keeps AS (SELECT film_id, a AS start_ms, b AS end_ms FROM (SELECT DISTINCT film_id FROM subtitles) CROSS JOIN (VALUES (0, 2000), (9000, 20000), (23000, 60000)) v(a, b))"


def _keyframes(s, d):
    """Keyframes for marker films: every 17th day from the film's number modulo 17 on."""
    films = _keeps(s, d).select("film_id").distinct()
    return films.select("film_id", F.explode(F.sequence(F.col("film_id") % 17, F.lit(DAYS).cast("long"), F.lit(17).cast("long"))).alias("t_ms"))


_FRAMES = f"grid AS (SELECT film_id, unnest(range(film_id % 17, {DAYS} + 1, 17)) AS t_ms FROM (SELECT DISTINCT film_id FROM keeps))"


def _positions(s, d):
    return _cuts(s, d).select("film_id").distinct().select("film_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DAYS - 1).cast("long"), F.lit(37).cast("long"))).alias("position_ms"))


def next_pending(s, d):
    """Of each film the next pending marker from day 1000 on, and the one before."""
    pending = A.markers(s, d).where("status = 'pending'")
    return pending.groupBy("film_id").agg(F.min(F.when(F.col("start_ms") > 1000, F.struct("start_ms", "id"))).alias("n"), F.max(F.when(F.col("start_ms") < 1000, F.struct("start_ms", (-F.col("id")).alias("m")))).alias("p")).select("film_id", F.col("n.id").alias("next_id"), (-F.col("p.m")).alias("previous_id"))


def applied_pack(s, d):
    """A pack of cuts moved by a trim of -30: empty ones go, confidence outside [0, 1] becomes 0.5."""
    shifted = A.markers(s, d).select("film_id", "id", F.greatest(F.col("start_ms") - 30, F.lit(0)).alias("start_ms"), (F.col("end_ms") - 30).alias("end_ms"), (F.col("confidence") * 1.5).alias("c"))
    return shifted.where("end_ms > start_ms").select("film_id", "id", "start_ms", "end_ms", F.lit("suggested").alias("source"), F.lit("pending").alias("status"), F.round(F.round(F.when(F.col("c").between(0, 1), F.col("c")).otherwise(0.5), 9), 6).alias("confidence"))


def profile_for_age(s, d):
    """Of each film and of the ages 0, 7, 14 and 21 the profile of the largest least age not above it, or the youngest one; and the id of the age's own profile."""
    p = _profiles(s, d).withColumn("age", F.explode(F.array(*(F.lit(x).cast("long") for x in (0, 7, 14, 21)))))
    fits = F.col("min_age") <= F.col("age")
    best = p.groupBy("film_id", "age").agg(F.coalesce(F.max_by("id", F.when(fits, F.col("min_age"))), F.min_by("id", "min_age")).alias("profile"))
    return best.select("film_id", "age", "profile", F.when(F.col("age") > 0, F.concat(F.lit("age-"), F.col("age").cast("string"))).otherwise("all").alias("own_id"))


def profile_pick(s, d):
    """The profile of each film that is asked for, in any case, else the film's default, else the strictest."""
    p = _profiles(s, d)
    asked, fallback = F.concat(F.lit("AGE-"), (F.col("film_id") % 23).cast("string")), F.concat(F.lit("age-"), (F.col("film_id") % 13).cast("string"))
    rank = F.when(F.lower("id") == F.lower(asked), 0).when(F.lower("id") == F.lower(fallback), 1).otherwise(2)
    return p.groupBy("film_id").agg(F.min_by("id", F.struct(rank, "min_age", "id")).alias("picked"))


def profile_order(s, d):
    """The place of each profile in its film, by least age."""
    w = W.partitionBy("film_id").orderBy("min_age", "id")
    return _profiles(s, d).select("film_id", "id", F.row_number().over(w).cast("long").alias("place"))


def profile_layer(s, d):
    """Thresholds of a film's categories under each of its profiles, at most 1."""
    rules = A.markers(s, d).groupBy("film_id", "category").agg((F.floor(F.max("confidence") * 1000) / 1000).alias("threshold"))
    return rules.join(_profiles(s, d), "film_id").select("film_id", "category", F.col("id").alias("profile"), F.round(F.least(F.lit(1.0), F.col("threshold") * F.col("mul")), 6).alias("threshold"))


def profile_upsert(s, d):
    """Two lists of profiles by source: those of the new list replace the old ones of the same id, if the sources agree; source 0 stands for an unknown one, which agrees with all."""
    old = A.markers(s, d).where("status = 'confirmed'").select("film_id", (F.col("id") % 5).alias("profile"), F.lit(0).alias("new"), (F.col("id") % 3).alias("source"), "id")
    new = A.markers(s, d).where("status = 'pending'").select("film_id", (F.col("id") % 5).alias("profile"), F.lit(1).alias("new"), (F.col("id") % 3).alias("source"), "id")
    source = new.groupBy("film_id").agg(F.max_by("source", "id").alias("now"))
    rows = old.unionByName(new).join(source, "film_id", "left").where("new = 1 OR now IS NULL OR source = now OR source = 0 OR now = 0")
    return rows.groupBy("film_id", "profile").agg(F.max_by("id", F.struct("new", "id")).alias("id"))


def upserted(s, d):
    """Markers after deletes by id and replacements that keep the id; invalid ones are not added."""
    m = A.markers(s, d)
    gone = m.where("id % 7 = 0").select("id")
    changed = m.where("id % 7 = 1").withColumn("end_ms", F.col("start_ms") + F.col("id") % 3).where("end_ms > start_ms")
    return m.join(gone, "id", "left_anti").join(changed.select("id"), "id", "left_anti").unionByName(changed).select("film_id", "id", "start_ms", "end_ms", "status")


def unsaved(s, d):
    """Films whose markers differ from a copy in which every 50th was moved."""
    m = A.markers(s, d).select("film_id", "id", "start_ms", "end_ms", "status")
    copy = m.withColumn("end_ms", F.when(F.col("id") % 50 == 0, F.col("end_ms") + 1).otherwise(F.col("end_ms")))
    return m.exceptAll(copy).unionByName(copy.exceptAll(m)).groupBy("film_id").agg(F.count(F.lit(1)).alias("differences"))


def queries():
    return {
        "p1_confirmed_markers": lambda s, d: I.confirmed(A.markers(s, d)).select("film_id", "id", "start_ms", "end_ms", "category"),
        "p2_overlapping_markers": lambda s, d: I.overlap_join(A.markers(s, d).where("status = 'confirmed'").select("film_id", "id", "start_ms", "end_ms"), A.markers(s, d).where("status = 'rejected'").select("film_id", F.col("id").alias("other_id"), "start_ms", "end_ms"), WIDTH).select("film_id", "id", "other_id"),
        "w1_interval_union": _cuts,
        "a4_total_cut": lambda s, d: _cuts(s, d).groupBy("film_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("cut_ms")),
        "w12_keep_segments": _keeps,
        "a22_kept_total": lambda s, d: _keeps(s, d).groupBy("film_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("kept_ms"), F.count(F.lit(1)).alias("n_segments")),
        "j4_cut_attribution": lambda s, d: I.attribution(_cuts(s, d), A.markers(s, d), WIDTH),
        "w5_kept_before": lambda s, d: I.kept_before(_keeps(s, d)),
        "j6_retimed_subtitles": lambda s, d: I.retime(A.subtitles(s, d), _sub_keeps(s, d), 4096),
        "p16_lead_in_segments": lambda s, d: I.lead_in(_cuts(s, d), 5),
        "w16_boundary_plan": lambda s, d: I.boundary_plan(_keeps(s, d), _keyframes(s, d), WIDTH),
        "j14_first_keyframe": lambda s, d: I.point_join(_keyframes(s, d), _keeps(s, d), "t_ms", WIDTH).groupBy("film_id", "start_ms").agg(F.min("t_ms").alias("keyframe_ms")),
        "p15_cut_at_position": lambda s, d: I.cut_at(_positions(s, d), _cuts(s, d), 5, WIDTH),
        "t8_skip_replay": lambda s, d: I.skip_replay(_cuts(s, d), 2, 15, 3, DAYS),
        "w14_next_pending": next_pending,
        "p21_applied_pack": applied_pack,
        "p6_profile_for_age": profile_for_age,
        "p7_profile_pick": profile_pick,
        "o9_profile_order": profile_order,
        "p4_profile_layer": profile_layer,
        "j19_profile_upsert": profile_upsert,
        "u6_marker_updates": upserted,
        "u7_unsaved_changes": unsaved,
    }


def oracle_sql():
    return {
        "p1_confirmed_markers": _HEAD + " SELECT film_id, id, start_ms, end_ms, category FROM conf",
        "p2_overlapping_markers": with_("markers") + " SELECT a.film_id, a.id, b.id AS other_id FROM markers a JOIN markers b ON a.film_id = b.film_id AND a.status = 'confirmed' AND b.status = 'rejected' AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms",
        "w1_interval_union": _HEAD + " SELECT * FROM cuts",
        "a4_total_cut": _HEAD + " SELECT film_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS cut_ms FROM cuts GROUP BY film_id",
        "w12_keep_segments": _HEAD + " SELECT * FROM keeps",
        "a22_kept_total": _HEAD + " SELECT film_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS kept_ms, count(*) AS n_segments FROM keeps GROUP BY film_id",
        "j4_cut_attribution": _HEAD + " SELECT c.film_id, c.start_ms, c.end_ms, CASE WHEN count(DISTINCT m.category) = 1 THEN min(m.category) ELSE '' END AS category FROM cuts c LEFT JOIN conf m ON m.film_id = c.film_id AND m.start_ms < c.end_ms AND c.start_ms < m.end_ms GROUP BY ALL",
        "w5_kept_before": _HEAD + " SELECT *, CAST(sum(end_ms - start_ms) OVER (PARTITION BY film_id ORDER BY start_ms ROWS UNBOUNDED PRECEDING) - (end_ms - start_ms) AS BIGINT) AS before_ms FROM keeps",
        "j6_retimed_subtitles": with_("subtitles") + ", " + _SUB_KEEPS + ", k AS (SELECT *, sum(end_ms - start_ms) OVER (PARTITION BY film_id ORDER BY start_ms ROWS UNBOUNDED PRECEDING) - (end_ms - start_ms) AS before_ms FROM sub_keeps) SELECT s.film_id, ord, CAST(greatest(s.start_ms, k.start_ms) + before_ms - k.start_ms AS BIGINT) AS start_ms, CAST(least(s.end_ms, k.end_ms) + before_ms - k.start_ms AS BIGINT) AS end_ms, text FROM subtitles s JOIN k ON s.film_id = k.film_id AND s.start_ms < k.end_ms AND k.start_ms < s.end_ms",
        "p16_lead_in_segments": _HEAD + " SELECT film_id, start_ms, end_ms, greatest(start_ms - 5, 0) AS lead_start_ms, greatest(start_ms - 5, 0) * 10000 AS start_ticks, end_ms * 10000 AS end_ticks FROM cuts",
        "w16_boundary_plan": _HEAD + ", " + _FRAMES + ", k AS (SELECT p.film_id, p.start_ms, p.end_ms, coalesce(min(g.t_ms), p.end_ms) AS k FROM keeps p LEFT JOIN grid g ON g.film_id = p.film_id AND g.t_ms >= p.start_ms AND g.t_ms < p.end_ms GROUP BY p.film_id, p.start_ms, p.end_ms) SELECT film_id, 'rendered' AS kind, start_ms, k AS end_ms FROM k WHERE k > start_ms UNION ALL SELECT film_id, 'original', k, end_ms FROM k WHERE end_ms > k",
        "j14_first_keyframe": _HEAD + ", " + _FRAMES + " SELECT p.film_id, p.start_ms, min(g.t_ms) AS keyframe_ms FROM keeps p JOIN grid g ON g.film_id = p.film_id AND g.t_ms >= p.start_ms AND g.t_ms < p.end_ms GROUP BY ALL",
        "p15_cut_at_position": _HEAD + f", pos AS (SELECT film_id, unnest(range(0, {DAYS}, 37)) AS position_ms FROM (SELECT DISTINCT film_id FROM cuts)) SELECT p.film_id, p.position_ms, min(c.start_ms) AS cut_start_ms, arg_min(c.end_ms, c.start_ms) AS cut_end_ms FROM pos p JOIN cuts c ON c.film_id = p.film_id AND p.position_ms < c.end_ms AND p.position_ms >= greatest(c.start_ms - 5, 0) GROUP BY ALL",
        "t8_skip_replay": with_("markers", recursive=True) + _MERGED + f""", c AS (SELECT *, row_number() OVER (PARTITION BY film_id ORDER BY start_ms) AS k FROM cuts),
            fold(film_id, k, pos, ready, from_ms, to_ms) AS (SELECT DISTINCT film_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(-15 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM c
              UNION ALL SELECT f.film_id, c.k, CASE WHEN x.poll < c.end_ms AND x.poll < {DAYS} THEN c.end_ms ELSE f.pos END, CASE WHEN x.poll < c.end_ms AND x.poll < {DAYS} THEN c.end_ms + 15 ELSE f.ready END,
                CASE WHEN x.poll < c.end_ms AND x.poll < {DAYS} THEN x.poll END, CASE WHEN x.poll < c.end_ms AND x.poll < {DAYS} THEN c.end_ms END
              FROM fold f JOIN c ON c.film_id = f.film_id AND c.k = f.k + 1, LATERAL (SELECT f.pos + CAST(ceil((greatest(f.pos, c.start_ms - 2, f.ready, 0) - f.pos) / 3.0) AS BIGINT) * 3 AS poll) x)
            SELECT film_id, from_ms, to_ms FROM fold WHERE from_ms IS NOT NULL""",
        "w14_next_pending": with_("markers") + " SELECT film_id, arg_min(id, (start_ms, id)) FILTER (start_ms > 1000) AS next_id, arg_max(id, (start_ms, -id)) FILTER (start_ms < 1000) AS previous_id FROM markers WHERE status = 'pending' GROUP BY film_id",
        "p21_applied_pack": with_("markers") + " SELECT film_id, id, greatest(start_ms - 30, 0) AS start_ms, end_ms - 30 AS end_ms, 'suggested' AS source, 'pending' AS status, CAST(round(CAST(round(CASE WHEN confidence * 1.5 BETWEEN 0 AND 1 THEN confidence * 1.5 ELSE 0.5 END, 9) AS DECIMAL(20,9)), 6) AS DOUBLE) AS confidence FROM markers WHERE end_ms - 30 > greatest(start_ms - 30, 0)",
        "p6_profile_for_age": with_("markers") + f", {_PROFILES}, asked AS (SELECT *, unnest([0, 7, 14, 21]) AS age FROM profiles) SELECT film_id, CAST(age AS BIGINT) AS age, coalesce(arg_max(id, min_age) FILTER (min_age <= age), arg_min(id, min_age)) AS profile, CASE WHEN age > 0 THEN 'age-' || age ELSE 'all' END AS own_id FROM asked GROUP BY film_id, age",
        "p7_profile_pick": with_("markers") + f", {_PROFILES} SELECT film_id, arg_min(id, (CASE WHEN lower(id) = 'age-' || (film_id % 23) THEN 0 WHEN id = 'age-' || (film_id % 13) THEN 1 ELSE 2 END, min_age, id)) AS picked FROM profiles GROUP BY film_id",
        "o9_profile_order": with_("markers") + f", {_PROFILES} SELECT film_id, id, row_number() OVER (PARTITION BY film_id ORDER BY min_age, id) AS place FROM profiles",
        "p4_profile_layer": with_("markers") + f", {_PROFILES}, rules AS (SELECT film_id, category, floor(max(confidence) * 1000) / 1000 AS threshold FROM markers GROUP BY ALL) SELECT film_id, category, id AS profile, round(least(1.0, threshold * mul), 6) AS threshold FROM rules JOIN profiles USING (film_id)",
        "j19_profile_upsert": with_("markers") + ", rows AS (SELECT film_id, id % 5 AS profile, CASE status WHEN 'pending' THEN 1 ELSE 0 END AS new, id % 3 AS source, id FROM markers WHERE status IN ('confirmed', 'pending')), src AS (SELECT film_id, arg_max(source, id) AS now FROM rows WHERE new = 1 GROUP BY film_id) SELECT r.film_id, r.profile, arg_max(r.id, (r.new, r.id)) AS id FROM rows r LEFT JOIN src USING (film_id) WHERE new = 1 OR now IS NULL OR source = now OR source = 0 OR now = 0 GROUP BY ALL",
        "u6_marker_updates": with_("markers") + " SELECT film_id, id, start_ms, CASE WHEN id % 7 = 1 AND id % 3 > 0 THEN start_ms + id % 3 ELSE end_ms END AS end_ms, status FROM markers WHERE id % 7 <> 0",
        "u7_unsaved_changes": with_("markers") + " SELECT film_id, count(*) * 2 AS differences FROM markers WHERE id % 50 = 0 GROUP BY film_id",
    }
