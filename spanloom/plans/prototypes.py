"""Registered queries of trial fingerprints, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import fingerprints as P
from ..operators import prototypes as T
from ..session import table, written
from ..sources.adapters import with_
from .matching import _times, match_sql

#: A film's events as frames and as bins of sound, STEP ms apart; windows around places are as wide as four of them.
STEP = 30_000
AUDIO = {"bin_ms": STEP, "rolling": 6, "least": 30}
HASH = "array<struct<t_ms:bigint,phash:string>>"


def _frames(s, d):
    """film_id, idx, t_ms, phash, variance, rms."""
    idx = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    hashed = F.substring(F.sha2((F.col("event_id") % 50).cast("string"), 256), 1, 16)
    return table(s, d, "events").select(F.col("user_id").alias("film_id"), idx.cast("long").alias("idx"), (idx * STEP).cast("long").alias("t_ms"), hashed.alias("phash"), F.col("value").alias("variance"), F.col("value").alias("rms"))


def _films(frames):
    return frames.groupBy("film_id").agg((F.max("t_ms") + STEP).alias("duration_ms"))


def _digests(version):
    def query(s, d):
        frames = _frames(s, d)
        out = T.body_digests(_films(frames), frames, frames, version, 4 * STEP, **(AUDIO if version in (7, 8) else {}))
        return out.select("film_id", "body_span_ms", F.size("anchors").cast("long").alias("n_anchors"), "extreme_gap_ms", "digest")

    return query


def anchor_pairs(s, d):
    frames = _frames(s, d)
    return T.anchor_pair(_films(frames), frames)


def end_anchors(s, d):
    """Keyframes of films, of which every fifth has even ones instead."""
    rank = F.row_number().over(W.partitionBy("film_id").orderBy("t_ms")) - 1
    times = _times(s, d).withColumn("t_ms", F.when(F.col("film_id") % 5 == 0, rank * 31_000).otherwise(F.col("t_ms")).cast("long"))
    times = written(times, "times")
    films = times.groupBy("film_id").agg((F.max("t_ms") + 20_000).alias("duration_ms"))
    out = T.end_anchors(films, times)
    return out.select("film_id", "outcome", "n_keyframes", "n_body", F.size("peaks").cast("long").alias("n_peaks"), F.get("peaks", F.lit(0)).alias("first_ms"), F.element_at("peaks", -1).alias("last_ms"), "inner_span_ms")


def _pairs(times):
    """Films and their copies without the first 22 s: every third lacks every third time, every seventh is stretched, every fourth has other hashes; odd films are the second of their pair."""
    at = lambda sign: F.substring(F.sha2(F.concat_ws(sign, F.col("film_id").cast("string"), F.col("t_ms").cast("string")), 256), 1, 16)
    lists = times.groupBy("film_id").agg(F.array_sort(F.collect_list("t_ms")).alias("times"))
    marks = P.anchors(times, 25).select("film_id", F.struct("t_ms", at("-").alias("phash")).alias("x"), F.struct((F.col("t_ms") - 22_000).alias("t_ms"), F.when(F.col("film_id") % 4 == 0, at("+")).otherwise(at("-")).alias("phash")).alias("y"))
    marks = marks.groupBy("film_id").agg(F.array_sort(F.collect_list("x")).alias("x"), F.array_sort(F.collect_list(F.when(F.col("y.t_ms") >= 0, F.col("y")))).alias("y"))
    kept = F.filter("times", lambda t, i: (t >= 22_000) & ((F.col("film_id") % 3 != 0) | (i % 3 != 2)))
    moved = F.transform(kept, lambda t: F.when(F.col("film_id") % 7 == 0, t + F.floor(t / 10)).otherwise(t - 22_000).cast("long"))
    rows = lists.join(marks, "film_id", "left").select("film_id", F.struct("times", F.col("x").alias("anchors")).alias("f"), F.struct(moved.alias("times"), F.col("y").alias("anchors")).alias("g"))
    odd = F.col("film_id") % 2 == 1
    return rows.select(F.col("film_id").alias("pair_id"), F.when(odd, F.col("g")).otherwise(F.col("f")).alias("a"), F.when(odd, F.col("f")).otherwise(F.col("g")).alias("b"))


def ladder_times(s, d):
    """Events of a film as keyframes that were found in several ways: a way for each first letter of their types."""
    rows = table(s, d, "events").select(F.col("user_id").alias("film_id"), F.ascii("event_type").cast("long").alias("rung"), F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("t_ms"))
    return P.ladder(rows, 15)


def queries():
    return {
        "s18_ladder_times": ladder_times,
        **{f"fp_v{v}_digests": _digests(v) for v in (3, 5, 6, 7, 8)},
        "fp_v4_anchor_pairs": anchor_pairs,
        "fp_v11_end_anchors": end_anchors,
        "fp_v12_verdicts": lambda s, d: T.subset_verdicts(_pairs(_times(s, d))),
        "fp_v13_verdicts": lambda s, d: T.hashed_verdicts(_pairs(_times(s, d)), False),
        "fp_v14_verdicts": lambda s, d: T.hashed_verdicts(_pairs(P.without_cadence(_times(s, d), 1, 4)), True),
    }


_FRAMES = f"""WITH fr AS (SELECT *, idx * {STEP} AS t_ms, CAST('0x' || phash[1:8] AS BIGINT) AS hi, CAST('0x' || phash[9:16] AS BIGINT) AS lo FROM (SELECT user_id AS film_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, sha256(CAST(event_id % 50 AS VARCHAR))[1:16] AS phash, value AS x FROM events)),
  films AS (SELECT film_id, max(t_ms) + {STEP} AS d, count(*) AS n FROM fr GROUP BY film_id)"""
_BODY = ", c AS (SELECT film_id, d, least(greatest(d // 20, 60000), 300000) AS c FROM films), body AS (SELECT film_id, c AS lo, greatest(c + 1, d - c) AS hi FROM c)"
_SOUND = f""", s AS (SELECT film_id, idx, round(sum(x) OVER (PARTITION BY film_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) / 6, 6) AS s FROM fr),
  b AS (SELECT film_id, d, n, d < 1800000 AS short FROM films WHERE n >= 30),
  w AS (SELECT film_id, least(n, CAST(floor(CASE WHEN short THEN floor(d * 0.05e0) ELSE 180000 END / {STEP}) AS BIGINT)) AS s_lo, least(n, CAST(floor(CASE WHEN short THEN floor(d * 0.20e0) ELSE 1080000 END / {STEP}) AS BIGINT)) AS s_hi,
    least(n, CAST(floor(CASE WHEN short THEN floor(d * 0.80e0) ELSE d - 1200000 END / {STEP}) AS BIGINT)) AS e_lo, least(n, CAST(floor(CASE WHEN short THEN floor(d * 0.95e0) ELSE d - 300000 END / {STEP}) AS BIGINT)) AS e_hi FROM b),
  a AS (SELECT film_id, arg_max(idx, (s, -idx)) AS st FROM s JOIN w USING (film_id) WHERE idx >= s_lo AND idx < s_hi GROUP BY film_id),
  body AS (SELECT film_id, st * {STEP} AS lo, arg_max(idx, (s, -idx)) * {STEP} AS hi FROM s JOIN w USING (film_id) JOIN a USING (film_id) WHERE idx >= greatest(e_lo, st + 2) AND idx < e_hi GROUP BY film_id, st)"""


def _digest_sql(version: int) -> str:
    heard = version in (7, 8)
    part = "CAST(i AS DOUBLE) / 10" if heard else "(CAST(i AS DOUBLE) + 0.5) / 10"
    at = f", p AS (SELECT film_id, lo, hi - lo AS span, i, round({part}, 6) AS tau, CAST(floor(lo + {part} * (hi - lo)) AS BIGINT) AS target FROM body, range({11 if heard else 10}) r(i))"
    if version in (3, 7):
        picked = ", x AS (SELECT p.film_id, span, i, tau, target AS t_ms, phash FROM p ASOF JOIN fr ON fr.film_id = p.film_id AND p.target <= fr.t_ms)"
    else:
        order = "(x, -t_ms)" if version == 5 else "(CASE WHEN prev_hi IS NULL THEN -1 ELSE bit_count(xor(hi, prev_hi)) + bit_count(xor(lo, prev_lo)) END, phash, -t_ms)"
        picked = f""", q AS (SELECT p.film_id, span, i, tau, fr.t_ms, fr.phash, fr.x, fr.hi, fr.lo, lag(fr.hi) OVER v AS prev_hi, lag(fr.lo) OVER v AS prev_lo, row_number() OVER v AS nth FROM p JOIN fr ON fr.film_id = p.film_id
            AND fr.t_ms >= greatest(p.lo, target - {2 * STEP}) AND fr.t_ms < greatest(p.lo, target - {2 * STEP}) + {4 * STEP} WINDOW v AS (PARTITION BY p.film_id, i ORDER BY fr.t_ms)),
          x AS (SELECT film_id, span, i, tau, arg_max(t_ms, {order}) AS t_ms, arg_max(phash, {order}) AS phash FROM q WHERE nth <= 5 GROUP BY ALL)"""
    return _FRAMES + (_SOUND if heard else _BODY) + at + picked + f""" SELECT film_id, span AS body_span_ms, count(*) AS n_anchors, arg_max(t_ms, i) - arg_min(t_ms, i) AS extreme_gap_ms,
      sha256('v{version}|span=' || span // 1000 || '|' || string_agg(lpad(CAST(CAST(round(tau / 0.0005) AS BIGINT) AS VARCHAR), 5, '0') || ':' || phash, '|' ORDER BY i)) AS digest FROM x GROUP BY film_id, span HAVING count(*) >= 2"""


_KF = with_("keyframes", recursive=True) + ", kf AS (SELECT DISTINCT film_id, t_ms // 1000 AS t_ms FROM keyframes)"
_PAIRS = """, gaps AS (SELECT film_id, t_ms, t_ms - lag(t_ms) OVER (PARTITION BY film_id ORDER BY t_ms) AS gap FROM tt),
  lists AS (SELECT film_id, list(t_ms ORDER BY t_ms) AS times FROM tt GROUP BY film_id),
  anchors AS (SELECT film_id, list(t_ms ORDER BY t_ms) AS t FROM (SELECT film_id, t_ms FROM gaps WHERE gap IS NOT NULL QUALIFY row_number() OVER (PARTITION BY film_id ORDER BY gap DESC, t_ms) <= 25) GROUP BY film_id),
  fg AS (SELECT film_id, times AS f, list_transform(list_filter(times, lambda y, i: y >= 22000 AND (film_id % 3 <> 0 OR (i - 1) % 3 <> 2)), lambda y: CASE WHEN film_id % 7 = 0 THEN y + y // 10 ELSE y - 22000 END) AS g,
    list_transform(t, lambda y: {'t_ms': y, 'phash': sha256(film_id || '-' || y)[1:16]}) AS fa, list_transform(list_filter(t, lambda y: y >= 22000), lambda y: {'t_ms': y - 22000, 'phash': sha256(film_id || CASE WHEN film_id % 4 = 0 THEN '+' ELSE '-' END || y)[1:16]}) AS ga FROM lists JOIN anchors USING (film_id)),
  pairs AS (SELECT film_id AS pair_id, CASE WHEN film_id % 2 = 1 THEN g ELSE f END AS a, CASE WHEN film_id % 2 = 1 THEN f ELSE g END AS b, CASE WHEN film_id % 2 = 1 THEN ga ELSE fa END AS aa, CASE WHEN film_id % 2 = 1 THEN fa ELSE ga END AS ba FROM fg),
  sides AS (SELECT pair_id, len(a) <= len(b) AS a_short, CASE WHEN len(a) <= len(b) THEN a ELSE b END AS short, CASE WHEN len(a) <= len(b) THEN b ELSE a END AS long FROM pairs)"""
_HASHED = """, m AS (SELECT pair_id, ta, arg_min({'h': ha, 'g': y.phash, 'off': abs(y.t_ms - ta - forth)}, (abs(y.t_ms - ta - forth), y.t_ms)) AS v
    FROM (SELECT pair_id, forth, x.t_ms AS ta, x.phash AS ha, unnest(ba) AS y FROM (SELECT pair_id, forth, ba, unnest(aa) AS x FROM pairs JOIN timed USING (pair_id) WHERE fraction >= 0.55)) GROUP BY pair_id, ta),
  bits AS (SELECT pair_id, bit_count(xor(CAST('0x' || v.h[1:8] AS BIGINT), CAST('0x' || v.g[1:8] AS BIGINT))) + bit_count(xor(CAST('0x' || v.h[9:16] AS BIGINT), CAST('0x' || v.g[9:16] AS BIGINT))) AS bits FROM m WHERE v.off <= 5000),
  h AS (SELECT pair_id, count(*) AS compared, count(*) FILTER (bits <= 20) AS close FROM bits GROUP BY pair_id),
  k AS (SELECT pair_id, CASE WHEN least(len(a), len(b)) < 30 OR len(aa) = 0 OR len(ba) = 0 THEN 'insufficient' WHEN fraction < 0.55 THEN 'timing' ELSE 'compared' END AS outcome, matched, fraction, coalesce(compared, 0) AS compared, coalesce(close, 0) AS close, forth FROM pairs LEFT JOIN timed USING (pair_id) LEFT JOIN h USING (pair_id))
  SELECT pair_id, outcome, CASE WHEN outcome = 'insufficient' THEN 0 ELSE matched END AS matched, CASE WHEN outcome = 'insufficient' THEN 0.0 ELSE fraction END AS fraction, compared, close, CASE WHEN outcome = 'insufficient' THEN 0 ELSE {sign}forth END AS trim, outcome = 'compared' AND compared > 0 AND close >= 0.40 * compared AS same FROM k"""


def oracle_sql():
    subset = _KF + ", tt AS (SELECT * FROM kf)" + _PAIRS + match_sql()
    return {
        "s18_ladder_times": """WITH r AS (SELECT user_id AS film_id, CAST(ascii(event_type) AS BIGINT) AS rung, epoch_us(ts) // 1000 AS t_ms FROM events), c AS (SELECT film_id, rung, count(*) AS n FROM r GROUP BY ALL),
          b AS (SELECT film_id, arg_min(rung, (CASE WHEN n >= 15 THEN 0 ELSE 1 END, CASE WHEN n >= 15 THEN 0 ELSE -n END, rung)) AS rung FROM c GROUP BY film_id) SELECT film_id, rung, t_ms FROM r JOIN b USING (film_id, rung)""",
        **{f"fp_v{v}_digests": _digest_sql(v) for v in (3, 5, 6, 7, 8)},
        "fp_v4_anchor_pairs": _FRAMES
        + _BODY
        + """, w AS (SELECT film_id, side, s, greatest(e, s + 1000) AS e FROM (SELECT film_id, 'a' AS side, lo + CAST(floor((hi - lo) * 0.05e0) AS BIGINT) AS s, lo + CAST(floor((hi - lo) * 0.15e0) AS BIGINT) AS e FROM body
            UNION ALL SELECT film_id, 'b', lo + CAST(floor((hi - lo) * 0.85e0) AS BIGINT), lo + CAST(floor((hi - lo) * 0.95e0) AS BIGINT) FROM body)),
          x AS (SELECT fr.*, side FROM fr JOIN w ON w.film_id = fr.film_id AND t_ms >= s AND t_ms < e),
          o AS (SELECT film_id, side, p, 2 * sum((hi >> p) & 1) > count(*) AS h, 2 * sum((lo >> p) & 1) > count(*) AS l FROM x, (SELECT CAST(range AS INTEGER) AS p FROM range(32)) GROUP BY ALL),
          mean AS (SELECT film_id, side, CAST(sum(CASE WHEN h THEN 1::BIGINT << p ELSE 0 END) AS BIGINT) AS mh, CAST(sum(CASE WHEN l THEN 1::BIGINT << p ELSE 0 END) AS BIGINT) AS ml FROM o GROUP BY ALL),
          k AS (SELECT film_id, side, arg_max({'t': t_ms, 'h': phash}, (bit_count(xor(hi, mh)) + bit_count(xor(lo, ml)), -t_ms)) AS k FROM x JOIN mean USING (film_id, side) GROUP BY ALL)
          SELECT film_id, a.k.t AS a_ms, a.k.h AS a_hash, b.k.t AS b_ms, b.k.h AS b_hash, b.k.t - a.k.t AS gap_ms, sha256('v4|' || a.k.h || '|' || (b.k.t - a.k.t) // 1000 || '|' || b.k.h) AS digest FROM (FROM k WHERE side = 'a') a JOIN (FROM k WHERE side = 'b') b USING (film_id)""",
        "fp_v11_end_anchors": _KF
        + """, t AS (SELECT film_id, CASE WHEN film_id % 5 = 0 THEN (row_number() OVER (PARTITION BY film_id ORDER BY t_ms) - 1) * 31000 ELSE t_ms END AS t_ms FROM kf),
          f AS (SELECT film_id, max(t_ms) + 20000 AS d, count(*) AS n FROM t GROUP BY film_id),
          i AS (SELECT t.film_id, t_ms, d, t_ms - lag(t_ms) OVER (PARTITION BY t.film_id ORDER BY t_ms) AS gap FROM t JOIN f USING (film_id) WHERE t_ms BETWEEN floor(d * 0.05e0) AND floor(d * 0.95e0)),
          c AS (SELECT film_id, count(*) AS n_body, coalesce(round(stddev_pop(gap) / avg(gap), 6), 0.0) < 0.2 AND count(*) >= 10 AS fixed FROM i GROUP BY film_id),
          g AS (SELECT film_id, d - 300000 - j * 180000 AS target FROM f, range(25) r(j) WHERE d - 300000 - j * 180000 >= 0),
          near AS (SELECT DISTINCT film_id, hit FROM (SELECT g.film_id, target, arg_min(t_ms, (abs(t_ms - target), t_ms)) AS hit FROM g JOIN i USING (film_id) GROUP BY ALL)),
          r AS (SELECT *, row_number() OVER (PARTITION BY film_id ORDER BY hit) AS k FROM near),
          s(film_id, k, last, kept) AS (SELECT film_id, k, hit, TRUE FROM r WHERE k = 1 UNION ALL SELECT s.film_id, r.k, CASE WHEN r.hit - s.last >= 30000 THEN r.hit ELSE s.last END, r.hit - s.last >= 30000 FROM s JOIN r ON r.film_id = s.film_id AND r.k = s.k + 1),
          l AS (SELECT film_id, list(last ORDER BY last) AS p FROM s WHERE kept GROUP BY film_id),
          o AS (SELECT film_id, n, coalesce(n_body, 0) AS n_body, CASE WHEN n < 10 THEN 'keyframes' WHEN coalesce(n_body, 0) < 10 THEN 'body' WHEN fixed THEN 'even' WHEN coalesce(len(p), 0) < 5 THEN 'peaks' ELSE 'ok' END AS outcome, p FROM f LEFT JOIN c USING (film_id) LEFT JOIN l USING (film_id))
          SELECT film_id, outcome, n AS n_keyframes, n_body, CASE WHEN outcome = 'ok' THEN len(p) END AS n_peaks, CASE WHEN outcome = 'ok' THEN p[1] END AS first_ms, CASE WHEN outcome = 'ok' THEN p[-1] END AS last_ms, CASE WHEN outcome = 'ok' THEN p[len(p) - 1] - p[2] END AS inner_span_ms FROM o""",
        "fp_v12_verdicts": subset + """ SELECT pairs.pair_id, CASE WHEN least(len(a), len(b)) < 30 THEN 'insufficient' ELSE 'compared' END AS outcome, coalesce(matched, 0) AS matched, coalesce(fraction, 0.0) AS fraction, coalesce(-"offset", 0) AS trim, coalesce(fraction >= 0.70, FALSE) AS same
          FROM pairs LEFT JOIN o ON o.pair_id = pairs.pair_id""",
        "fp_v13_verdicts": subset + ', timed AS (SELECT pair_id, matched, fraction, -"offset" AS forth FROM o)' + _HASHED.replace("{sign}", ""),
        "fp_v14_verdicts": _KF
        + ", tt AS (SELECT film_id, t_ms FROM (SELECT film_id, t_ms, t_ms - lag(t_ms) OVER (PARTITION BY film_id ORDER BY t_ms) AS gap FROM kf) QUALIFY gap IS NULL OR count(*) OVER (PARTITION BY film_id, gap) < 4)"
        + _PAIRS
        + """, sl AS (SELECT *, unnest(range(len(long) - len(short) + 1)) AS spot FROM sides WHERE len(short) >= 30),
          ag AS (SELECT pair_id, a_short, spot, long[spot + 1] - short[1] AS off, len(short) - 1 AS n, len(list_filter(range(2, len(short) + 1), lambda i: abs((short[i] - short[i - 1]) - (long[i + spot] - long[i + spot - 1])) <= 5000)) AS same FROM sl),
          be AS (SELECT pair_id, arg_max({'n': n, 'same': same, 'off': off, 'a': a_short}, (same, -spot)) AS b FROM ag GROUP BY pair_id),
          timed AS (SELECT pair_id, b.same AS matched, round(b.same / CAST(b.n AS DOUBLE), 6) AS fraction, CASE WHEN b.a THEN b.off ELSE -b.off END AS forth FROM be)"""
        + _HASHED.replace("{sign}", "-"),
    }
