"""Registered queries on fingerprints, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import fingerprints as P
from ..session import table
from ..sources import adapters as A
from ..sources.adapters import with_


def _times(s, d):
    """Event times as keyframes, a second of the log as a millisecond of film."""
    return A.keyframes(s, d).select("film_id", F.expr("t_ms div 1000").alias("t_ms")).distinct()


_TIMES = with_("keyframes") + ", kf AS (SELECT DISTINCT film_id, t_ms // 1000 AS t_ms FROM keyframes), gaps AS (SELECT film_id, t_ms, t_ms - lag(t_ms) OVER (PARTITION BY film_id ORDER BY t_ms) AS gap FROM kf)"


def _samples(s, d):
    return A.loudness(s, d).select("film_id", "idx", F.round(F.col("momentary") / 10, 6).alias("x"))


_SAMPLES = with_("loudness") + ", samples AS (SELECT film_id, idx, round(momentary / 10, 6) AS x FROM loudness)"
_SAMPLES_R = with_("loudness", recursive=True) + ", samples AS (SELECT film_id, idx, round(momentary / 10, 6) AS x FROM loudness)"


def _hashes(s, d):
    """vec_id, film_id (label), phash of each vector as an 8 x 8 block."""
    return table(s, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("film_id"), P.block_hash(F.col("embedding")).alias("phash"))


_BITS = "'0' || array_to_string(list_transform(embedding[2:64], lambda x: CASE WHEN x > list_sort(embedding[2:64])[32] THEN '1' ELSE '0' END), '')"
_HASHES = f"WITH bits AS (SELECT vec_id, CAST(label AS BIGINT) AS film_id, {_BITS} AS b FROM embeddings), hashes AS (SELECT vec_id, film_id, b, lower(lpad(to_hex(CAST(CAST(list_reduce(list_transform(string_split(b, '')[1:32], lambda x: CAST(x AS BIGINT)), lambda a, x: a * 2 + x) AS BIGINT) AS BIGINT)), 8, '0') || lpad(to_hex(list_reduce(list_transform(string_split(b, '')[33:64], lambda x: CAST(x AS BIGINT)), lambda a, x: a * 2 + x)), 8, '0')) AS phash FROM bits)"


def _lists(s, d):
    return _times(s, d).groupBy("film_id").agg(F.array_sort(F.collect_list("t_ms")).alias("times"))


def _film_pairs(s, d):
    """Each film with a copy that lacks its first 20 seconds and is moved by 22, and with the next film."""
    x = _lists(s, d)
    copy = x.select((F.col("film_id") * 2).alias("pair_id"), F.col("times").alias("a"), F.transform(F.filter("times", lambda t: t >= 22000), lambda t: t - 22000).alias("b"))
    other = x.alias("x").join(x.alias("y"), F.col("x.film_id") + 1 == F.col("y.film_id")).select((F.col("x.film_id") * 2 + 1).alias("pair_id"), F.col("x.times").alias("a"), F.col("y.times").alias("b"))
    return copy.unionByName(other)


def matches(s, d):
    return P.match(_film_pairs(s, d), tolerance=2000, most_offset=600_000, least=30)


def peak_verdicts(s, d):
    """Peaks of a film and of its copy with every fourth moved: share of gaps within 5000, share of hashes within 20 bits."""
    a = P.anchors(_times(s, d), 12).select("film_id", "t_ms")
    lists = a.groupBy("film_id").agg(F.array_sort(F.collect_list("t_ms")).alias("p"))
    moved = F.transform("p", lambda t, i: F.when(i % 4 == 3, t + 9000).otherwise(t + 400))
    rows = lists.withColumn("q", moved).where("size(p) >= 4").withColumn("gp", F.expr("slice(zip_with(slice(p, 2, 100), slice(p, 1, size(p) - 1), (x, y) -> x - y), 1, size(p) - 1)")).withColumn("gq", F.expr("slice(zip_with(slice(q, 2, 100), slice(q, 1, size(q) - 1), (x, y) -> x - y), 1, size(q) - 1)"))
    ok = F.size(F.filter(F.zip_with("gp", "gq", lambda x, y: F.abs(x - y) <= 5000), lambda b: b))
    trim = P.upper_median(F.zip_with("p", "q", lambda x, y: x - y))
    inner = F.get("p", F.size("p") - 2) - F.get("p", F.lit(1))
    return rows.select("film_id", F.size("p").cast("long").alias("n"), F.round(ok / F.size("gp"), 6).alias("gap_fraction"), trim.alias("trim"), inner.alias("inner_span"))


def bucket_pairs(s, d):
    """Films that share a rounded minute of duration, half to even."""
    b = _times(s, d).groupBy("film_id").agg(F.max("t_ms").alias("duration")).withColumn("bucket", F.expr("cast(bround(duration / 60000.0) as long)"))
    n = b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("film_id").alias("first_film"))
    return n.where("n > 1").select("bucket", F.expr("n * (n - 1) div 2").alias("n_pairs"), "first_film")


def body_frames(s, d):
    """Times in the film's body, 5 % to 95 %, and inside its cushion of 5 %, at least 60 s and at most 5 minutes."""
    t = _times(s, d).withColumn("duration", F.max("t_ms").over(W.partitionBy("film_id")))
    cushion = F.least(F.greatest(F.expr("duration div 20"), F.lit(60_000)), F.lit(300_000))
    body = F.col("t_ms").between(F.expr("duration div 20"), F.expr("duration * 95 div 100"))
    return t.where(body).select("film_id", "t_ms", F.col("t_ms").between(cushion, F.greatest(F.col("duration") - cushion, cushion + 1)).alias("in_cushion"))


def even_samples(s, d):
    """Ten times of each film at places int(i * n / 10)."""
    x = _lists(s, d)
    return x.select("film_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct(i.cast("long").alias("i"), F.get("times", F.floor(i * F.size("times") / 10).cast("int")).alias("t_ms")))).alias("p")).select("film_id", "p.i", "p.t_ms")


def targets(s, d):
    """Every 150 s of film, 60 s in from both ends, with the nearest keyframe."""
    span = _times(s, d).groupBy("film_id").agg(F.max("t_ms").alias("duration"))
    t = span.select("film_id", F.explode(F.sequence(F.lit(60_000).cast("long"), F.col("duration") - 60_000, F.lit(150_000).cast("long"))).alias("target"))
    return P.nearest_time(t, _times(s, d))


def near_anchors(s, d):
    """Anchors of a film and of its copy moved by 300: the nearest within 2000."""
    a = P.anchors(_times(s, d), 10)
    near = P.nearest_time(a.select("film_id", (F.col("t_ms") + 300).alias("target")), a)
    return near.withColumn("off", F.abs(F.col("target") - F.col("nearest"))).where("off <= 2000")


def slides(s, d):
    g = P.gaps(_times(s, d)).where("gap IS NOT NULL").groupBy("film_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t_ms", "gap"))), lambda x: x["gap"]).alias("long"))
    return P.slide(g.select(F.col("film_id").alias("pair_id"), F.slice("long", 6, 12).alias("short"), "long"), 1500)


def subset_match(s, d):
    """Share of a film's anchors found in order among all its times."""
    a = P.anchors(_times(s, d), 20).groupBy("film_id").agg(F.array_sort(F.collect_list("t_ms")).alias("short"))
    rows = a.join(_lists(s, d), "film_id")
    n = F.size(P.paired(F.col("short"), F.col("times"), F.lit(700), 500))
    return rows.select("film_id", n.cast("long").alias("matched"), F.round(n / F.size("short"), 6).alias("fraction"))


def loudest(s, d):
    """The loudest sample among the first 20 and, at least 10 later, among the last 20; the first of equals."""
    x = _samples(s, d).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("film_id")))
    key = F.struct("x", (-F.col("idx")).alias("m"))
    first = x.groupBy("film_id").agg(F.max(F.when(F.col("idx") < 20, key)).alias("a"))
    late = x.join(first, "film_id").where((F.col("idx") >= F.col("n") - 20) & (F.col("idx") >= 10 - F.col("a.m")))
    return late.groupBy("film_id").agg((-F.first("a.m")).alias("start_idx"), (-F.max(key)["m"]).alias("end_idx"))


def ladder(s, d):
    """Three ways to get keyframes: the first with ten or more wins, else the longest."""
    x = _lists(s, d).withColumn("one", F.filter("times", lambda t: t % 11 == 0)).withColumn("two", F.filter("times", lambda t: t % 7 == 0)).withColumn("three", F.filter("times", lambda t: t % 5 == 0))
    size = lambda c: F.size(c).cast("long")
    return x.select("film_id", F.coalesce(*(F.when(F.size(c) >= 10, size(c)) for c in ("one", "two", "three")), F.greatest(size("one"), size("two"), size("three"))).alias("n"))


def run_lengths(s, d):
    """Sample durations as runs: lineitems of an order. Lines alike in number, supplier and duration are put in order by their count, so that reruns agree."""
    r = table(s, d, "lineitem").select(F.col("l_orderkey").alias("film_id"), F.col("l_linenumber").cast("long").alias("ord"), F.col("l_quantity").cast("long").alias("n"), (F.col("l_partkey") % 97 + 1).alias("delta"), "l_suppkey")
    w = W.partitionBy("film_id").orderBy("ord", "l_suppkey", "delta", "n")
    return P.sample_times(r.withColumn("ord", F.row_number().over(w).cast("long")), 90)


def variance_pick(s, d):
    """Of each label the vector with the largest variance, the earliest of equals."""
    v = table(s, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.explode("embedding").alias("x"))
    one = v.groupBy("label", "vec_id").agg(F.round(F.var_pop(F.col("x").cast("double")), 6).alias("variance"))
    return one.groupBy("label").agg(F.max(F.struct("variance", (-F.col("vec_id")).alias("m"))).alias("b")).select("label", (-F.col("b.m")).alias("vec_id"), F.col("b.variance").alias("variance"))


def _most_changed(h):
    """Of each film the hash that differs most from the one before, the larger hash of equals."""
    w = W.partitionBy("film_id").orderBy("vec_id")
    rows = h.withColumn("prev", F.lag("phash").over(w)).where("prev IS NOT NULL")
    best = rows.select("film_id", P.hamming(F.col("phash"), F.col("prev")).cast("long").alias("bits"), "phash").groupBy("film_id").agg(F.max(F.struct("bits", "phash")).alias("b"))
    return best.select("film_id", "b.bits", "b.phash")


def hash_neighbours(s, d):
    """Pairs of hashes of one label within 22 bits."""
    return P.close_hashes(_hashes(s, d), 22)


def order_statistics(s, d):
    """Median, upper median and spread of each film's gaps."""
    g = P.gaps(_times(s, d)).where("gap IS NOT NULL").groupBy("film_id").agg(F.collect_list("gap").alias("a"))
    return g.select("film_id", F.round(P.median(F.col("a")), 6).alias("median"), P.upper_median(F.col("a")).alias("upper"), F.round(P.spread(F.col("a")), 6).alias("mad"))


def queries():
    return {
        "w7_gaps": lambda s, d: P.gaps(_times(s, d)),
        "a10_order_statistics": order_statistics,
        "a15_cadence": lambda s, d: P.cadence(_times(s, d)),
        "a16_without_cadence": lambda s, d: P.without_cadence(_times(s, d), 5000, 4),
        "w15_anchors": lambda s, d: P.anchors(_times(s, d), 12),
        "a14_rms_blocks": lambda s, d: P.rms(_samples(s, d), 8).withColumn("rms", F.round("rms", 6)),
        "w8_smoothed": lambda s, d: P.smooth(_samples(s, d), "x", 5, 4).select("film_id", "idx", F.round("smooth", 6).alias("smooth")),
        "w9_peaks": lambda s, d: P.peaks(_samples(s, d), "x", 8, 4),
        "w10_spaced_times": lambda s, d: P.spaced(_times(s, d), 60_000),
        "p_block_hashes": lambda s, d: _hashes(s, d),
        "a17_majority_hash": lambda s, d: P.majority_hash(_hashes(s, d)),
        "a18_variance_pick": variance_pick,
        "w11_most_changed": lambda s, d: _most_changed(_hashes(s, d)),
        "j16_hash_neighbours": hash_neighbours,
        "j16_bucket_pairs": bucket_pairs,
        "j10_film_matches": matches,
        "j11_peak_verdicts": peak_verdicts,
        "p20_body_frames": body_frames,
        "o7_even_samples": even_samples,
        "j13_nearest_keyframe": targets,
        "j12_nearest_anchor": near_anchors,
        "j15_gap_slide": slides,
        "j9_subset_match": subset_match,
        "w17_loudest_ends": loudest,
        "s18_keyframe_ladder": ladder,
        "w6_sample_times": run_lengths,
    }


_NEAR = "SELECT t.film_id, t.target, CASE WHEN a.t_ms IS NULL OR (b.t_ms IS NOT NULL AND t.target - b.t_ms <= a.t_ms - t.target) THEN b.t_ms ELSE a.t_ms END AS nearest FROM {t} t ASOF LEFT JOIN {k} b ON b.film_id = t.film_id AND t.target >= b.t_ms ASOF LEFT JOIN {k} a ON a.film_id = t.film_id AND t.target <= a.t_ms"


def _bits(a: str, b: str) -> str:
    return f"CAST(list_sum(list_transform(list_zip(string_split({a}, ''), string_split({b}, '')), lambda p: CASE WHEN p[1] = p[2] THEN 0 ELSE 1 END)) AS BIGINT)"


def match_sql():
    """From sides (pair_id, a_short, short, long) to o, what `fingerprints.match` gives but for the verdict."""
    fold = """, tried AS (SELECT pair_id, short, long, a_short, off, row_number() OVER (PARTITION BY pair_id ORDER BY first_ord) AS ord FROM (SELECT pair_id, any_value(short) AS short, any_value(long) AS long, any_value(a_short) AS a_short, off, min(o) AS first_ord FROM (
            SELECT pair_id, short, long, a_short, unnest(list_concat(list_transform(long[1:50], lambda y: y - short[1]), list_transform(list_reverse(long[greatest(1, len(long) - 49):]), lambda y: y - short[-1]))) AS off, unnest(range(least(50, len(long)) * 2)) AS o FROM sides WHERE len(short) >= 30) WHERE abs(off) <= 600000 GROUP BY pair_id, off)),
          f(pair_id, ord, i, j, n, diffs) AS (SELECT pair_id, ord, 0, 0, 0, CAST([] AS BIGINT[]) FROM tried
            UNION ALL SELECT f.pair_id, f.ord, f.i + 1, CASE WHEN x.hit <= x.s + t.off + 2000 THEN x.k + 1 ELSE x.k END, CASE WHEN x.hit <= x.s + t.off + 2000 THEN f.n + 1 ELSE f.n END,
              CASE WHEN x.hit <= x.s + t.off + 2000 THEN list_append(f.diffs, x.hit - x.s) ELSE f.diffs END
            FROM f JOIN tried t ON t.pair_id = f.pair_id AND t.ord = f.ord AND f.i < len(t.short),
            LATERAL (SELECT t.short[f.i + 1] AS s, greatest(f.j, len(list_filter(t.long, lambda y: y < t.short[f.i + 1] + t.off - 2000))) AS k, t.long[greatest(f.j, len(list_filter(t.long, lambda y: y < t.short[f.i + 1] + t.off - 2000))) + 1] AS hit) x),
          best AS (SELECT f.pair_id, arg_max({'off': t.off, 'n': f.n, 'diffs': f.diffs, 'a_short': t.a_short, 'size': len(t.short)}, (f.n, -f.ord)) AS b FROM f JOIN tried t ON t.pair_id = f.pair_id AND t.ord = f.ord WHERE f.i = len(t.short) GROUP BY f.pair_id),
          o AS (SELECT pair_id, CASE WHEN b.a_short THEN -b.off ELSE b.off END AS "offset", CAST(b.n AS BIGINT) AS matched, round(b.n / CAST(b.size AS DOUBLE), 6) AS fraction, coalesce(list_median(list_transform(b.diffs, lambda x: abs(x - list_median(b.diffs)))), 0.0) AS spread, CASE WHEN b.a_short THEN -1 ELSE 1 END * list_sort(b.diffs)[len(b.diffs) // 2 + 1] AS trim FROM best)"""
    fold = fold.replace("list_median(list_transform(b.diffs, lambda x: abs(x - list_median(b.diffs))))", "list_aggregate(list_transform(b.diffs, lambda x: abs(x - list_aggregate(b.diffs, 'median'))), 'median')")
    return fold


def oracle_sql():
    fold = match_sql()
    lists = ", lists AS (SELECT film_id, list(t_ms ORDER BY t_ms) AS times FROM kf GROUP BY film_id)"
    anchors = lambda k: f", anchors AS (SELECT film_id, t_ms, gap FROM gaps WHERE gap IS NOT NULL QUALIFY row_number() OVER (PARTITION BY film_id ORDER BY gap DESC, t_ms) <= {k})"
    return {
        "w7_gaps": _TIMES + " SELECT * FROM gaps",
        "a10_order_statistics": _TIMES + ", l AS (SELECT film_id, list(gap ORDER BY gap) AS a FROM gaps WHERE gap IS NOT NULL GROUP BY film_id) SELECT film_id, round(list_aggregate(a, 'median'), 6) AS median, a[len(a) // 2 + 1] AS upper, round(list_aggregate(list_transform(a, lambda x: abs(x - list_aggregate(a, 'median'))), 'median'), 6) AS mad FROM l",
        "a15_cadence": _TIMES + " SELECT film_id, count(*) AS n, coalesce(round(stddev_pop(gap) / avg(gap), 6), 0.0) AS cv, count(*) >= 10 AND coalesce(round(stddev_pop(gap) / avg(gap), 6), 0.0) < 0.2 AS fixed FROM gaps GROUP BY film_id",
        "a16_without_cadence": _TIMES + " SELECT film_id, t_ms FROM gaps QUALIFY gap IS NULL OR count(*) OVER (PARTITION BY film_id, gap // 5000) < 4",
        "w15_anchors": _TIMES + anchors(12) + " SELECT * FROM anchors",
        "a14_rms_blocks": _SAMPLES + " SELECT film_id, idx // 8 AS block, round(sqrt(avg(x * x)), 6) AS rms FROM samples GROUP BY ALL HAVING count(*) = 8",
        "w8_smoothed": _SAMPLES + " SELECT film_id, idx, round(sum(x) OVER (PARTITION BY film_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10, 6) AS smooth FROM samples",
        "w9_peaks": _SAMPLES_R + """, r AS (SELECT *, row_number() OVER (PARTITION BY film_id ORDER BY x DESC, idx) AS k FROM samples),
            f(film_id, k, taken, kept, idx, x) AS (SELECT film_id, k, [idx], TRUE, idx, x FROM r WHERE k = 1
              UNION ALL SELECT f.film_id, r.k, CASE WHEN len(f.taken) < 8 AND len(list_filter(f.taken, lambda y: abs(y - r.idx) <= 4)) = 0 THEN list_append(f.taken, r.idx) ELSE f.taken END, len(f.taken) < 8 AND len(list_filter(f.taken, lambda y: abs(y - r.idx) <= 4)) = 0, r.idx, r.x FROM f JOIN r ON r.film_id = f.film_id AND r.k = f.k + 1)
            SELECT film_id, idx, x FROM f WHERE kept""",
        "w10_spaced_times": with_("keyframes", recursive=True) + """, kf AS (SELECT DISTINCT film_id, t_ms // 1000 AS t_ms FROM keyframes), r AS (SELECT *, row_number() OVER (PARTITION BY film_id ORDER BY t_ms) AS k FROM kf),
            f(film_id, k, last, kept) AS (SELECT film_id, k, t_ms, TRUE FROM r WHERE k = 1 UNION ALL SELECT f.film_id, r.k, CASE WHEN r.t_ms - f.last >= 60000 THEN r.t_ms ELSE f.last END, r.t_ms - f.last >= 60000 FROM f JOIN r ON r.film_id = f.film_id AND r.k = f.k + 1)
            SELECT film_id, last AS t_ms FROM f WHERE kept""",
        "p_block_hashes": _HASHES + " SELECT vec_id, film_id, phash FROM hashes",
        "a17_majority_hash": _HASHES + ", c AS (SELECT film_id, pos, count(*) FILTER (b[CAST(pos AS INTEGER)] = '1') * 2 > count(*) AS one FROM hashes CROSS JOIN range(1, 65) p(pos) GROUP BY ALL), j AS (SELECT film_id, list(CASE WHEN one THEN 1 ELSE 0 END ORDER BY pos) AS l FROM c GROUP BY film_id) SELECT film_id, lower(lpad(to_hex(list_reduce(list_transform(l[1:32], lambda x: CAST(x AS BIGINT)), lambda a, x: a * 2 + x)), 8, '0') || lpad(to_hex(list_reduce(list_transform(l[33:64], lambda x: CAST(x AS BIGINT)), lambda a, x: a * 2 + x)), 8, '0')) AS phash FROM j",
        "a18_variance_pick": "WITH v AS (SELECT vec_id, CAST(label AS BIGINT) AS label, round(list_aggregate(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), 'var_pop'), 6) AS variance FROM embeddings) SELECT label, arg_max(vec_id, (variance, -vec_id)) AS vec_id, max(variance) AS variance FROM v GROUP BY label",
        "w11_most_changed": _HASHES + f", p AS (SELECT film_id, phash, b, lag(b) OVER (PARTITION BY film_id ORDER BY vec_id) AS pb FROM hashes), x AS (SELECT film_id, phash, {_bits('b', 'pb')} AS bits FROM p WHERE pb IS NOT NULL) SELECT film_id, max(bits) AS bits, arg_max(phash, (bits, phash)) AS phash FROM x GROUP BY film_id",
        "j16_hash_neighbours": _HASHES + f" SELECT * FROM (SELECT h.vec_id, o.vec_id AS other_id, {_bits('h.b', 'o.b')} AS bits FROM hashes h JOIN hashes o ON h.film_id = o.film_id AND h.vec_id < o.vec_id) WHERE bits <= 22",
        "j16_bucket_pairs": _TIMES + ", b AS (SELECT film_id, CAST(round_even(max(t_ms) / 60000.0, 0) AS BIGINT) AS bucket FROM kf GROUP BY film_id) SELECT a.bucket, count(*) AS n_pairs, min(a.film_id) AS first_film FROM b a JOIN b o ON a.bucket = o.bucket AND a.film_id < o.film_id GROUP BY a.bucket",
        "j10_film_matches": with_("keyframes", recursive=True) + ", kf AS (SELECT DISTINCT film_id, t_ms // 1000 AS t_ms FROM keyframes)" + lists + ", pairs AS (SELECT film_id * 2 AS pair_id, times AS a, list_transform(list_filter(times, lambda t: t >= 22000), lambda t: t - 22000) AS b FROM lists UNION ALL SELECT x.film_id * 2 + 1, x.times, y.times FROM lists x JOIN lists y ON y.film_id = x.film_id + 1), sides AS (SELECT pair_id, len(a) <= len(b) AS a_short, CASE WHEN len(a) <= len(b) THEN a ELSE b END AS short, CASE WHEN len(a) <= len(b) THEN b ELSE a END AS long FROM pairs)" + fold + " SELECT pair_id, \"offset\", matched, fraction, round(spread, 6) AS spread, trim, fraction >= 0.55 AND round(spread, 6) <= 250 AS same FROM o",
        "j11_peak_verdicts": _TIMES + anchors(12) + ", l AS (SELECT film_id, list(t_ms ORDER BY t_ms) AS p FROM anchors GROUP BY film_id), m AS (SELECT film_id, p, list_transform(p, lambda t, i: CASE WHEN (i - 1) % 4 = 3 THEN t + 9000 ELSE t + 400 END) AS q FROM l WHERE len(p) >= 4) SELECT film_id, CAST(len(p) AS BIGINT) AS n, round(len(list_filter(range(2, len(p) + 1), lambda i: abs((p[i] - p[i-1]) - (q[i] - q[i-1])) <= 5000)) / CAST(len(p) - 1 AS DOUBLE), 6) AS gap_fraction, list_sort(list_transform(range(1, len(p) + 1), lambda i: p[i] - q[i]))[len(p) // 2 + 1] AS trim, p[len(p) - 1] - p[2] AS inner_span FROM m",
        "p20_body_frames": _TIMES + ", d AS (SELECT film_id, t_ms, max(t_ms) OVER (PARTITION BY film_id) AS duration FROM kf), c AS (SELECT *, least(greatest(duration // 20, 60000), 300000) AS cushion FROM d) SELECT film_id, t_ms, t_ms BETWEEN cushion AND greatest(duration - cushion, cushion + 1) AS in_cushion FROM c WHERE t_ms BETWEEN duration // 20 AND duration * 95 // 100",
        "o7_even_samples": _TIMES + lists + " SELECT film_id, CAST(i AS BIGINT) AS i, times[i * len(times) // 10 + 1] AS t_ms FROM lists CROSS JOIN range(10) r(i)",
        "j13_nearest_keyframe": _TIMES + ", targets AS (SELECT film_id, unnest(range(60000, max(t_ms) - 60000 + 1, 150000)) AS target FROM kf GROUP BY film_id) " + _NEAR.format(t="targets", k="kf"),
        "j12_nearest_anchor": _TIMES + anchors(10) + ", targets AS (SELECT film_id, t_ms + 300 AS target FROM anchors), n AS (" + _NEAR.format(t="targets", k="anchors") + ") SELECT *, abs(target - nearest) AS off FROM n WHERE abs(target - nearest) <= 2000",
        "j15_gap_slide": _TIMES + ", g AS (SELECT film_id, list(gap ORDER BY t_ms) AS long FROM gaps WHERE gap IS NOT NULL GROUP BY film_id), s AS (SELECT film_id, long, long[6:17] AS short FROM g WHERE len(long) >= 6), x AS (SELECT film_id, shift, len(list_filter(range(1, len(short) + 1), lambda i: abs(short[i] - long[i + shift]) <= 1500)) AS n FROM (SELECT *, unnest(range(len(long) - len(short) + 1)) AS shift FROM s)) SELECT film_id AS pair_id, CAST(arg_max(shift, (n, -shift)) AS BIGINT) AS shift, CAST(max(n) AS BIGINT) AS agreeing FROM x GROUP BY film_id",
        "j9_subset_match": with_("keyframes", recursive=True) + ", kf AS (SELECT DISTINCT film_id, t_ms // 1000 AS t_ms FROM keyframes), gaps AS (SELECT film_id, t_ms, t_ms - lag(t_ms) OVER (PARTITION BY film_id ORDER BY t_ms) AS gap FROM kf)" + lists + anchors(20) + """, s AS (SELECT film_id, list(t_ms ORDER BY t_ms) AS short, any_value(times) AS times FROM anchors JOIN lists USING (film_id) GROUP BY film_id),
            f(film_id, i, j, n) AS (SELECT film_id, 0, 0, 0 FROM s UNION ALL SELECT f.film_id, f.i + 1, CASE WHEN s.times[x.k + 1] <= s.short[f.i + 1] + 1200 THEN x.k + 1 ELSE x.k END, CASE WHEN s.times[x.k + 1] <= s.short[f.i + 1] + 1200 THEN f.n + 1 ELSE f.n END FROM f JOIN s ON s.film_id = f.film_id AND f.i < len(s.short), LATERAL (SELECT greatest(f.j, len(list_filter(s.times, lambda y: y < s.short[f.i + 1] + 200))) AS k) x)
            SELECT f.film_id, CAST(f.n AS BIGINT) AS matched, round(f.n / CAST(len(s.short) AS DOUBLE), 6) AS fraction FROM f JOIN s USING (film_id) WHERE f.i = len(s.short)""",
        "w17_loudest_ends": _SAMPLES + ", c AS (SELECT *, count(*) OVER (PARTITION BY film_id) AS n FROM samples), a AS (SELECT film_id, arg_max(idx, (x, -idx)) AS start_idx FROM c WHERE idx < 20 GROUP BY film_id) SELECT film_id, start_idx, arg_max(idx, (x, -idx)) AS end_idx FROM c JOIN a USING (film_id) WHERE idx >= n - 20 AND idx >= start_idx + 10 GROUP BY ALL",
        "s18_keyframe_ladder": _TIMES + " SELECT film_id, CASE WHEN count(*) FILTER (t_ms % 11 = 0) >= 10 THEN count(*) FILTER (t_ms % 11 = 0) WHEN count(*) FILTER (t_ms % 7 = 0) >= 10 THEN count(*) FILTER (t_ms % 7 = 0) WHEN count(*) FILTER (t_ms % 5 = 0) >= 10 THEN count(*) FILTER (t_ms % 5 = 0) ELSE greatest(count(*) FILTER (t_ms % 11 = 0), count(*) FILTER (t_ms % 7 = 0), count(*) FILTER (t_ms % 5 = 0)) END AS n FROM kf GROUP BY film_id",
        "w6_sample_times": "WITH r AS (SELECT l_orderkey AS film_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey % 97 + 1) AS ord, CAST(l_quantity AS BIGINT) AS n, l_partkey % 97 + 1 AS delta FROM lineitem), t AS (SELECT film_id, ord, CAST(sum(n * delta) OVER (PARTITION BY film_id ORDER BY ord ROWS UNBOUNDED PRECEDING) - n * delta AS BIGINT) AS ticks FROM r) SELECT film_id, ord, ticks, (ticks * 1000) // 90 AS start_ms FROM t",
    }
