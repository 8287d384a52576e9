"""Registered queries of whole verdicts on films, with their DuckDB twins."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import films as V
from ..operators import fingerprints as P
from ..session import table, written
from ..sources import adapters as A
from ..sources import container_index as C
from ..sources.adapters import with_
from .matching import _lists, _times, match_sql

FINGERPRINT = "struct<kind:string,times:array<bigint>,peaks:array<struct<t_ms:bigint,phash:string>>>"


def pixel_hashes(s, d):
    """Vectors as frames of 32 x 32 pixels; of four neighbouring vectors the frames are one peak's, every seventh frame is cut short."""
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    pixel = lambda i: F.pmod(F.round(F.element_at("embedding", (F.pmod(i * 7 + F.floor(i / 32) * 11, F.lit(64)) + 1).cast("int")).cast("double") * 1000).cast("long") + i * F.floor(i / 32), F.lit(256))
    pixels = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(1023).cast("long")), pixel)
    frame = F.unhex(F.array_join(F.transform(pixels, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    e = e.withColumn("f", frame).withColumn("f", F.when(F.col("vec_id") % 7 == 3, F.expr("substring(f, 1, 1023)")).otherwise(F.col("f")))
    return V.pixel_hashes(e.groupBy(F.floor(F.col("vec_id") / 4).cast("long").alias("peak_id")).agg(F.collect_list("f").alias("frames")))


def _peaks(s, d):
    """film_id, p, q: twelve peaks of each film with hashes, and those of its copy, of which every fourth is moved, every third has another hash and every fifth none; ninth films lose five peaks, tenth ones have three."""
    a = P.anchors(_times(s, d), 12).groupBy("film_id").agg(F.array_sort(F.collect_list("t_ms")).alias("t"))
    p = F.transform("t", lambda t, i: F.struct(t.alias("t_ms"), F.substring(F.sha2(F.concat_ws("-", F.col("film_id").cast("string"), i.cast("string")), 256), 1, 16).alias("phash")))
    rows = a.select("film_id", F.when(F.col("film_id") % 10 == 0, F.slice(p, 1, 3)).otherwise(p).alias("p"))
    other = lambda x, i: F.when(i % 5 == 4, "").when((i % 3 == 0) | (F.col("film_id") % 4 == 0), F.substring(F.sha2(F.concat_ws("+", F.col("film_id").cast("string"), i.cast("string")), 256), 1, 16)).otherwise(x["phash"])
    q = F.transform("p", lambda x, i: F.struct((x["t_ms"] + F.when(i % 4 == 3, 9000).otherwise(400)).alias("t_ms"), other(x, i).alias("phash")))
    return rows.select("film_id", "p", F.when(F.col("film_id") % 9 == 0, F.slice(q, 1, 7)).otherwise(q).alias("q"))


def peak_verdicts(s, d):
    return V.match_peaks(_peaks(s, d).select(F.col("film_id").alias("pair_id"), F.col("p").alias("a"), F.col("q").alias("b")))


def dispatched(s, d):
    """Films and their copies by three kinds: keyframes without the first 22 s, peaks, and one of each."""
    rows = _peaks(s, d).join(_lists(s, d), "film_id")
    kind = lambda k: F.when(F.col("film_id") % 3 == k, V.PEAKS)
    first = F.struct(F.when(F.col("film_id") % 3 == 1, V.PEAKS).otherwise(V.KEYFRAMES).alias("kind"), F.col("times").alias("times"), F.col("p").alias("peaks"))
    second = F.struct(F.coalesce(kind(1), kind(2), F.when(F.col("film_id") % 30 == 0, "other"), F.lit(V.KEYFRAMES)).alias("kind"), F.transform(F.filter("times", lambda t: t >= 22000), lambda t: t - 22000).alias("times"), F.col("q").alias("peaks"))
    return V.match_films(rows.select(F.col("film_id").alias("pair_id"), first.alias("a"), second.alias("b")))


def _copies(s, d):
    """film_id, duration_ms, times of films, and pack_id, duration_ms, times of packs: a film's times moved by 700 without every ninth."""
    x = A.keyframes(s, d).groupBy("film_id").agg(F.array_sort(F.collect_list("t_ms")).alias("times")).where("size(times) > 1").select("film_id", F.array_max("times").alias("duration_ms"), "times")
    return x, x.select((F.col("film_id") * 10).alias("pack_id"), "duration_ms", F.transform(F.filter("times", lambda t, i: i % 9 != 8), lambda t: t + 700).alias("times"))


def pulled_packs(s, d):
    """Packs of each film's bucket, and whether they are of that film."""
    fp = F.struct(F.lit(V.KEYFRAMES).alias("kind"), F.col("times").alias("times"), F.lit(None).cast("array<struct<t_ms:bigint,phash:string>>").alias("peaks"))
    films, packs = (x.withColumn("fp", fp).drop("times") for x in _copies(s, d))
    return V.pulled(films, packs, block=64, least=10)


def _u32(x):
    return F.lpad(F.hex(x.cast("long")), 8, "0")


def _box(kind: str, *parts):
    """A box of MP4 in hex."""
    return P.let(F.concat(*parts), lambda body: F.concat(_u32(F.length(body) / 2 + 8), F.lit(kind.encode().hex()), body))


def _element(name: int, *parts):
    """An element of Matroska in hex, its length in eight bytes."""
    return P.let(F.concat(*parts), lambda body: F.concat(F.lit(f"{name:x}"), F.lit("01"), F.lpad(F.hex((F.length(body) / 2).cast("long")), 14, "0"), body))


def _chunk(name: str, *parts):
    """A chunk of AVI in hex; bodies here are of even length."""
    return P.let(F.concat(*parts), lambda body: F.concat(F.lit(name.encode().hex()), _little(F.length(body) / 2), body))


def _little(x):
    """A number in hex, its lowest byte first."""
    return P.let(_u32(x), lambda h: F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1))))


def container_keyframes_avi(s, d):
    """Orders as AVI files: a chunk for each line, of sound where its part is divisible by four, else of video, a keyframe where its supplier is even; frames last as many 1,200ths of a second as the order has lines, and 40 more."""
    o = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey"))).alias("x"))
    entry = lambda x: F.concat(F.when(x["l_partkey"] % 4 == 0, b"01wb".hex()).otherwise(b"00dc".hex()), _little((1 - x["l_suppkey"] % 2) * C.KEYFRAME_FLAG), F.lit("00" * 8))
    stream = _chunk("LIST", F.lit(b"strl".hex()), _chunk("strh", F.lit((b"vids" + bytes(16)).hex()), _little(F.size("x") + 40), _little(F.lit(1200)), F.lit("00" * 20)))
    whole = F.concat(_chunk("LIST", F.lit(b"hdrl".hex()), stream), _chunk("LIST", F.lit(b"movi".hex()), F.repeat(F.lit("00"), F.lit(500))), _chunk("idx1", F.array_join(F.transform("x", entry), "")))
    raw = F.unhex(F.concat(F.lit(b"RIFF".hex()), F.lit("00" * 4), F.lit(b"AVI ".hex()), whole))
    return C.keyframe_times(written(C.index_of(o.select(F.col("k").cast("string").alias("path"), raw.alias("content"))), "index"))


def container_keyframes(s, d):
    """Orders as media files, their lines as runs of samples or as cues; every fifth sample is a keyframe, and cues of odd lines are of another track."""
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.struct("l_linenumber", "l_suppkey", "l_partkey", F.col("l_quantity").cast("long").alias("n"), (F.col("l_partkey") % 97).alias("delta")).alias("x"))
    o = lines.groupBy("k").agg(F.array_sort(F.collect_list("x")).alias("x")).withColumn("total", F.aggregate("x", F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    stts = _box("stts", F.lit("00" * 4), _u32(F.size("x")), F.array_join(F.transform("x", lambda x: F.concat(_u32(x["n"]), _u32(x["delta"]))), ""))
    syncs = F.sequence(F.lit(1).cast("long"), F.col("total"), F.lit(5).cast("long"))
    stss = _box("stss", F.lit("00" * 4), _u32(F.size(syncs)), F.array_join(F.transform(syncs, _u32), ""))
    media = _box("mdia", _box("mdhd", F.lit("00" * 12), _u32(F.lit(90)), F.lit("00" * 12)), _box("hdlr", F.lit("00" * 8 + b"vide".hex())), _box("minf", _box("stbl", stts, stss)))
    movie = F.concat(_box("ftyp", F.lit(b"isom".hex())), _box("mdat", F.repeat(F.lit("00"), F.lit(500))), _box("moov", _box("trak", media)))
    cue = lambda x: _element(C.CUE, _element(C.CUE_TIME, _u32(x["n"] * 100 + x["delta"])), _element(C.CUE_PLACE, _element(C.CUE_TRACK, F.lpad(F.hex(x["l_linenumber"] % 2 + 1), 2, "0"))))
    head = F.concat(_element(C.INFO, _element(C.SCALE, _u32(F.lit(500_000)))), _element(C.TRACKS, _element(C.TRACK, _element(C.TRACK_NUMBER, F.lit("01")), _element(C.TRACK_TYPE, F.lit("01")))), _element(C.CUES, F.array_join(F.transform("x", cue), "")))
    matroska = F.concat(_element(C.EBML, F.lit("42868101")), _element(C.SEGMENT, head, _element(C.CLUSTER, F.repeat(F.lit("00"), F.lit(500)))))
    raw = F.unhex(F.when(F.col("k") % 2 == 0, movie).otherwise(matroska))
    return C.keyframe_times(written(C.index_of(o.select(F.col("k").cast("string").alias("path"), raw.alias("content"))), "index"))


def queries():
    return {"s17_container_keyframes": container_keyframes, "s17_avi_keyframes": container_keyframes_avi, "p_pixel_hashes": pixel_hashes, "fp_v9_verdicts": peak_verdicts, "fp_dispatch": dispatched, "j16_pulled_packs": pulled_packs}


_KF = with_("keyframes", recursive=True) + ", kf AS (SELECT DISTINCT film_id, t_ms // 1000 AS t_ms FROM keyframes), gaps AS (SELECT film_id, t_ms, t_ms - lag(t_ms) OVER (PARTITION BY film_id ORDER BY t_ms) AS gap FROM kf), lists AS (SELECT film_id, list(t_ms ORDER BY t_ms) AS times FROM kf GROUP BY film_id)"
_PQ = """, anchors AS (SELECT film_id, t_ms FROM gaps WHERE gap IS NOT NULL QUALIFY row_number() OVER (PARTITION BY film_id ORDER BY gap DESC, t_ms) <= 12),
  a AS (SELECT film_id, list(t_ms ORDER BY t_ms) AS t FROM anchors GROUP BY film_id),
  pp AS (SELECT film_id, list_transform(t[1:CASE WHEN film_id % 10 = 0 THEN 3 ELSE 12 END], lambda x, i: {'t_ms': x, 'phash': sha256(film_id || '-' || (i - 1))[1:16]}) AS p FROM a),
  pq AS (SELECT film_id, p, list_transform(p[1:CASE WHEN film_id % 9 = 0 THEN 7 ELSE 12 END], lambda x, i: {'t_ms': x.t_ms + CASE WHEN (i - 1) % 4 = 3 THEN 9000 ELSE 400 END,
    'phash': CASE WHEN (i - 1) % 5 = 4 THEN '' WHEN (i - 1) % 3 = 0 OR film_id % 4 = 0 THEN sha256(film_id || '+' || (i - 1))[1:16] ELSE x.phash END}) AS q FROM pp),
  k AS (SELECT *, least(len(p), len(q)) AS n, CASE WHEN least(len(p), len(q)) < 4 THEN 'insufficient' WHEN abs(len(p) - len(q)) > 4 THEN 'counts' ELSE 'compared' END AS outcome FROM pq),
  c AS (SELECT film_id, outcome, CASE WHEN outcome = 'compared' THEN CAST(n - 1 AS BIGINT) END AS gaps,
    CASE WHEN outcome = 'compared' THEN len(list_filter(range(2, n + 1), lambda i: abs((p[i].t_ms - p[i - 1].t_ms) - (q[i].t_ms - q[i - 1].t_ms)) <= 5000)) END AS gaps_same,
    CASE WHEN outcome = 'compared' THEN len(list_filter(range(1, n + 1), lambda i: p[i].phash <> '' AND q[i].phash <> '')) END AS hashes,
    CASE WHEN outcome = 'compared' THEN len(list_filter(range(1, n + 1), lambda i: p[i].phash <> '' AND q[i].phash <> '' AND bit_count(xor(hx(p[i].phash, 1), hx(q[i].phash, 1))) + bit_count(xor(hx(p[i].phash, 9), hx(q[i].phash, 9))) <= 20)) END AS hashes_same,
    CASE WHEN outcome = 'compared' THEN list_sort(list_transform(range(1, n + 1), lambda i: p[i].t_ms - q[i].t_ms))[n // 2 + 1] END AS trim FROM k),
  peaks AS (SELECT *, coalesce(gaps_same >= 0.55 * gaps AND hashes > 0 AND hashes_same >= 0.40 * hashes, FALSE) AS same FROM c)"""


def _hex(text: str) -> str:
    """hx(h, k) spelled out: eight hex digits of h from the k-th on as a number."""
    return re.sub(r"hx\((\w\[i\]\.phash), (\d)\)", lambda m: f"coalesce(TRY_CAST(('0x' || {m[1]}[{m[2]}:{int(m[2]) + 7}]) AS BIGINT), 0)", text)


_PQ = _hex(_PQ)
_SIDES = ", sides AS (SELECT pair_id, len(a) <= len(b) AS a_short, CASE WHEN len(a) <= len(b) THEN a ELSE b END AS short, CASE WHEN len(a) <= len(b) THEN b ELSE a END AS long FROM pairs)"
_PIXELS = """WITH px AS (SELECT vec_id // 4 AS peak_id, i // 32 AS y, i % 32 AS x, ((CAST(round(CAST(embedding[(i * 7 + i // 32 * 11) % 64 + 1] AS DOUBLE) * 1000) AS BIGINT) + i * (i // 32)) % 256 + 256) % 256 AS v FROM embeddings, (SELECT unnest(range(1024)) AS i) WHERE vec_id % 7 <> 3),
  mean AS (SELECT peak_id, y, x, avg(v) AS v FROM px GROUP BY ALL),
  basis AS (SELECT k, i, cos(pi() * (i + 0.5) * k / 32) * sqrt(2.0 / 32) / CASE WHEN k = 0 THEN sqrt(2.0) ELSE 1 END AS c FROM (SELECT unnest(range(8)) AS k), (SELECT unnest(range(32)) AS i)),
  one AS (SELECT peak_id, k AS ky, x, sum(v * c) AS v FROM mean JOIN basis ON i = y GROUP BY ALL),
  two AS (SELECT peak_id, ky, k AS kx, round(sum(v * c), 6) AS v FROM one JOIN basis ON i = x GROUP BY ALL),
  l AS (SELECT peak_id, list(v ORDER BY ky, kx)[2:64] AS v FROM two GROUP BY peak_id),
  h AS (SELECT peak_id, list_prepend(0, list_transform(v, lambda x: CASE WHEN x > list_sort(v)[32] THEN 1 ELSE 0 END)) AS b FROM l),
  ids AS (SELECT DISTINCT vec_id // 4 AS peak_id FROM embeddings)
SELECT peak_id, array_to_string(list_transform(range(16), lambda j: '0123456789abcdef'[b[j * 4 + 1] * 8 + b[j * 4 + 2] * 4 + b[j * 4 + 3] * 2 + b[j * 4 + 4] + 1]), '') AS phash FROM ids LEFT JOIN h USING (peak_id)"""


def oracle_sql():
    verdict = "fraction >= 0.55 AND round(spread, 6) <= 250"
    return {
        "p_pixel_hashes": _PIXELS,
        "s17_container_keyframes": """WITH x AS (SELECT l_orderkey AS k, l_linenumber, CAST(l_quantity AS BIGINT) AS n, l_partkey % 97 AS delta, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_partkey % 97) AS i FROM lineitem),
          runs AS (SELECT *, sum(n) OVER w - n AS first, sum(n * delta) OVER w - n * delta AS ticks FROM x WHERE k % 2 = 0 WINDOW w AS (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING)),
          samples AS (SELECT k, first + j AS nth, ticks + j * delta AS ticks FROM (SELECT *, unnest(range(n)) AS j FROM runs))
          SELECT CAST(k AS VARCHAR) AS path, CAST(ticks * 1000 // 90 AS BIGINT) AS t_ms FROM samples WHERE nth % 5 = 0
          UNION ALL SELECT CAST(k AS VARCHAR), (n * 100 + delta) * 500000 // 1000000 FROM x WHERE k % 2 = 1 AND l_linenumber % 2 = 0""",
        "s17_avi_keyframes": """WITH v AS (SELECT l_orderkey AS k, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
          f AS (SELECT k, n, l_suppkey, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS frame FROM v WHERE l_partkey % 4 <> 0)
          SELECT CAST(k AS VARCHAR) AS path, CAST(frame * 1000 * (n + 40) // 1200 AS BIGINT) AS t_ms FROM f WHERE l_suppkey % 2 = 0""",
        "fp_v9_verdicts": _KF + _PQ + " SELECT film_id AS pair_id, outcome, gaps, gaps_same, hashes, hashes_same, trim, same FROM peaks",
        "fp_dispatch": _KF
        + _PQ
        + ", pairs AS (SELECT film_id AS pair_id, times AS a, list_transform(list_filter(times, lambda t: t >= 22000), lambda t: t - 22000) AS b FROM lists JOIN peaks USING (film_id) WHERE film_id % 3 = 0 AND film_id % 30 > 0)"
        + _SIDES
        + match_sql()
        + f""" SELECT pairs.pair_id, CASE WHEN fraction IS NULL THEN 'insufficient' ELSE 'compared' END AS outcome, fraction, trim, coalesce({verdict}, FALSE) AS same FROM pairs LEFT JOIN o ON o.pair_id = pairs.pair_id
          UNION ALL SELECT film_id, outcome, CASE WHEN gaps > 0 THEN round(gaps_same / CAST(gaps AS DOUBLE), 6) END, trim, same FROM peaks WHERE film_id % 3 = 1
          UNION ALL SELECT film_id, 'incompatible', NULL, NULL, FALSE FROM peaks WHERE film_id % 3 = 2 OR film_id % 30 = 0""",
        "j16_pulled_packs": with_("keyframes", recursive=True)
        + """, lists AS (SELECT film_id, list(t_ms ORDER BY t_ms) AS times FROM keyframes GROUP BY film_id), films AS (SELECT film_id, times, CAST(round_even(list_max(times) / 60000.0, 0) AS BIGINT) AS bucket FROM lists WHERE len(times) > 1),
          packs AS (SELECT film_id * 10 AS pack_id, bucket, list_transform(list_filter(times, lambda t, i: (i - 1) % 9 <> 8), lambda t: t + 700) AS times FROM films),
          pairs AS (SELECT {'f': film_id, 'p': pack_id} AS pair_id, f.times AS a, p.times AS b FROM films f JOIN packs p USING (bucket))"""
        + _SIDES
        + match_sql().replace("len(short) >= 30", "len(short) >= 10")
        + f" SELECT pairs.pair_id.f AS film_id, pairs.pair_id.p AS pack_id, CASE WHEN fraction IS NULL THEN 'insufficient' ELSE 'compared' END AS outcome, fraction, trim, coalesce({verdict}, FALSE) AS same FROM pairs LEFT JOIN o ON o.pair_id = pairs.pair_id",
    }
